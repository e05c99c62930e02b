"""Merges the blocks of an association scan into one corrected report.

A scan leaves one result file a block of markers, with ids and numbers as text or numbers and now and then a marker twice.
This job reads all of them, cleans ids and p values, keeps the first row of a marker in a block, joins the marker map,
corrects p over the whole scan (Benjamini-Hochberg and Bonferroni) and says which significant markers lie near which locus.

It writes below `out`: `associations` by chromosome, sorted by position in ranges, so a long chromosome is many files;
`loci`, a row for each locus with the significant markers of its window; `summary`, one row by JSON. Every table is
overwritten as a whole, so a rerun, also after a run that broke off, gives the same tables.

Columns and tables are named in the config by SQL expressions over the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, main, read_table
from phenoloom.functions import columns as C
from phenoloom.operators import joins, qc, testing
from phenoloom.sources.stored import discard

#: Types of ids whose text is clean as it is.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def cleaned(results: DataFrame, names: dict, tiny: float) -> DataFrame:
    """(block, marker, p): numeric p in [tiny, 1], the first row of each marker of a block; rows without a p or marker go."""
    named = results.select(*[F.expr(names[c]).alias(c) for c in ("block", "marker", "p")], *[F.expr(c).alias(f"__o{i}") for i, c in enumerate(names["order"])])
    # What is a number already need not be read as text, and whole numbers are sorted faster than texts.
    kinds = dict(named.dtypes)
    ids = [F.col(c) if kinds[c] in WHOLE else C.clean_id(c).alias(c) for c in ("block", "marker")]
    p = F.col("p").cast("double") if kinds["p"] in (*WHOLE, "double") else C.number_or_null("p")
    typed = named.select(*ids, p.alias("p"), *[f"__o{i}" for i in range(len(names["order"]))])
    valid = typed.where(C.is_finite("p") & F.col("marker").isNotNull())
    first = qc.keep_first(valid, ["block", "marker"], [F.asc(f"__o{i}") for i in range(len(names["order"]))])
    return first.select(F.col("block").cast("string").alias("block"), F.col("marker").cast("string").alias("marker"), C.clip("p", tiny, 1.0).alias("p"))


def located(spark: SparkSession, tables: str, names: dict, key: str) -> DataFrame:
    """(key, chr, pos) of the map or of the loci."""
    return read_table(spark, tables, names["table"]).select(C.clean_id(F.expr(names[key])).alias(key), F.expr(names["chr"]).alias("chr"), F.expr(names["pos"]).cast("bigint").alias("pos"))


def run(spark: SparkSession, tables: str, out: str, config: dict) -> DataFrame:
    """Writes the three tables and returns `associations` read back."""
    results = read_table(spark, tables, config["results"]["table"])
    markers = located(spark, tables, config["map"], "marker")
    loci = located(spark, tables, config["loci"], "locus").withColumnRenamed("pos", "locus_pos")
    # The correction reads its input several times.
    rows = joins.join_matched(cleaned(results, config["results"], config["tiny"]), markers, "marker", "markers")
    alpha = config["alpha"]
    corrected = testing.corrected(rows).withColumn("significant", F.col("q") < alpha)
    order = [F.asc("chr"), F.asc("pos"), F.asc("block")]
    corrected.select("block", "marker", "chr", "pos", "p", "q", "bonferroni", "significant").repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("chr").parquet(f"{out}/associations")
    found = spark.read.parquet(f"{out}/associations")

    hits = found.where("significant")
    near = joins.within_distance(hits, loci, config["window"]).groupBy("locus").agg(F.count("*").alias("n_significant"), F.min(F.struct("p", "marker", "block")).alias("best"))
    report = loci.join(near, "locus", "left").select("locus", "chr", "locus_pos", F.coalesce("n_significant", F.lit(0).cast("bigint")).alias("n_significant"), F.col("best.p").alias("best_p"), F.col("best.marker").alias("best_marker"))
    report.write.mode("overwrite").partitionBy("chr").parquet(f"{out}/loci")

    inflation = testing.genomic_inflation(rows.select("p"))
    counts = found.agg(F.count("*").alias("n_markers"), (alpha / F.count("*")).alias("bonferroni_p"), F.count_if(F.col("bonferroni") < alpha).alias("n_bonferroni"), F.count_if("significant").alias("n_fdr"), F.min("p").alias("best_p"))
    counts.crossJoin(inflation).write.mode("overwrite").json(f"{out}/summary")
    summary = spark.read.json(f"{out}/summary").first()
    LOG.info("wrote %s/associations: %s", out, summary.asDict() if summary else "no row")
    discard(rows)
    return found


if __name__ == "__main__":
    main(run, "association_report", out="folder for associations, loci and summary")
