"""Which words go with a label: an association scan over texts that arrive as files, kept up to date by partial sums.

Texts are samples, distinct words their presence markers, a label is the phenotype. A run takes the files of the table that
the checkpoint has not seen, as one or more batches, and writes for each batch the carriers and label sums of every word
below `out`: `carriers/batch=N`, and of all samples: `totals/batch=N`. A batch that is run again after a failure overwrites
its own partitions with the same rows. Then the sums of all batches, not the texts, are added and scanned anew, p is
corrected, and `associations` is written by parts, dealt by a word's first character and length. A run without new files
leaves all sums as they are and gives the same report.

The phenotype table is read when a batch is; a text counts with the label it has then, texts without one don't count. A file
is taken once, by its name, so files must not be changed after they have arrived; ids are not compared between files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, exists, main, read_table
from phenoloom.operators import presence, testing
from phenoloom.sources.stored import discard, stored


def add_batch(batch: DataFrame, number: int, phenotype: DataFrame, out: str, names: dict) -> None:
    """Sums of one batch; the word sums and the totals each have a partition of their own."""
    texts = batch.select(F.col(names["id"]).alias("__id"), F.col(names["text"]).alias("text"))
    samples = texts.join(phenotype, "__id").select("text", "y")
    tables = {"carriers": presence.carrier_sums(samples, presence.words("text")), "totals": presence.sample_sums(samples)}
    for name, sums in tables.items():
        sums.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")
    LOG.info("wrote batch %s to %s/carriers and %s/totals", number, out, out)


def arrived(spark: SparkSession, tables: str, out: str, checkpoint: str, config: dict) -> None:
    """Takes all files that have not been taken yet, and returns when they are done."""
    names, wanted = config["samples"], config["phenotype"]
    path = f"{tables}/{names['table']}.parquet"
    schema = read_table(spark, tables, names["table"]).schema
    phenotype = read_table(spark, tables, wanted["table"]).select(F.col(wanted["id"]).alias("__id"), F.expr(wanted["y"]).alias("y")).where("y is not null")
    # As a pattern the path may be a folder that grows or a single file, which a file stream otherwise refuses.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{path[:-1]}[{path[-1]}]")
    work = lambda batch, number: add_batch(batch, number, phenotype, out, names)
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    LOG.info("took %s new rows of %s", sum(p.numInputRows for p in query.recentProgress), path)


def run(spark: SparkSession, tables: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """Adds what is new and returns `associations` read back: (marker, n1, frequency, beta, t, p, q, part)."""
    arrived(spark, tables, out, checkpoint, config)
    schemas = {"carriers": "marker string, n1 bigint, s1 double, batch int", "totals": "n bigint, s double, ss double, batch int"}
    sums = {k: spark.read.schema(v).parquet(f"{out}/{k}") if exists(spark, f"{out}/{k}") else spark.createDataFrame([], v) for k, v in schemas.items()}
    carriers = sums["carriers"].groupBy("marker").agg(F.sum("n1").alias("n1"), F.sum("s1").alias("s1"))
    totals = sums["totals"].agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    scanned = stored(presence.presence_scan(carriers, totals, config["least_frequency"]), "word-scan")
    part = F.pmod(F.ascii("marker") + F.length("marker"), F.lit(config["parts"])).cast("int")
    found = testing.benjamini_hochberg(scanned).withColumn("part", part)
    found.repartition("part").sortWithinPartitions("part", "marker").write.mode("overwrite").partitionBy("part").parquet(f"{out}/associations")
    discard(scanned)
    written = spark.read.schema("marker string, n1 bigint, frequency double, beta double, t double, p double, q double, part int").parquet(f"{out}/associations")
    LOG.info("wrote %s/associations: %s words", out, written.count())
    return written


if __name__ == "__main__":
    main(run, "text_association", out="folder for sums and associations", checkpoint="folder that says which files have been taken")
