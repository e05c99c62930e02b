"""A corpus from raw documents to token ids: each stage's result is written as Parquet and read again as the next one's input.

Every stage has its own row of decisions: toxic documents go, one document of each near-duplicate group stays, passages
that repeat an earlier document's are cut, sources are mixed to their target weights, and what is left is encoded.

Defined cases, for every stage: an empty table gives an empty table of the same columns; further columns, whatever their
names, are passed on by all stages but the last; very long texts are read whole. Null texts have no match, no shingle and
no passage, so the first three stages keep them; they have size 0 and are taken once, and are encoded as empty. Rows
without doc_id are rows like others, but no passage is looked for in them. Rows that repeat an id and a text are one
document to near_duplicates, which keeps one of them, and are further rows to all other stages. Where two documents are
alike, the one with the smaller id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoloom.llm.common import documents, materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted to the labelled ones among them, does not call toxic."""
    from phenoloom.llm.toxicity import fit, score

    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep=tuple(docs.columns), column="__toxicity").where("__toxicity < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group."""
    from phenoloom.llm.minhash_dedup import drop_near_duplicates

    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document with a smaller id has; n_chars is set anew."""
    from phenoloom.llm.substring_dedup import cut_repeats

    kept = cut_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    from phenoloom.llm.mixing import mixed_rows

    return mixed_rows(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the ids and the text decoded from them."""
    from phenoloom.llm.queries import vocabulary
    from phenoloom.llm.sentencepiece_codec import encode_decode

    encoded = encode_decode(docs, vocabulary("piece_bpe_32k.model"), keep=("doc_id", "source"))
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Hash-based rounding and merges can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
