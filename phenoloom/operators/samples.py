"""The order of samples: a digest of the ordered ids travels with the dosage column, so arrays are not aligned by luck.

A dosage array says nothing of whose calls it holds. Where a table of markers is made, `with_order` writes a digest of the
ids into the column's metadata; Spark keeps it through selects, filters, joins and Parquet. Whoever lines a phenotype up
with such a column names its samples, and another set or order of ids is an error when the plan is made, before any task
runs. A column computed anew has no digest until it is given one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "samples"


def digest(ids: Sequence) -> str:
    """One number for the ids in their order; ids are compared as text."""
    out = hashlib.sha256()
    for i in ids:
        text = str(i).encode()
        out.update(len(text).to_bytes(4, "big") + text)
    return f"{len(ids)}:{out.hexdigest()}"


def with_order(markers: DataFrame, ids: Sequence, dosage: str = "dosage") -> DataFrame:
    """markers, the dosage column saying that its elements are these samples' in this order."""
    return markers.withMetadata(dosage, {**markers.schema[dosage].metadata, KEY: digest(ids)})


def order_of(markers: DataFrame, dosage: str = "dosage") -> str | None:
    return markers.schema[dosage].metadata.get(KEY)


def require_order(markers: DataFrame, ids: Sequence | None, dosage: str = "dosage", named: bool = False) -> None:
    """An error if the column says another order than these ids. With `named`, also if it says one and no ids are given."""
    known = order_of(markers, dosage)
    if known is None or (ids is None and not named):
        return
    if ids is None:
        raise ValueError(f"{dosage} says whose calls it holds; name the samples of the phenotype too")
    if known != digest(ids):
        raise ValueError(f"{dosage} holds {known.split(':')[0]} samples in another order or of other ids than the {len(ids)} given")


def lined_up(table: DataFrame, ids: Sequence, key: str, columns: Sequence[str]) -> np.ndarray:
    """The numeric columns as samples x columns in the order of ids, matched by id; an id without exactly one complete row is an error."""
    spark = table.sparkSession
    order = spark.createDataFrame([(k, str(i)) for k, i in enumerate(ids)], "__place long, __id string")
    own = table.select(F.col(key).cast("string").alias("__id"), *[F.col(c).cast("double").alias(c) for c in columns])
    rows = order.join(own, "__id", "left").orderBy("__place").collect()
    bad = [r["__id"] for k, r in enumerate(rows) if any(r[c] is None for c in columns) or (k and rows[k - 1]["__place"] == r["__place"])]
    if bad:
        raise ValueError(f"samples without exactly one complete row: {', '.join(bad[:5])}")
    return np.array([[r[c] for c in columns] for r in rows], float).reshape(len(rows), len(columns))
