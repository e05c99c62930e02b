"""The jobs as registered queries: each runs twice into one new folder of spark.checkpoint.dir and gives the output as it then stands."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import association_report, text_association
from jobs.common import read_config
from phenoloom.plans.queries import t_tail_sql
from phenoloom.sources.stored import shared_folder


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in columns else F.col(c) for c in df.columns])


def job1_association_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}", read_config("association_report")
    for _ in range(2):
        found = association_report.run(spark, sf_dir, out, config)
    return _rounded(found, "p", "q", "bonferroni")


def job2_text_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}", read_config("text_association")
    for _ in range(2):
        found = text_association.run(spark, sf_dir, f"{folder}/out", f"{folder}/checkpoint", config)
    return _rounded(found, "frequency", "beta", "t", "p", "q")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_association_report, job2_text_association)}


#: q: the smallest p' m / rank(p') of all p' that are not below p.
_Q = "least(1.0, min(p * m / below) over (order by p desc))"


def oracle_sql() -> dict[str, str]:
    report, text = read_config("association_report"), read_config("text_association")
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    job1 = f"""
with r as (select l_suppkey, l_partkey, least(greatest({report["results"]["p"]}, {report["tiny"]}), 1.0) p, row_number() over (partition by l_suppkey, l_partkey order by l_orderkey, l_linenumber) k from lineitem),
x as (select cast(l_suppkey as varchar) block, cast(l_partkey as varchar) marker, cast(p_size % 5 + 1 as int) chr, p_partkey * 997 pos, p, count(*) over () m, count(*) over (order by p) below from r join part on p_partkey = l_partkey where k = 1),
y as (select *, {_Q} q from x)
select block, marker, chr, cast(pos as bigint) pos, round(p, 9) p, round(q, 9) q, round(least(p * m, 1.0), 9) bonferroni, q < {report["alpha"]} significant from y"""
    job2 = f"""
with d as (select list_distinct(regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) w, cast(toxic as double) y from documents join labels using (doc_id) where toxic is not null),
t as (select count(*) n, sum(y) s, sum(y * y) ss from d), c as (select marker, count(*) n1, sum(y) s1 from (select unnest(w) marker, y from d) group by marker),
e as (select marker, n1, n, n1 / n f, s1 - n1 * s / n cov, n1 - n1 * n1 / n vg, ss - s * s / n vy from c, t where n1 / n between {text["least_frequency"]} and {1 - text["least_frequency"]}),
b as (select *, cov / vg beta, case when vg * vy - cov * cov > 0 then cov * sqrt((n - 2) / (vg * vy - cov * cov)) else sign(cov) * cast('inf' as double) end t from e where vg > 0 and vy > 0),
x as (select *, case when isinf(t) then 0 else {t_tail_sql("t", "n - 2")} end p from b), y as (select *, count(*) over () m, count(*) over (order by p) below from x)
select marker, cast(n1 as bigint) n1, round(f, 9) frequency, round(beta, 9) beta, round(t, 9) t, round(p, 9) p, round({_Q}, 9) q, cast((unicode(marker) + length(marker)) % {text["parts"]} as int) part from y"""
    return {"job1_association_report": job1, "job2_text_association": job2}
