"""The thin queries over the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import digests, encode_decode

    return digests(encode_decode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import id_remainder
    from .langid import fit, identify

    docs = documents(spark, sf_dir)
    found = identify(docs, fit(docs))
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .edit_fingerprint import fingerprint_edits, near_groups

    found = fingerprint_edits(documents(spark, sf_dir)).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    found = materialise(found, "fingerprints")
    groups = near_groups(found).withColumnRenamed("doc_id", "near_to")
    near_id = F.coalesce("near_id", "doc_id").alias("near_id")
    return found.join(groups, F.col("doc_id") == F.col("near_to"), "left").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", near_id)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import report

    found = report(documents(spark, sf_dir))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ";")
    return found.select("doc_id", "component_id", "n_links", "n_words", "n_shared", "n_repeated", "first_ids", written("shared").alias("shared_spans"), written("repeated").alias("repeated_spans"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import id_remainder
    from .toxicity import fit, score

    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main

    found = extract_main(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import clean_lines

    lost = [f"lost_{r}" for r in ("boilerplate", "navigation", "punctuation")]
    found = clean_lines(documents(spark, sf_dir)).withColumn("cleaned_sha256", F.sha2("cleaned", 256))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *lost, "cleaned_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


NEAR_DUPLICATES_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
starts as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i from w where len(ws) > 0),
sh as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') s from starts),
n as (select doc_id, count(*) n from sh group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
link as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join link l on l.a = r.other),
comp as (select doc_id, min(other) component_id from reach group by doc_id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, comp.component_id, d.doc_id = comp.component_id kept from documents d join comp using (doc_id) left join n using (doc_id)
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _importance_sql(buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> str:
    """crc32 goes by half bytes, low half first, over a table of 16 numbers that its polynomial gives."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = "unnest(list_concat(w, list_concat([w[i] || ' ' || w[i + 1] for i in range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])))"
    halves = "flatten([[cast('0x' || h[2 * i : 2 * i] as bigint), cast('0x' || h[2 * i - 1 : 2 * i - 1] as bigint)] for i in range(1, len(h) // 2 + 1)])"
    crc = f"xor(4294967295, list_reduce({halves}, lambda c, x: xor(c >> 4, {table}[(xor(c, x) & 15) + 1]), cast(4294967295 as bigint)))"
    return f"""
with d as (select doc_id, {words("text")} w from documents), b as (select {words("text")} w from benchmark),
df as (select doc_id, f, count(*) n from (select doc_id, {runs} f from d) group by all), bf as (select f, count(*) n from (select {runs} f from b) group by f),
k as (select f, {crc} % {buckets} bucket from (select f, hex(encode(f)) h from (select f from df union select f from bf))),
s as (select bucket, sum(n) n from df join k using (f) group by bucket), t as (select bucket, sum(n) n from bf join k using (f) group by bucket),
g as (select x.bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1) * cast((select coalesce(sum(n), 0) from s) + {buckets} as double) / ((coalesce(s.n, 0) + 1) * cast((select coalesce(sum(n), 0) from t) + {buckets} as double)))) as bigint) gain from range({buckets}) x(bucket) left join s on s.bucket = x.bucket left join t on t.bucket = x.bucket),
sums as (select doc_id, sum(n) n, sum(n * gain) weight from df join k using (f) join g using (bucket) group by doc_id),
w as (select doc_id, sum(len(w)) n_words from d group by doc_id),
c as (select doc_id, n_words, coalesce(n, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) as bigint) + 0.5) / 4294967296.0))) score from w left join sums using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) "rank", count(*) over () n from c where n_words >= {least_words})
select doc_id, cast(n_features as bigint) n_features, cast(weight as bigint) weight, cast(score as bigint) score, cast(case when "rank" <= {percent} * n // 100 then "rank" end as bigint) "rank" from c left join r using (doc_id)
"""


def _quality_sql() -> str:
    from .quality import LEAST_WORDS, MARKS, PHRASES, SEPARATORS, SHORT_LINE, SYMBOLS

    listed = lambda values: ", ".join(f"'{v}'" for v in values)
    word = r"'[^\x20\x09-\x0D]+'"
    count = lambda condition: f"len(list_filter(w, lambda x: {condition}))"
    noisy = f"regexp_matches(x, '[{SYMBOLS}]|[!?]{{2}}')"
    phrase = " or ".join(f"contains(translate(line, '{_UPPER}', '{_LOWER}'), '{p}')" for p in PHRASES)
    rule = f"""case when again or (len(w) < {SHORT_LINE} and ({phrase})) then 'boilerplate'
 when {count(f"x in ({listed(SEPARATORS)})")} >= 2 and 5 * {count(f"x in ({listed(SEPARATORS)})")} >= len(w) then 'navigation'
 when 10 * {count(noisy)} > 3 * len(w) or 2 * len(regexp_extract_all(regexp_extract(line, '[^{"".join(MARKS)}]*$'), {word})) > len(w) then 'punctuation' end"""
    lost = ", ".join(f"cast(coalesce(sum(len(w)) filter (rule = '{r}'), 0) as bigint) lost_{r}" for r in ("boilerplate", "navigation", "punctuation"))
    return f"""
with d as (select doc_id, coalesce(text, '') text from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from d),
m as (select *, row_number() over (partition by doc_id, line order by i) > 1 again from (select *, regexp_extract_all(line, {word}) w from l) where len(w) > 0),
j as (select *, {rule} rule from m),
lines as (select doc_id, cast(count(*) filter (again) as bigint) n_dup_lines, {lost}, coalesce(string_agg(line, chr(10) order by i) filter (rule is null), '') cleaned from j group by doc_id),
ws as (select doc_id, text, regexp_extract_all(text, {word}) w from d),
win as (select doc_id, i, count(*) over (partition by doc_id, g) c from (select doc_id, i, w[i : i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from ws))),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from win where c >= 2) group by doc_id),
b as (select ws.doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, cast(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) as bigint) n_symbols, coalesce(n_dup_lines, 0) n_dup_lines, cast(coalesce(n, 0) as bigint) n_repeat_words,
 coalesce(lost_boilerplate, 0) lost_boilerplate, coalesce(lost_navigation, 0) lost_navigation, coalesce(lost_punctuation, 0) lost_punctuation, sha256(coalesce(cleaned, '')) cleaned_sha256 from ws left join lines using (doc_id) left join rep using (doc_id))
select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words base_failed, not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words) and 2 * (lost_boilerplate + lost_navigation + lost_punctuation) <= n_words kept from b
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_minhash_dedup": NEAR_DUPLICATES_SQL, "op11_importance_resampling": _importance_sql(), "op12_quality_rules": _quality_sql()}
