"""The pipeline's stages against plain versions of each decision."""

import random
from collections import Counter

import corpus_pipeline as P
from phenoloom.llm import queries, toxicity
from phenoloom.llm.common import materialise
from test_dedup import brute, repeats


def test_stages(spark, small):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    steps, before_all = {}, docs
    for name, stage in P.STAGES:
        before, docs = docs, materialise(stage(spark, docs, small), "t")
        steps[name] = (before.collect(), docs.collect())
        if name != "sentencepiece":
            assert docs.columns == before.columns
    a, b = steps["toxicity"]
    gone = {r["doc_id"] for r in a} - {r["doc_id"] for r in b}
    # By hand: a document goes if and only if the model, fitted to the labelled ones, scores its text at a half or more.
    matcher = toxicity.fit(spark.createDataFrame(a, before_all.schema), spark.read.parquet(f"{small}/labels.parquet")).matcher()
    assert gone == {r["doc_id"] for r in a if matcher.scores([r["text"]])[0] >= 0.5}
    assert all(labels.get(i, 1) for i in gone)
    a, b = steps["near_duplicates"]
    want, _ = brute({r["doc_id"]: r["text"] for r in a})
    assert sorted(r["doc_id"] for r in b) == sorted(i for i in want if want[i] == i)
    a, b = steps["repeated_passages"]
    texts = {r["doc_id"]: r["text"] for r in b}
    assert not any(repeats(texts).values()) and all(r["n_chars"] == len(r["text"]) for r in b)
    found = repeats({r["doc_id"]: r["text"] for r in a})
    assert all(texts.get(r["doc_id"]) == r["text"] for r in a if not found[r["doc_id"]] and r["doc_id"] in texts and len(texts[r["doc_id"]]) == len(r["text"]))
    a, b = steps["mixing"]
    assert {r["doc_id"] for r in b} <= {r["doc_id"] for r in a} and max(sum(x["doc_id"] == i for x in b) for i in {r["doc_id"] for r in b}) <= 3
    a, b = steps["sentencepiece"]
    assert sorted((r["doc_id"], r["text"]) for r in a) == sorted((r["doc_id"], r["decoded"]) for r in b)
    assert all(r["n_tokens"] == len(r["ids"]) for r in b)


def test_toxic_documents_go(spark, tmp_path):
    """Insults planted in texts of random words: all documents that hold one go, labelled or not, and only these."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abdeghiklmnoprstuv", k=rng.randint(3, 8))) for _ in range(400)]
    rows, labels, toxic = [], [], set()
    for i in range(600):
        text = rng.choices(words, k=rng.randint(20, 80))
        if i % 5 == 3:
            toxic.add(i)
            for insult in rng.sample(["worthless", "pathetic", "imbecile", "scumbag"], 2):
                text.insert(rng.randrange(len(text)), insult)
        rows.append((i, " ".join(text), "en", "a", len(" ".join(text))))
        if i < 500:
            labels.append((i, int(i in toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = P.toxicity(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(600)) - toxic


def test_toxic_recall_on_given_labels(spark):
    """Of the given labels most toxic documents go and nearly no other does; labels that the fit has not seen are asked apart."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r["doc_id"] for r in P.toxicity(spark, docs, sf).select("doc_id").collect()}
    toxic = [i not in left for i, t in labels.items() if t == 1]
    clean = [i not in left for i, t in labels.items() if t == 0]
    assert sum(toxic) >= 0.85 * len(toxic) > 300 and sum(clean) <= 0.02 * len(clean)
    held = [r for r in queries.op8_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    hit = [r["predicted"] for r in held if labels[r["doc_id"]] == 1]
    wrong = [r["predicted"] for r in held if labels[r["doc_id"]] == 0]
    assert sum(hit) >= 0.85 * len(hit) > 50 and sum(wrong) <= 0.02 * len(wrong)


def test_stages_on_odd_tables(spark, small):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    long, dup = "alpha beta gamma delta epsilon zeta " * 9000, " ".join(f"word{i}" for i in range(80))
    rows = [(1, "some text of a few words", "en", "a", 24), (1, "some text of a few words", "en", "a", 24), (2, None, None, None, None), (3, "", "en", "a", 0), (None, dup, None, "b", 1), (4, dup, "en", None, 1), (5, long, "en", "b", 1), (6, dup + " and its own end", "en", "b", 1)]
    df = spark.createDataFrame([(*r, "x", 0.5, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, size int")
    docs = df
    for name, stage in P.STAGES:
        empty = stage(spark, df.limit(0), small)
        out = materialise(stage(spark, docs, small), "t")
        assert empty.count() == 0 and empty.columns == out.columns
        if name != "sentencepiece":
            assert out.columns == df.columns
            if name == "toxicity":
                assert out.count() == len(rows)
            docs = out
    left = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert left[2, None] == 1 and left[3, ""] == 1 and all(n <= 3 for n in left.values())
    assert {i for i, _ in left} <= {None, 1, 2, 3, 4, 5, 6}
