"""Mixing, language, toxicity, fingerprints, neighbours and pages."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from phenoloom.llm import ann, edit_fingerprint, html_extract, langid, mixing, toxicity
from phenoloom.llm import queries as Q
from phenoloom.llm.common import WORDS
from pyspark.sql import functions as F

# --- mixing ---


def targets(sizes, weights=(5, 2, 1), most=3.0):
    """Shares by weight, again and again until none is above its cap."""
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    fixed, rest = {}, sum(sizes.values())
    while True:
        free = [k for k in names if k not in fixed]
        share = {k: (rest - sum(fixed.values())) * w[k] / sum(w[x] for x in free) for k in free}
        over = [k for k in free if share[k] > most * sizes[k]]
        if not over:
            return {**fixed, **share}
        fixed |= {k: most * sizes[k] for k in over}


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 60)), f"s{rng.integers(0, 5)}" if i % 9 else None) for i in range(1500)] + [(2000, None, "s1"), (None, "a b", "s2"), (7, "dup", "s2"), (7, "dup", "s2"), (3000, "one two three", "tiny")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int").repartition(6)
    got = mixing.mix(df, fan_in=8).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORDS.findall(t or ""))
    want, longest, taken = targets(sizes), 60, {}
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= longest for s in want)
    again = sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(df.repartition(2), fan_in=8).collect())
    assert again == sorted((str(r["doc_id"]), r["taken"]) for r in got)
    out = mixing.mixed_rows(df, fan_in=8)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_rounding_keeps_expectations(spark):
    """Over seeds, a document of a source at rate 0.625 is taken in about that share of cases."""
    df = spark.createDataFrame([(i, "w " * (5 + i % 7), "a" if i < 30 else "b") for i in range(60)], "doc_id long, text string, source string")
    total = np.zeros(60)
    for seed in range(12):
        for r in mixing.mix(df, seed=seed, fan_in=8).collect():
            total[r["doc_id"]] += r["copies"]
    rate = {r["source"]: r["target"] / r["source_size"] for r in mixing.mix(df).collect()}
    assert abs(total[:30].mean() / 12 - rate["a"]) < 0.08 and abs(total[30:].mean() / 12 - rate["b"]) < 0.08
    assert len(set(total[30:])) > 2


def test_rows_without_id_are_dealt_like_others(spark):
    """4,000 rows alike in id, source and text are numbered apart, and the mix does not depend on the partitioning."""
    rows = [(None if i % 2 else 7, "w " * (i % 3 + 4), "ab"[i % 5 > 0]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [sorted(map(tuple, mixing.mix(df.repartition(n)).groupBy("source", "size", "taken").count().collect())) for n in (3, 7)]
    assert found[0] == found[1]
    sized = df.repartition(5).select(F.monotonically_increasing_id().alias("__key"), F.xxhash64("doc_id", "source", "text").alias("__id"))
    numbers = mixing.numbered(sized).join(sized, "__key").groupBy("__id").agg(F.count("*").alias("n"), F.count_distinct("__number").alias("d"), F.max("__number").alias("m")).collect()
    assert numbers and all(r["n"] == r["d"] == r["m"] + 1 for r in numbers)
    group = F.pmod(F.xxhash64(F.lit(0), F.xxhash64("__id", "__number")), F.lit(-(-4000 // 48)))
    largest = mixing.numbered(sized).join(sized, "__key").groupBy(group).count().agg(F.max("count")).first()[0]
    assert largest < 100


def test_mix_of_one_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w", "b"), (3, "w w", None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert got[1]["size"] == 300_000 and got[2]["taken"] <= 3 and got[3]["target"] == pytest.approx(targets({"a": 300_000, "b": 1, None: 2})[None])


# --- languages ---


def test_every_label_is_learned(spark):
    """205 labels, each with letters of its own; n-grams that occur once count too; columns named like ours; repeated rows and a very long text."""
    word = lambda k: chr(0x4E00 + k) + chr(0x5E00 + k)
    rows = [(i, word(k), f"l{k:03}", 0.5, "x") for k in range(205) for i in (1000 * k + j for j in range(8))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, shares string")
    model = langid.fit(df)
    assert len(model.names) == 205
    new = [(1, word(3)), (1, word(3)), (2, word(204)), (3, (word(7) + " ") * 60_000), (4, word(8) + " " + word(8) + " " + word(9))]
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(spark.createDataFrame(new, "doc_id long, text string"), model).collect()]
    assert sorted(got) == [(1, "l003"), (1, "l003"), (2, "l204"), (3, "l007"), (4, "l008")]
    kept = langid.identify(df.limit(5), model, keep=("doc_id", "lang"))
    assert kept.columns == ["doc_id", "lang", "lang_pred", "score", "shares"] and kept.count() == 5


def test_word_likelihoods_are_those_of_a_plain_model():
    counts = {"a": {"x": 3, "xy": 1, " x": 2, " ": 6}, "b": {"y": 2, " ": 4, "yx ": 1}}
    model = langid.LanguageModel.fit(counts)
    kinds = {n: len({g for c in counts.values() for g in c if len(g) == n}) + 1 for n in (1, 2, 3)}
    words = ["x", "xy", "zz", "yx"]
    for w, row in zip(words, model.words_logs(words), strict=True):
        for k, name in enumerate(model.names):
            total = {n: sum(v for g, v in counts[name].items() if len(g) == n) + 0.1 * kinds[n] for n in (1, 2, 3)}
            want = sum(langid.SHARES[len(g) - 1] * np.log((counts[name].get(g, 0) + 0.1) / total[len(g)]) for g in langid.grams(w))
            assert row[k] == pytest.approx(want, rel=1e-5)


def test_languages_of_held_out_documents(spark, small):
    got = Q.op3_langid(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_mixture_and_odd_texts(spark):
    docs = [(i, t, g) for i, (t, g) in enumerate([("the thing and the other thing was here", "en"), ("der die das und nicht ein mit", "de")] * 20)]
    df = spark.createDataFrame([*docs, (90, None, "en"), (91, "", None), (92, "123 !!", "de"), (93, "the and thing der das nicht und die mit ein das", None), (None, "the thing", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (90, 91, 92)] == ["und"] * 3 and got[91]["score"] == 0
    assert got[93]["lang_pred"] == "de" and 0.05 < got[93]["shares"][model.names.index("en")] < 0.5
    assert got[0]["shares"][model.names.index("de")] == 0 and got[None]["lang_pred"] == "en"
    none = langid.fit(df.where("lang is null"))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


# --- toxicity ---


def test_automaton_is_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = np.random.default_rng(1)
    terms = ["idiot", "moron", "disgusting", "scum"]
    a = toxicity.LexiconAutomaton({t + "$": 1.0 for t in terms})
    allowed = {t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2 for t in terms}
    for _ in range(4000):
        t = terms[rng.integers(4)]
        w = list(t)
        for _ in range(rng.integers(0, 4)):
            k = rng.integers(1, len(w) + 1) if len(w) > 1 else 0
            op = rng.integers(3)
            if op == 0 and 0 < k < len(w):
                del w[k]
            elif op == 1 and 0 < k < len(w):
                w[k] = "abcdio"[rng.integers(6)]
            else:
                w.insert(k, "xyot"[rng.integers(4)])
        w = "".join(w)
        near = [distance(t, w) for t in terms if t[0] == w[0] and distance(t, w) <= allowed[t]]
        assert (a.edits(w) if a.edits(w) < 9 else None) == (min(near) if near else None), w
    stem = toxicity.LexiconAutomaton({"lowei": 1.0})
    assert stem.edits("loweischaft") == 0 and stem.edits("lowe") == 9 and stem.edits("lowexi") == 9


def test_stems_of_long_words_are_seen():
    words = toxicity.KnownWords(toxicity.LexiconAutomaton({"lowei": 1.0}))
    assert words["lowei" + "x" * 80] == 0 and words["x" * 80] == 9


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_loose_automaton_is_edit_distance():
    rng = np.random.default_rng(4)
    terms = ["idiot", "scum", "moronic", "disgusting", "ass"]
    loose = toxicity.LexiconAutomaton({t + "$": 1.0 for t in terms}, loose=True)
    allowed = {t: 0 if len(t) < 4 else 1 if len(t) < 9 else 2 for t in terms}
    for _ in range(3000):
        w = list(terms[rng.integers(len(terms))])
        for _ in range(rng.integers(0, 4)):
            k, op = rng.integers(0, len(w) + 1), rng.integers(3)
            if op == 0 and k < len(w):
                del w[k]
            elif op == 1 and k < len(w):
                w[k] = "abcdio1"[rng.integers(7)]
            else:
                w.insert(k, "xyot"[rng.integers(4)])
        w = "".join(w)
        near = [d for t in terms if (d := plain_distance(t, w)) <= allowed[t]]
        assert (loose.edits(w) if loose.edits(w) < 9 else None) == (min(near) if near else None), w
    strict = toxicity.LexiconAutomaton({t + "$": 1.0 for t in terms})
    words = toxicity.KnownWords(strict, loose)
    assert [words[w] for w in ("scvm", "noronic", "1diot", "scum", "idiots", "plain")] == [8, 8, 8, 0, 1, 9]
    stem = toxicity.KnownWords(toxicity.LexiconAutomaton({"idiot": 1.0}), toxicity.LexiconAutomaton({"idiot": 1.0}, loose=True))
    assert [stem[w] for w in ("idiotic", "id1ot", "1diot", "idioz")] == [0, 8, 8, 9]


def test_scores_are_those_of_a_plain_scorer():
    """Features by comparing every word with every term, and the logistic function of their weighted sum."""
    terms = {"moron$": 3.0, "worthless$": 3.0}
    rng = np.random.default_rng(5)
    model = toxicity.ToxicityModel(terms, rng.normal(size=toxicity.FEATURES).tolist())
    vocabulary = ["moron", "mororn", "woron", "worthless", "worthles", "vorthless", "good", "day", "Moron!", "such"]
    texts = [" ".join(vocabulary[k] for k in rng.integers(0, 10, n)) for n in rng.integers(0, 30, 60)] + ["x " * 50_000 + "moron"]

    def plain(text):
        counts = [0, 0, 0]
        for w in text.split():
            w = w.lower().strip(toxicity.TRIM)
            bodies = ["moron", "worthless"]
            strict = [d for b in bodies if w[:1] == b[0] and (d := plain_distance(b, w)) <= (1 if len(b) < 9 else 2)] if len(w) < 20 else []
            loose = [b for b in bodies if plain_distance(b, w) <= (1 if len(b) < 9 else 2)] if len(w) < 20 else []
            if strict:
                counts[min(strict) > 0] += 1
            elif loose:
                counts[2] += 1
        weight = counts[0] + toxicity.MISSPELLED * counts[1] + toxicity.LOOSE * counts[2]
        x = [1, weight > 0, np.log1p(weight), counts[1] > 0 and not counts[0], counts[2] > 0 and not counts[0] and not counts[1], 0, 0, 0, np.log1p(weight) / np.log(10 + len(text.split()))]
        return 1 / (1 + np.exp(-np.clip(np.dot(np.array(x, float), model.weights), -30, 30)))

    assert model.matcher().scores(texts) == pytest.approx([plain(t) for t in texts])


def test_labels_decide_how_far_a_misspelling_is_believed(spark):
    """Where clean texts hold a word that looks like a misspelled term, that word alone is not believed."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("aeinrst"), 6))
    rows = []
    for i in range(900):
        words = [word() for _ in range(30)]
        if i % 6 == 0:
            words[4] = "moron"
        elif i % 2:
            words[4] = "boron"
        rows.append((i, " ".join(words), int(i % 6 == 0), 0.5, "t"))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double, family string")
    model = toxicity.fit(df.select("doc_id", "text", "score", "family"), df.select("doc_id", "toxic"))
    assert set(model.terms) == {"moron$"}
    a, b = model.matcher().scores(["a boron here", "a moron here"])
    assert a < 0.5 < b
    twice = toxicity.score(df.union(df.limit(3)), model).collect()
    assert len(twice) == 903


def labelled(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("aeinrst"), 6))
    rows = []
    for i in range(600):
        bad = i % 6 == 0
        words = [word() for _ in range(40)]
        if bad:
            words[3], words[20] = "moron", "worthless"
        rows.append((i, " ".join(words), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_by_held_out_labels(spark):
    df = labelled(spark)
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert set(model.terms) == {"moron$", "worthless$"}
    got = toxicity.score(df, model, keep=("doc_id", "toxic")).collect()
    assert all((r["score"] >= 0.5) == bool(r["toxic"]) for r in got)
    m = model.matcher()
    exact, wrong, quoted, empty, null = m.scores(["such a moron", "such a mororn", 'they wrote "such a moron" and left', "", None])
    assert exact > 0.5 > quoted and exact >= wrong > quoted and empty == null < 0.5
    odd = spark.createDataFrame([(None, None, None), (1, None, 1), (2, "x", None)], "doc_id long, text string, toxic int")
    empty_model = toxicity.fit(odd.select("doc_id", "text"), odd.select("doc_id", "toxic"))
    assert toxicity.score(odd, empty_model).where("score < 0.5").count() == 3
    assert toxicity.score(df.limit(0), model).count() == 0


# --- fingerprints ---


def test_edited_texts_and_likeness(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefgh é"), int(n))) for n in rng.integers(0, 900, 80)] + ["", "x", "🙂é" * 40]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, bin string").repartition(7)
    got = {r["doc_id"]: r for r in edit_fingerprint.fingerprint_edits(df).collect()}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        assert got[i]["edited"] == t[: len(t) - half] + following[:half] and got[i]["n_chars"] == len(t)
        assert got[i]["fingerprint"] == edit_fingerprint.fingerprints([t])[0]
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    long = [r for r in got.values() if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.9
    odd = spark.createDataFrame([(None, "null id"), (4, None), (4, "b"), (4, "a")], "doc_id long, text string")
    found = {(r["doc_id"], r["n_chars"], r["edited"]) for r in edit_fingerprint.fingerprint_edits(odd).collect()}
    # One of the rows of id 4 is followed by the row without id, which is followed by the first of them.
    assert len(found) == 4 and {(4, 0, ""), (4, 1, "a"), (4, 1, "b")} < found and next(e for i, _, e in found if i is None) in ("null", "nulla", "nullb")
    assert edit_fingerprint.fingerprint_edits(odd.limit(0)).count() == 0
    one = edit_fingerprint.fingerprint_edits(odd.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_code_points_are_told_apart():
    a, b = "".join(chr(0x4E00 + 7 * k) for k in range(300)), "".join(chr(0x4E00 + 7 * k + 255 * 3) for k in range(300))
    x, y = edit_fingerprint.fingerprints([a, b])
    assert x != y and edit_fingerprint.likeness(x, y) < 0.3


def test_rows_of_one_id_are_dealt_to_many_bins(spark):
    """3,000 rows without id and 3,000 of one id among others: no bin holds many, and every row has its next in the order."""
    rows = [(None, f"n{i}") for i in range(3000)] + [(50, f"h{i}") for i in range(3000)] + [(i, f"t{i}") for i in range(100) if i != 50]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = edit_fingerprint.in_order(df, "text", "doc_id").cache()
    assert dealt.where("not ghost").count() == len(rows) and dealt.where("not ghost").groupBy("bin").count().agg(F.max("count")).first()[0] < 600
    order = sorted((r for r in dealt.where("not ghost").collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["__among"], r["__order"], r["__text"]))
    assert [r["bin"] for r in order] == sorted(r["bin"] for r in order)
    want = Counter((a["doc_id"], edit_fingerprint.edited(a["__text"], b["__text"])) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert want == Counter((r["doc_id"], r["edited"]) for r in edit_fingerprint.fingerprint_edits(df.withColumn("edited", F.lit(1))).collect())


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefghijklmnop "), 2000))

    def edit(n):
        x = list(text)
        for k in rng.integers(0, 2000, n):
            x[k] = "Z" if rng.random() < 0.5 else ""
        return "".join(x)

    means = [np.mean([edit_fingerprint.likeness(*edit_fingerprint.fingerprints([text, edit(n)])) for _ in range(6)]) for n in (0, 5, 50, 1500)]
    assert means[0] == 1 and means[0] > means[1] > means[2] > means[3]


def test_every_walk_reaches_the_end(monkeypatch):
    """The last characters of a text are in its fingerprint when all places are sampled, also just under a power of two."""
    monkeypatch.setattr(edit_fingerprint, "SAMPLES", 1 << 20)
    edit_fingerprint.places.cache_clear()
    rng = np.random.default_rng(11)
    for n in (64, 128, 256, 512):
        for k in range(12):
            text = "".join(rng.choice(list("abcdefghijklmnop "), n)) if k % 2 else "abcdefghijkl"[k] * n
            assert len(set(edit_fingerprint.fingerprints([text[:-1] + c for c in "#%&~@"]))) > 1
    edit_fingerprint.places.cache_clear()


def test_near_groups_are_those_of_all_pairs(spark):
    """Every pair that shares a band and is alike lies in one group, and nothing else does."""
    rng = np.random.default_rng(14)
    texts = []
    for k in range(12):
        base = "".join(rng.choice(list("abcdefghijklmnop "), 300 + 40 * k))
        for _ in range(6):
            at = rng.integers(0, len(base), rng.integers(0, 12))
            texts.append("".join("" if i in at else c for i, c in enumerate(base)))
    texts += [texts[0], "", "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = edit_fingerprint.fingerprint_edits(df)
    got = {r["doc_id"]: r["near_id"] for r in edit_fingerprint.near_groups(found).collect()}
    prints = edit_fingerprint.fingerprints([t or "" for t in texts])
    keys = [set(edit_fingerprint.band_keys(p, 16)) if t else set() for p, t in zip(prints, texts, strict=True)]
    parent = list(range(len(texts)))
    for _ in range(len(texts)):
        for a in range(len(texts)):
            for b in range(a):
                if keys[a] & keys[b] and edit_fingerprint.likeness(prints[a], prints[b]) >= 0.75:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert {i: got.get(i, i) for i in range(len(texts))} == dict(enumerate(parent)) and len(set(parent)) < 40


def written(spark, prints):
    rows = [(i, 1000 + i, 500, f"12:{p}") for i, p in prints]
    return spark.createDataFrame(rows, "doc_id long, digest long, n_chars long, fingerprint string").repartition(3)


@pytest.mark.parametrize("unlike", [1, 12])
def test_unlike_documents_of_a_band_hide_no_link(spark, monkeypatch, unlike):
    """Two alike fingerprints behind smaller ids that share their bands and are like nobody."""
    monkeypatch.setattr(edit_fingerprint, "BLOCK", 3)
    rng = np.random.default_rng(21)
    digits = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    head, tail = digits(64), digits(64)
    near = tail[:30] + digits(16) + tail[46:]
    rows = [(k, head + digits(64)) for k in range(1, unlike + 1)] + [(50, head + tail), (60, head + near)]
    assert edit_fingerprint.likeness(f"12:{head}{tail}", f"12:{head}{near}") >= 0.85
    got = {r["doc_id"]: r["near_id"] for r in edit_fingerprint.near_groups(written(spark, rows)).collect()}
    assert got == {50: 50, 60: 50}


def test_groups_of_any_bands(spark, monkeypatch):
    """Random families that share bands with each other, against all pairs that share a band."""
    monkeypatch.setattr(edit_fingerprint, "BLOCK", 4)
    rng = np.random.default_rng(22)
    heads = ["".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(2)]
    rows = []
    for family in range(8):
        base = rng.choice(list("0123456789abcdef"), 96)
        for _ in range(4):
            own = base.copy()
            at = rng.integers(0, 96, 13)
            own[at] = rng.choice(list("0123456789abcdef"), 13)
            rows.append((int(rng.integers(0, 10_000)) * 100 + len(rows), heads[family % 2] + "".join(own)))
    keys = {i: set(edit_fingerprint.band_keys(f"12:{p}", 16)) for i, p in rows}
    parent = {i: i for i, _ in rows}
    for _ in rows:
        for a, x in rows:
            for b, y in rows:
                if keys[a] & keys[b] and edit_fingerprint.likeness(f"12:{x}", f"12:{y}") >= 0.75:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["doc_id"]: r["near_id"] for r in edit_fingerprint.near_groups(written(spark, rows)).collect()}
    assert {i: got.get(i, i) for i in parent} == parent and 1 < len(set(parent.values())) < len(rows)


def test_likeness_to_many():
    rng = np.random.default_rng(23)
    texts = ["", "a", *("".join(rng.choice(list("abcdefgh "), int(n))) for n in rng.integers(1, 900, 40))]
    texts += [t[: len(t) // 2] + "x" + t[len(t) // 2 :] for t in texts[5:20]]
    prints = edit_fingerprint.fingerprints(texts)
    heads = [p.index(":") for p in prints]
    lengths = np.array([len(p) - h - 1 for p, h in zip(prints, heads, strict=True)])
    digits = np.zeros((len(prints), max(1, int(lengths.max()))), np.uint8)
    for k, (p, h) in enumerate(zip(prints, heads, strict=True)):
        digits[k, : lengths[k]] = np.frombuffer(p[h + 1 :].encode(), np.uint8)
    levels = np.array([int(p[:h]) for p, h in zip(prints, heads, strict=True)])
    for one in prints:
        assert np.allclose(edit_fingerprint._likenesses(one, prints, digits, lengths, levels), [edit_fingerprint.likeness(one, p) for p in prints])


def test_near_groups_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, digest long, n_chars long, fingerprint string")
    assert edit_fingerprint.near_groups(none).collect() == []
    assert edit_fingerprint.near_groups(written(spark, [(1, "0" * 64)])).collect() == []


def test_near_pairs(spark):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefghijklmnop "), 400))
    rows = [(1, base), (2, base[:200] + "!" + base[200:]), (3, base), (4, base[::-1])]
    got = {(r["a"], r["b"]): r["edits"] for r in edit_fingerprint.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()}
    assert got == {(1, 2): 1, (1, 3): 0}


def test_near_pairs_loses_none_behind_a_hub(spark, monkeypatch):
    monkeypatch.setattr(edit_fingerprint, "BLOCK", 3)
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("abcdefghijklmnop "), 400))
    texts = [base, *(base[:k] + "!" + base[k:] for k in (40, 150, 260, 370)), base[:100] + base[101:]]
    rows = [*enumerate(texts, 1), (20, texts[2])]
    got = {(r["a"], r["b"]): r["edits"] for r in edit_fingerprint.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert set(got) == {(i, j) for i in range(1, 7) for j in range(i + 1, 7)} | {(3, 20)}
    assert got[1, 2] == 1 and got[2, 3] == 2 and got[3, 20] == 0


def test_near_pairs_across_levels(spark):
    rng = np.random.default_rng(10)
    rows = []
    for n in (128, 171, 256, 342, 512, 683):  # one more character takes the next level
        base = "".join(rng.choice(list("abcdefghijklmnop "), n + 1))
        at = len(rows)
        rows += [(at + k, base[: n - 1 + k]) for k in range(3)]
    got = edit_fingerprint.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 1)
    assert {(r["a"], r["b"]) for r in got.collect()} == {(i, i + 1) for i in range(len(rows)) if i % 3 < 2}


# --- neighbours ---


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 24)).astype(np.float32)
    x[300:340] = x[300]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(1200)] + [(5000, None, 1), (5100, [0.0] * 24, 1), (5200, [float("nan")] * 24, 1), (5300, [1.0] * 3, 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1200, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1200), d))[:10]
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, len(found) + 1)) and q not in [v for _, v, _ in found]
        assert all(s == pytest.approx(d[v], rel=1e-12) for _, v, s in found)
        hit += len(set(want) & {v for _, v, _ in found})
    assert hit / 120 >= 0.9
    assert [v for _, v, _ in got[300]] == list(range(301, 311))
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_every_query_has_its_rows(spark):
    """Queries far from all others get their k nearest too, and small tables all there is."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)) * 0.05 + 3 * rng.normal(size=(3, 16))[rng.integers(0, 3, 900)]
    x[::100] = rng.normal(size=(9, 16)) * 40
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(900)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert {q: len(found) for q, found in got.items()} == dict.fromkeys(range(0, 900, 50), 10)
    for q in range(0, 900, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert [got[q][k] for k in range(1, 11)] == np.argsort(d)[:10].tolist()
    few = ann.nearest(df.where("vec_id < 7"), F.lit(True)).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in few} == dict.fromkeys(range(7), 6)


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 1 << 16, (400, 4)).astype(np.uint16)
    block = ann.Block(codes)
    for radius in (0, 5, 20, 27, 64):
        for q in codes[:5] ^ rng.integers(0, 4, (5, 4)).astype(np.uint16):
            want = np.flatnonzero(ann.COUNTS[codes ^ q].sum(1, dtype=int) <= radius)
            assert block.within(q, radius).tolist() == want.tolist()


# --- pages ---


def page(title, paragraphs, tag="article", extra=""):
    body = "".join(f"<p>{p}" for p in paragraphs)
    return f"<html><head><title>{title}</title><style>x</style></head><body><nav><a href=a>Menu</a></nav><div class='ad'>Buy now</div><{tag}><h1>{title}</h1>{body}{extra}</{tag}><div class=comments><p>{'I hate it ' * 90}</div><footer>foot</footer>"


def test_main_text(spark):
    text = "A sentence that is long enough to be an article &amp; more.  It goes\non &eacute;."
    clean = "A sentence that is long enough to be an article & more. It goes on é."
    rows = [(i, f"http://a.example/{i}", page(f"T{i}", [text] * 4, "div class='post x12'", "<form>f</form><script>var p='<p>';</script>")) for i in range(6)]
    # on its own, the sidebar of this page would win
    rows.append((6, "http://A.example/6", "<body><div class='big'>" + "<p>Side words, many of them, all the same again and again.</p>" * 9 + "</div><div class='post x99'><h1>T</h1><p>Short.</div>"))
    rows += [(7, None, page("N", [text])), (8, "http://b.example/", None), (9, "http://b.example/", ""), (10, "http://b.example/", "just & text"), (10, "http://b.example/", "<ul><li>one<li>two"), (11, "x", "<div>" * 5000 + "deep"), (12, "http://b.example/", '<p a="' * 500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = {}
    for r in html_extract.extract_main(df).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[0] == ["\n".join(["T0", *[clean] * 4])]
    assert got[6] == ["T\nShort."] and got[7] == [f"N\n{clean}"]
    assert got[8] == got[9] == [""] and sorted(got[10]) == ["just & text", "one\ntwo"] and got[11] == ["deep"] and got[12] == [""]
    assert html_extract.extract_main(df.limit(0)).count() == 0


def test_words_of_a_class_never_decide_over_the_article(spark):
    text = "A sentence that is long enough to be an article, said once more. " * 5
    want = text.strip()
    comments = "<section class='comments'>" + "".join(f"<article id='c{i}'><p>I hate it, number {i}.</p></article>" for i in range(9)) + "</section>"
    pages = [
        f"<body><div class='layout no-sidebar'><article class='post has-comments'><p>{text}</p></article></div></body>",
        f"<body><div class='layout-sidebar-right'><main><p>{text}</p></main><div class='sidebar'><p>Side</p></div></div></body>",
        f"<body><form id='aspnetForm'><article><p>{text}</p></article></form></body>",
        f"<body><div class='widget'><div class='text'><p>{text}</p></div></div><nav>Menu</nav></body>",
        f"<body><article><p>{text}</p></article>{comments}<div class='related-posts'><article><p>Other</p></article></div></body>",
        f"<body><main><div class='post'><p>{text}</p></div>{comments}</main></body>",
        "<body><nav>Menu</nav><footer>foot</footer><aside>aside</aside></body>",
    ]
    got = [html_extract.extract(p, html_extract.vote(p)) for p in pages]
    assert got == [want] * 6 + [""]


def test_votes_of_a_host_are_counted(spark):
    """Brute force: the path that most pages of the host name; a page whose own words speak against that path follows it all the same."""
    body = lambda cls, n: f"<body><div class='{cls}'><p>{'Main words of the page. ' * n}</p></div><div class='other'><p>{'Other words here. ' * 5}</p></div></body>"
    pages = [("h.example", body("story", 9))] * 3 + [("h.example", body("big", 9))] * 2 + [("h.example", body("story", 1)), ("i.example", body("big", 4)), ("i.example", body("story", 4))]
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    votes = {}
    for h, p in pages:
        votes.setdefault(h, []).append(html_extract.vote(p))
    want = {h: min(set(v), key=lambda x: (-v.count(x), x)) for h, v in votes.items()}
    found = {r["host"]: r["path"] for r in html_extract.host_paths(df.select(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), "html")).collect()}
    assert found == want == {"h.example": "body>div.story", "i.example": "body>div.big"}
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main(df.union(df.limit(1))).collect()}
    assert got[5] == "Main words of the page." and all(got[i] == html_extract.extract(p, want[h]) for i, (h, p) in enumerate(pages))


def test_deep_paths_stay_apart():
    root = html_extract.Node("body", "body", None, False, False, False)
    ends = []
    for first in ("a", "b"):
        n = root
        for k in range(120):
            n = html_extract.Node("div", html_extract.path_below(n, f"div.{first if k == 0 else 'x'}"), n, False, False, False)
        ends.append(n.path)
    assert ends[0] != ends[1] and max(map(len, ends)) < 400


def test_unequal_sections_are_all_taken(spark):
    def text(k, n):
        return f"Part {k} " + "of the article goes on here. " * (n // 29)

    def sections(sizes, around=("<main>", "</main>"), name="section"):
        return "<body><nav>menu</nav>" + around[0] + "".join(f"<div class='{name}'><p>{text(k, n)}</p></div>" for k, n in enumerate(sizes)) + around[1] + "<footer>end</footer>"

    sizes = [(1000, 300), (1000, 900), (200, 1000, 60), (3000, 58)]
    pages = [sections(s) for s in sizes] + [sections(s, ("", "")) for s in sizes]
    pages.append("<body><div class=content><div class=intro><p>" + text(0, 300) + "</p></div><div class=body><p>" + text(1, 1000) + "</p></div></div>")
    pages.append("<body><div class=content><p>" + text(0, 400) + "</p><div class=body><p>" + text(1, 1000) + "</p></div></div>")
    want = ["\n".join(" ".join(text(k, n).split()) for k, n in enumerate(s)) for s in [*sizes, *sizes, (300, 1000), (400, 1000)]]
    rows = [(i, None, p) for i, p in enumerate(pages)] + [(100 + i, "http://one.example/", p) for i, p in enumerate(pages[:4])]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**dict(enumerate(want)), **{100 + i: want[i] for i in range(4)}}


def test_pages_of_the_table(spark, small):
    import html as h
    import re

    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in Q.op10_html_extract(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", r["html"], re.S)[1]
        want = "\n".join(x for x in (" ".join(h.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)) if x)
        assert got[r["page_id"]] == (want, len(want))


def test_sha_columns(spark, small):
    r = Q.op4_edit_fingerprint(spark, small).first()
    assert len(r["edited_sha256"]) == len(hashlib.sha256(b"").hexdigest())
