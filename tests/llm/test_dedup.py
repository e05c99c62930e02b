"""Near duplicates and repeated passages against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
from phenoloom.llm import common as C
from phenoloom.llm import minhash_dedup as M
from phenoloom.llm import substring_dedup as S
from phenoloom.llm.common import WordHashes, shingle_hashes, words_of


def brute(texts):
    """doc_id -> smallest id reachable, over all pairs."""
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    texts, i = {}, 0
    for size, copies, rate in ((60, 8, 0.01), (200, 12, 0.02), (100, 40, 0.03), (400, 5, 0.06), (120, 30, 0.05)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            texts[i] = " ".join(word() if rng.random() < rate else w for w in base)
            i += 1
    passage = [word() for _ in range(60)]
    for _ in range(25):  # share most of their words with each other, but not enough
        texts[i] = " ".join([*(word() for _ in range(20)), *passage])
        i += 1
    for t in ("", "  \n", "a b", "A  B", "a b c d e", "x " * 5000, texts[0], texts[0].upper(), texts[3]):
        texts[i] = t
        i += 1
    order = list(texts.values())
    rng.shuffle(order)
    return dict(enumerate(order))


def test_components_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, node int").repartition(5)
    want, sizes = brute(texts)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in M.near_duplicates(df).collect()}
    assert got == {i: (want[i], sizes[i], want[i] == i) for i in texts}
    stay = sorted(r["doc_id"] for r in M.drop_near_duplicates(df).collect())
    assert stay == sorted(i for i in texts if want[i] == i)


def test_no_broadcast_of_ids_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_IDS", -1)
    texts = {i: t for i, t in corpus(2).items() if i % 2}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, _ = brute(texts)
    assert {r["doc_id"]: r["component_id"] for r in M.near_duplicates(df).collect()} == want
    assert M.drop_near_duplicates(df).count() == sum(want[i] == i for i in want)


def test_nulls_and_repeats(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "a b c d e f"), (None, "only without id"), (3, "A B C D E F")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r["doc_id"]), r["component_id"], r["n_shingles"], r["kept"]) for r in M.near_duplicates(df).collect()), key=str)
    assert got == [("1", 1, 2, True), ("1", 1, 2, True), ("2", 2, 0, True), ("3", 1, 2, False), ("None", 1, 2, False), ("None", None, 1, True)]
    assert sorted(str(r["doc_id"]) for r in M.drop_near_duplicates(df).collect()) == ["1", "2", "None"]
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_unsettled_buckets_are_exact(spark):
    """The prefix filter alone finds every link between nodes with different labels."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 100)
    sets = []
    for _ in range(60):
        keep = base[rng.random(100) < 0.88]
        sets.append(sorted({int(x) for x in keep} | {int(x) for x in rng.integers(0, 1 << 40, 4)}))
    table = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    labels = spark.createDataFrame([(i, i) for i in range(60)], "node long, component long")
    got = {(r["a"], r["b"]) for r in M.confirm(M.unsettled_pairs(table, labels, 75), table, 75).collect()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))}
    assert got == want and 0 < len(want) < 1770


def test_a_family_of_two_thousand_near_copies(spark):
    """Copies of one text with edits of their own, many pairs of them just below the limit."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 40, 60).astype(str)
    texts = []
    for k in range(2000):
        words = base.copy()
        at = rng.random(60) < (0.01 + 0.03 * (k % 3))
        words[at] = [f"e{x}" for x in rng.integers(0, 1 << 40, at.sum())]
        texts.append(" ".join(words))
    known = WordHashes()
    sets = [np.unique(shingle_hashes(known.array(words_of(t)))) for t in texts]
    names = {x: i for i, x in enumerate(np.unique(np.concatenate(sets)))}
    table = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        table[i, [names[x] for x in s]] = 1
    common, sizes = table @ table.T, table.sum(1)
    linked = 100 * common >= 75 * (sizes[:, None] + sizes - common)
    want = np.arange(len(sets))
    while True:
        new = np.where(linked, want[None, :], len(sets)).min(1)
        if (new == want).all():
            break
        want = new
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(df).collect()}
    wrong = sum(got[i] != want[i] for i in range(len(sets)))
    assert len(set(want.tolist())) > 100 and wrong <= 2, wrong  # 0.27 % of the pairs at the very limit share no table


def test_a_round_makes_no_more_rows_than_the_prefixes(spark):
    """Nodes that all share their prefixes and differ in component: one proposal a row, not all pairs."""
    shared = list(range(1, 90))
    table = spark.createDataFrame([(i, sorted([*shared, *range(1000 * i + 1000, 1000 * i + 1005)])) for i in range(300)], "node long, shingles array<long>")
    labels = spark.createDataFrame([(i, i) for i in range(300)], "node long, component long")
    prefix = M.prefixes(table, labels, 75)
    n = M.proposals(prefix, labels, 75).count()
    assert 0 < n <= prefix.count() and n < 300 * 20
    assert M.settle(table, labels, 75).select("component").distinct().count() == 1


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["node"]: r["component"] for r in M.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


# --- passages ---


def repeats(texts, n=50):
    """Words of each document that lie in an exact run of n words of a smaller document."""
    seen, out = {}, {}
    for i in sorted(texts):
        w = words_of(texts[i])
        out[i] = set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if seen.setdefault(key, i) != i:
                out[i] |= set(range(k, k + n))
    return out


def passages_corpus():
    rng = random.Random(9)
    word = lambda: "v%d" % rng.randrange(3000)
    common, long, line = [word() for _ in range(60)], [word() for _ in range(300)], [word() for _ in range(30)]
    texts = {}
    for i in range(60):
        own = [word() for _ in range(rng.randrange(20, 200))]
        if i % 2:
            own += common
        if i % 7 == 0:
            own += long
        own += line  # too short to count
        texts[i] = " ".join(own + [word() for _ in range(15)])
    texts[60] = texts[4]
    texts[61] = " ".join(line * 20)
    texts[62] = ""
    return texts


def test_exact_passages_are_found(spark):
    texts = passages_corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, digest int").repartition(4)
    got = {r["doc_id"]: r for r in S.report(df).collect()}
    want = repeats(texts)
    for i in texts:
        found = {k for s in got[i]["repeated"] for k in range(s["start"], s["end"])}
        assert want[i] <= found
        assert len(found - want[i]) <= 10 * max(1, len(got[i]["repeated"]))
    assert got[1]["n_shared"] >= 60 and got[1]["n_repeated"] == 0 and 1 in got[3]["first_ids"]
    cut = {r["doc_id"]: r["text"] for r in S.cut_repeats(df).collect()}
    assert 60 not in cut and cut[1] == texts[1]
    assert not any(repeats(cut).values())


def linked(texts, n=50):
    """Other documents with an exact run of n words in common, for each document."""
    runs = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, w in ((i, words_of(t)) for i, t in texts.items())}
    return {i: sum(j != i and bool(runs[i] & runs[j]) for j in texts) for i in texts}


def test_links_are_all_holders(spark):
    texts = passages_corpus() | {100 + i: t for i, t in misled_corpus(5).items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = linked(texts)
    assert {r["doc_id"]: r["n_links"] for r in S.report(df).collect()} == want and max(want.values()) > 20


def misled_corpus(seed, quotes=3):
    """Documents 0 to quotes - 1 hold 45 words of a passage that the two last documents hold whole."""
    rng = random.Random(seed)
    word = lambda: "m%d" % rng.randrange(100_000)
    texts = {}
    for case in range(12):
        passage = [word() for _ in range(60)]
        for k in range(quotes + 2):
            part = passage[7:52] if k < quotes else passage
            texts[case * 10 + k] = " ".join([*(word() for _ in range(30)), *part, *(word() for _ in range(30))])
    return texts


def test_short_quotes_hide_no_exact_repeat(spark):
    texts = misled_corpus(4)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: {k for s in r["repeated"] for k in range(s["start"], s["end"])} for r in S.report(df).collect()}
    want = repeats(texts)
    assert sum(map(len, want.values())) == 12 * 60 and all(want[i] <= got[i] for i in texts)
    assert not any(repeats({r["doc_id"]: r["text"] for r in S.cut_repeats(df).collect()}).values())


def test_a_longer_repeat_around_a_shorter_one(spark):
    """Document 0 holds the middle of what 1 and 2 share: the ends are repeats of 1."""
    rng = random.Random(6)
    words = lambda n: ["n%d" % rng.randrange(100_000) for _ in range(n)]
    texts = {}
    for case in range(8):
        shared = words(110)
        for k, part in enumerate((shared[25:85], shared, shared)):
            texts[case * 10 + k] = " ".join([*words(20), *part, *words(20)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = repeats(texts)
    for r in S.report(df).collect():
        assert want[r["doc_id"]] <= {k for s in r["repeated"] for k in range(s["start"], s["end"])}


def common_line_corpus(pairs=100):
    """40 documents share a line of 45 words, too short to count; 100 pairs share an exact passage of 61 words around it."""
    rng = random.Random(17)
    words = lambda n: ["c%d" % rng.randrange(1_000_000) for _ in range(n)]
    line = words(45)
    texts = {i: " ".join([*words(40), *line, *words(40)]) for i in range(40)}
    for k in range(pairs):
        passage = [*words(8), *line, *words(8)]
        for i in (1000 + 2 * k, 1001 + 2 * k):
            texts[i] = " ".join([*words(30), *passage, *words(30)])
    return texts


def test_a_common_line_hides_no_repeat(spark):
    texts = common_line_corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: {k for s in r["repeated"] for k in range(s["start"], s["end"])} for r in S.report(df).collect()}
    want = repeats(texts)
    assert sum(map(bool, want.values())) == 100 and all(want[i] <= got[i] for i in texts)


def edited_corpus(decoys, pairs=60, words_changed=2):
    """Pairs share a passage of 75 words, of which the second document has two changed; `decoys` documents quote 40 words of it first."""
    rng = random.Random(23)
    words = lambda n: ["d%d" % rng.randrange(1_000_000) for _ in range(n)]
    texts, pairs_of = {}, []
    for k in range(pairs):
        passage = words(75)
        for j in range(decoys):
            texts[1000 * k + j] = " ".join([*words(30), *passage[18:58], *words(30)])
        other = passage[:]
        for at in rng.sample(range(8, 67), words_changed):
            other[at] = words(1)[0]
        texts[1000 * k + 500] = " ".join([*words(30), *passage, *words(30)])
        texts[1000 * k + 501] = " ".join([*words(30), *other, *words(30)])
        pairs_of.append(1000 * k + 501)
    return texts, pairs_of


def similar_enough(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
    return 100 * len(x & y) >= 75 * len(x | y)


def test_edited_passages_behind_quotes(spark):
    """Passages at a similarity of 0.75 or more are found also where smaller documents quote a part of them."""
    for decoys in (0, 3):
        texts, later = edited_corpus(decoys)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
        hit = {r["doc_id"]: r["n_repeated"] for r in S.report(df).collect()}
        due = [i for i in later if similar_enough(texts[i - 1].split()[30:105], texts[i].split()[30:105])]
        found = sum(hit[i] >= 50 for i in due)
        assert len(due) > 40 and found >= 0.95 * len(due), (decoys, found, len(due))


def test_copies_repeat_what_their_first_repeats(spark):
    rng = random.Random(5)
    words = lambda n: ["k%d" % rng.randrange(100_000) for _ in range(n)]
    passage = words(60)
    first, second = [" ".join([*words(20), *passage, *words(20)]) for _ in range(2)]
    short = " ".join(words(30))
    rows = [(1, first), (2, second), (3, second), (4, second), (4, second), (5, short), (6, short), (7, "  " + second + "\n")]
    got = {r["doc_id"]: r for r in S.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_repeated"] for i in range(1, 8)] == [0, 60, 100, 100, 0, 0, 100]
    assert [got[i]["component_id"] for i in range(1, 8)] == [1, 1, 1, 1, 5, 6, 1] and [got[i]["n_links"] for i in range(1, 8)] == [4, 4, 4, 4, 0, 0, 4]
    kept = {r["doc_id"] for r in S.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1, 2, 5, 6}


def test_new_roots_leave_out_what_the_other_holds():
    a = np.arange(100, dtype=np.uint64)
    first = np.where(np.arange(100) < 60, 0, -1)  # the other document holds the first 60
    values = S.function_values(a, 0) & ~np.uint64(7)
    root = values[:60].min()
    rows = S.new_roots(a, first, [], np.array([root], np.uint64).view(np.int64), np.array([0]), np.array([99]), 46)
    above = np.sort(values[60:][values[60:] > root])[: S.ROOTS]
    assert rows == [(int(x), 0, 99) for x in above]
    assert S.new_roots(a, first, [(20, 80, 0, 60)], np.array([root], np.uint64).view(np.int64), np.array([0]), np.array([99]), 46) == []


def test_hashes_of_runs():
    words = np.random.default_rng(3).integers(0, 1 << 60, 200).astype(np.uint64)
    words[100:150] = words[20:70]
    runs = S.runs_of_words(words, 50)
    assert len(runs) == 151 and runs[100] == runs[20] and len(np.unique(runs)) == 150 and not len(S.runs_of_words(words[:49], 50))


def test_edited_passages_are_found():
    rng = np.random.default_rng(1)
    words = [str(x) for x in rng.integers(0, 10_000, 200)]
    other = words[:]
    for k in (40, 90, 140):
        other[k] = "changed"
    known = WordHashes()
    a, b = (shingle_hashes(known.array(x)) for x in (words, other))
    assert S.passages(b, S.Owner(a), np.ones(len(b), bool), 46) == [(0, 196, 0, 196)]
    owner = S.Owner(a)
    assert S.matches(b, owner, owner.places(b), np.ones(len(b), bool), 46)[1] == [(141, 196)]


def test_windows_cover_every_subsequence_once():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 1 << 60, 90).astype(np.uint64)
    windows = S.compact_windows(v, 10)
    hits = defaultdict(int)
    for left, root, right in windows:
        for i in range(left, root + 1):
            for j in range(root, right + 1):
                hits[i, j] += 1
                assert v[i : j + 1].min() == v[root]
    assert all(hits[i, j] == 1 for i in range(90) for j in range(i + 9, 90))
    same = shingle_hashes(WordHashes().array(["x"] * 3000))
    assert len(S.windows_of(same, 46, 1)[0]) < 400


def test_windows_of_many_texts_are_those_of_each():
    """Windows end with their text, whatever stands beside it, and are those of the recursion over minima."""

    def recursion(v, least):
        out, todo = [], [(0, len(v))] if len(v) >= least else []
        while todo:
            left, end = todo.pop()
            root = left + int(v[left:end].argmin())
            out.append((left, root, end - 1))
            todo += [(a, b) for a, b in ((left, root), (root + 1, end)) if b - a >= least]
        return sorted(out)

    rng = np.random.default_rng(4)
    texts = [rng.integers(0, kinds, n).astype(np.uint64) for kinds in (3, 1 << 40) for n in (0, 9, 10, 40, 300)]
    assert all(sorted(map(tuple, S.compact_windows(v, least).tolist())) == recursion(v, least) for v in texts for least in (1, 10))
    keys, owners, lefts, rights = S.windows_of_texts(np.concatenate(texts), np.array([len(v) for v in texts]), 10, 2)
    for k, v in enumerate(texts):
        own = owners == k
        assert sorted(zip(keys[own], lefts[own], rights[own])) == sorted(zip(*S.windows_of(v, 10, 2)))
    assert S.least_distinct(np.array([5] * 40 + [7, 9], np.uint64), 2) == [5, 7]


def test_late_rounds_read_only_what_is_left(spark, monkeypatch):
    """Texts of a round come from the round before, not from all documents again."""
    read, texts_of = [], S.texts_of

    def counted(pairs, n, texts):
        read.append((n, texts.count()))
        return texts_of(pairs, n, texts)

    monkeypatch.setattr(S, "texts_of", counted)
    monkeypatch.setattr(S, "FEWER", 1)
    texts, _ = edited_corpus(6)
    S.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    # All texts are read by the first round, for exact repeats and by the first of the later rounds.
    assert [rows for _, rows in read[:3]] == [len(texts)] * 3
    assert all(after[1] <= 2 * before[0] for before, after in zip(read[2:], read[3:])), read


def test_late_rounds_have_few_tasks(spark, monkeypatch):
    """Tables of a round's few rows stand in as many files as the cluster has cores, not as the session has partitions; and
    joins instead of look-ups give the same rows."""
    files, materialise = {}, S.materialise

    def counted(df, name):
        table = materialise(df, name)
        files[name] = max(files.get(name, 0), len(table.inputFiles()))
        return table

    monkeypatch.setattr(S, "materialise", counted)
    texts, _ = edited_corpus(2)
    corpus = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        few = {tuple(r) for r in S.repeated_passages(corpus).collect()}
        assert all(files[name] <= spark.sparkContext.defaultParallelism for name in ("pairs", "blocks", "confirmed", "windows")), files
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    monkeypatch.setattr(S, "BROADCAST_IDS", 0)
    assert few and few == {tuple(r) for r in S.repeated_passages(corpus).collect()}


def test_passages_of_odd_rows(spark):
    rows = [(1, None), (None, "w " * 80), (2, "short"), (5, "w " * 80), (5, "w " * 80), (6, "w " * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_repeated"]) for r in S.report(df).collect())
    assert got == [("1", 0), ("2", 0), ("5", 0), ("5", 0), ("6", 80), ("None", 0)]
    assert S.report(df.limit(0)).count() == 0
    assert sorted(str(r["doc_id"]) for r in S.cut_repeats(df).collect()) == ["1", "2", "5", "5", "None"]


def test_same_rows_as_sql(spark, small):
    from oracle import compare, connect
    from phenoloom.llm import queries as Q

    for name, sql in Q.oracle_sql().items():
        assert compare(Q.queries()[name](spark, small), connect(small), sql) == ""


def test_word_hashes_are_of_words():
    import pyarrow as pa

    texts = ["", "A b\x0bC", " x", " y é", None, "a" * 3_000_000 + " Z", "\x1c q", "z", "\t \n", "ab ba a b"]
    hashes, at = C.word_hashes(pa.array(texts))
    words = [words_of(t) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    of_word = {}
    for word, value in zip([w for ws in words for w in ws], hashes.tolist(), strict=True):
        assert of_word.setdefault(word, value) == value
    assert len(set(of_word.values())) == len(of_word)
    part, _ = C.word_hashes(pa.array(texts).slice(1, 3))
    assert (part == hashes[at[1] : at[4]]).all()
    assert not len(C.word_hashes(pa.array(["", None], pa.string()))[0])


def test_runs_with_shared_roots():
    """Every run of a text finds its roots among the text's windows; a run of another text only where all roots are the same."""
    rng = np.random.default_rng(4)
    a = S.mix64(rng.integers(0, 5000, 900).astype(np.uint64))
    b = np.r_[S.mix64(rng.integers(10_000, 20_000, 300).astype(np.uint64)), a[200:290], S.mix64(rng.integers(30_000, 40_000, 300).astype(np.uint64))]
    keys = S.windows_of(a, 46, 4)[0]
    label, open_ = S.shared_roots(a, keys, 46, 4)
    assert open_.all()
    other, open_ = S.shared_roots(b, keys, 46, 4)
    assert open_[300:345].all() and (other[300:345] == label[200:245]).all()
    assert not open_[:255].any() and not open_[390:].any()
    naive = [min(S.function_values(a, 2)[k : k + 46]) for k in range(len(a) - 45)]
    assert (S.lowest(S.function_values(a, 2), 46) == naive).all()


def test_edited_passages_among_quotes(spark):
    """Passages of 70 words with 0 to 3 changed words, beside 0 to 5 quotes of 45 words that many documents share.

    The module's own matcher on the two documents says whether there is a passage; recall is asked of each kind.
    """
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(10**6)}"
    some = lambda n: [word() for _ in range(n)]
    pool = [some(45) for _ in range(8)]
    texts, pairs = [], []
    for quotes in range(6):
        for changes in range(4):
            for _ in range(20):
                base = some(70)
                for copy in range(2):
                    own = list(base)
                    for at in rng.sample(range(70), changes * copy):
                        own[at] = word()
                    parts = [own, *(list(q) for q in rng.sample(pool, quotes))]
                    rng.shuffle(parts)
                    texts.append(" ".join(w for part in [some(rng.randrange(40)), *parts, some(rng.randrange(40))] for w in [*part, *some(rng.randrange(6))]))
                pairs.append((len(texts) - 2, len(texts) - 1, quotes, changes, set(base)))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    found = {}
    for r in S.repeated_passages(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(8)).collect():
        found.setdefault(r["node"], []).append((r["start"], r["end"]))
    hashes = WordHashes()
    shingles = [shingle_hashes(hashes.array(words_of(t))) for t in texts]
    hit, asked = Counter(), Counter()
    for a, b, quotes, changes, base in pairs:
        later, first = (a, b) if ids[a] > ids[b] else (b, a)
        words = texts[later].split()
        spans = S.passages(shingles[later], S.Owner(shingles[first]), np.ones(len(shingles[later]), bool), 46)
        spans = [(s, e + 4) for s, e, _, _ in spans if sum(w in base for w in words[s : e + 4]) >= 46]
        asked[quotes, changes] += len(spans)
        hit[quotes, changes] += sum(any(min(e, y) - max(s, x) >= 46 for x, y in found.get(ids[later], [])) for s, e in spans)
    assert all(hit[k] >= 0.95 * n for k, n in asked.items()), {k: (hit[k], n) for k, n in asked.items()}
    assert sum(asked.values()) > 300
