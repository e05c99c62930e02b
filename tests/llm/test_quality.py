"""Quality rules: each rule, counts against a plain computation, the SQL, labelled documents and defined cases."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare, connect

from phenoloom.llm import quality as K
from phenoloom.llm import queries as Q

PROSE = "The river runs past the old mill and turns to the east. Nobody has seen it dry, not even in August."


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        (PROSE, None),
        ("Is it so? Yes", None),
        ("a heading without any mark", "punctuation"),
        ("The end. and then nine more words follow without any mark here", "punctuation"),
        ("For&&& the*** old### mill%%% stands still.", "punctuation"),
        ("BUY!! NOW!! OR NEVER!! AGAIN.", "punctuation"),
        ("Costs rose by 5% in the year of the flood.", None),
        ("Home | News | Sport | About.", "navigation"),
        ("Either | or: both sides have been heard at length in the hall today.", None),
        ("Copyright 2020. All Rights Reserved.", "boilerplate"),
        ("Licensed under the Apache License, Version 2.0.", "boilerplate"),
        ("他们来了。", None),
    ],
)
def test_rules_of_a_line(line, rule):
    assert K.broken_rule(line.encode(), line.encode().split()) == rule


def test_phrase_in_a_long_line_is_text():
    line = ("We read on " + "and on " * 20 + "about the terms of use of words in the old books.").encode()
    assert K.broken_rule(line, line.split()) is None


def counts_of(text):
    """The base figures by their definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in K.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)]


@settings(max_examples=200, deadline=None)
@given(st.text("ab .|&\n\té \x85\x1c", max_size=80))
def test_counts_equal_the_definition(text):
    counts, cleaned = K.judge(text)
    assert counts[:5] == counts_of(text)
    kept = [x for x in text.split("\n") if x.encode().split()]
    assert cleaned == "" or set(cleaned.split("\n")) <= set(kept)
    assert sum(counts[5:]) + len(cleaned.encode().split()) == counts[0]


def test_repeated_words_of_many_kinds():
    ids = np.arange(200_000)
    ids[150_000:150_003] = ids[10:13]
    assert K.repeated_words(ids) == 6 and K.repeated_words(np.zeros(5, np.int64)) == 5 and K.repeated_words(ids[:3]) == 0


def test_lines_first_then_documents(spark):
    good = "\n".join(" ".join(f"w{line}x{k}" for k in range(15)) + "." for line in range(4))
    menu = "\n".join(f"a{i} | b{i} | c{i}" for i in range(30))
    rows = spark.createDataFrame([(1, good), (2, good + "\nHome | News | Sport\n" + good), (3, good + "\n" + menu), (4, PROSE)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in K.clean_lines(rows).collect()}
    assert [found[i]["kept"] for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert found[2]["cleaned"] == good and found[2]["base_failed"] and found[2]["lost_navigation"] == 5
    assert not found[3]["base_failed"] and found[3]["cleaned"] == good and found[4]["base_failed"]


def test_defined_cases(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, PROSE, 5), (3, PROSE, 5), (3, PROSE, 5)], "doc_id bigint, text string, n_words int")
    found = K.clean_lines(rows).collect()
    assert len(found) == 5
    empty = [r for r in found if r["doc_id"] in (1, 2)]
    assert all(r["cleaned"] == "" and sum(r[c] for c in K.COUNTS) == 0 and r["base_failed"] and not r["kept"] for r in empty)
    assert [r["n_words"] for r in found if r["doc_id"] == 3] == [21, 21]
    assert K.clean_lines(rows.limit(0)).collect() == []
    with pytest.raises(ValueError, match="n_words"):
        K.clean_lines(rows, keep=("doc_id", "n_words"))


def test_a_very_long_text_is_read_whole():
    counts, cleaned = K.judge("\n".join(f"line {i} is one of very many lines." for i in range(100_000)) + "\nlast one")
    assert counts[0] == 800_002 and counts[-1] == 2 and cleaned.count("\n") == 99_999


def test_labelled_documents(spark):
    """Documents labelled good stay if their base figures do, those labelled bad go."""
    sf = "/root/testdata/sf0.01"
    quality = dict(zip(*(pq.read_table(f"{sf}/labels.parquet")[c].to_pylist() for c in ("doc_id", "quality")), strict=True))
    found = [r for r in Q.queries()["op12_quality_rules"](spark, sf).collect() if r["doc_id"] in quality]
    good = [r["kept"] for r in found if quality[r["doc_id"]] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in found if quality[r["doc_id"]] == 0]
    assert len(good) > 250 and sum(good) >= 0.98 * len(good) and len(bad) > 30 and sum(bad) <= 0.02 * len(bad)


def test_same_rows_as_sql(spark, small):
    name = "op12_quality_rules"
    assert compare(Q.queries()[name](spark, small), connect(small), Q.oracle_sql()[name]) == ""
