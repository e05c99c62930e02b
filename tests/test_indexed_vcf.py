"""Indexed bgzip VCF: windows against a full scan, bytes that are read, both index kinds, and parts written by tasks."""

import gzip
import io
import os
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from phenoloom.sources import bgzf, indexed_vcf, readers

HEADER = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\n"


def line(chrom, pos, ref="A", fill=""):
    return f"{chrom}\t{pos}\tr{pos}{fill}\t{ref}\tG\t.\tPASS\t.\tGT\t0|1"


def packed(records, header=HEADER):
    """(file, index) of (chrom, pos, ref, line)."""
    out = io.BytesIO()
    index = bgzf.write_indexed(out, header.encode(), [(c, p - 1, p - 1 + len(r), t.encode()) for c, p, r, t in records])
    return out.getvalue(), index


class Counting(io.BytesIO):
    bytes_read = 0

    def read(self, n=-1):
        out = super().read(n)
        self.bytes_read += len(out)
        return out


def window(data, index, chrom, start, end):
    file = Counting(data)
    w = indexed_vcf.Window("f", chrom, start, end, bgzf.parse_index(index).chunks(chrom, start, end))
    rows = [p for b in indexed_vcf.window_batches(file, w) for p in b.column(1).to_pylist()]
    return rows, file.bytes_read


def as_csi(index):
    """The same index in the other format, with the least offset of a bin from its first chunk."""
    parsed = bgzf.parse_index(index)
    names = b"".join(n.encode() + b"\0" for n in parsed.sequences)
    aux = struct.pack("<7i", 2, 1, 2, 0, 35, 0, len(names)) + names
    out = [b"CSI\x01", struct.pack("<3i", 14, 5, len(aux)), aux, struct.pack("<i", len(parsed.sequences))]
    for own in parsed.sequences.values():
        out.append(struct.pack("<i", len(own.bins) + 1))
        for b, chunks in own.bins.items():
            out.append(struct.pack("<IQi", b, 0, len(chunks)) + b"".join(struct.pack("<2Q", *c) for c in chunks))
        out.append(struct.pack("<IQi", 37450, 0, 2) + struct.pack("<4Q", 1, 2, 3, 4))
    return gzip.compress(b"".join(out))


def test_text_is_gzip():
    records = [("1", p, "A", line("1", p)) for p in range(1, 30_000, 3)]
    data, _ = packed(records)
    assert gzip.decompress(data).decode() == HEADER + "".join(t + "\n" for *_, t in records)


def test_a_window_reads_its_blocks_only():
    rng = random.Random(3)
    fill = "".join(rng.choices("ACGT0123456789", k=900))
    records = [("7", p, "A", line("7", p, fill=fill[k % 400 :] + str(rng.random()))) for k, p in enumerate(range(500, 20_000_000, 1000))]
    data, index = packed(records)
    rows, read = window(data, index, "7", 5_000_000, 5_100_000)
    assert rows == [p for p in range(500, 20_000_000, 1000) if 5_000_000 < p <= 5_100_000]
    whole = sum(1 for _ in bgzf.members(io.BytesIO(data), 0, len(data)))
    assert whole > 100 and read < len(data) / 50


def test_start_excluded_and_end_included():
    data, index = packed([("2", p, "A", line("2", p)) for p in (10, 20, 20, 30, 16_384, 16_385, 40_000)])
    assert window(data, index, "2", 10, 20)[0] == [20, 20]
    assert window(data, index, "2", 0, 10)[0] == [10]
    assert window(data, index, "2", 30, 16_384)[0] == [16_384]
    assert window(data, index, "2", 16_384, 16_385)[0] == [16_385]
    assert window(data, index, "2", 40_000, 1 << 29)[0] == [] == window(data, index, "3", 0, 100)[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 400_000), st.sampled_from([1, 1, 3, 40_000])), max_size=60), st.integers(0, 400_000), st.integers(0, 200_000), st.booleans(), st.integers(200, 2000))
def test_any_window(rows, start, length, csi, size):
    rows = sorted(rows)
    member = bgzf.MEMBER
    bgzf.MEMBER = size
    try:
        data, index = packed([(str(c), p, "A" * n, line(c, p, fill="z" * (p % 300))) for c, p, n in rows])
    finally:
        bgzf.MEMBER = member
    index = as_csi(index) if csi else index
    for chrom in "123":
        assert window(data, index, chrom, start, start + length)[0] == [p for c, p, _ in rows if str(c) == chrom and start < p <= start + length]


def test_broken_files():
    data, index = packed([("1", p, "A", line("1", p)) for p in range(1, 9000)])
    with pytest.raises(ValueError, match="cut off"):
        window(data[: len(data) // 2], index, "1", 0, 9000)
    with pytest.raises(ValueError, match="not bgzip|no bgzip member"):
        list(bgzf.members(io.BytesIO(gzip.compress(b"x")), 0, 0))
    with pytest.raises(ValueError, match="neither"):
        bgzf.parse_index(gzip.compress(b"nothing"))
    with pytest.raises(ValueError, match="beyond"):
        packed([("1", 1 << 29, "AC", line("1", 1 << 29))])


@pytest.fixture(scope="module")
def lines(spark):
    """Three sequences, one with most records, in no order."""
    k = F.col("id")
    chrom = F.when(k % 10 < 8, "chr1").when(k % 10 == 8, "chr2").otherwise("chrX")
    pos = k * 7919 % 6007 * 4001 + 1
    return spark.range(0, 6007, 1, 5).select(F.concat_ws("\t", chrom, pos.cast("string"), F.concat(F.lit("r"), k.cast("string")), F.lit("A"), F.lit("G"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.lit("0|1")).alias("value"))


def test_written_and_read_by_spark(spark, lines, tmp_path):
    path = f"file:{tmp_path}/v"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        indexed_vcf.write_windows(lines, path, HEADER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(os.listdir(tmp_path / "v"))
    assert len(parts) > 4 and not [p for p in parts if p.startswith("_")] and parts[0] == "part-00000.vcf.gz"
    whole = readers.read_vcf(spark, f"{tmp_path}/v/*.gz").select("chrom", "pos", "id")
    want = readers.vcf_records(lines).select("chrom", "pos", "id")
    assert whole.exceptAll(want).isEmpty() and want.exceptAll(whole).isEmpty()
    found = indexed_vcf.read_windows(spark, path)
    got = readers.vcf_records(found.select("value")).select("chrom", "pos", "id")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    some = indexed_vcf.read_windows(spark, path, "1", 4_000_000, 9_000_000)
    assert some.select("chrom", "pos").exceptAll(want.where("chrom = '1' and pos > 4000000 and pos <= 9000000").select("chrom", "pos")).isEmpty()
    assert some.count() == want.where("chrom = '1' and pos > 4000000 and pos <= 9000000").count() > 0
    with pytest.raises(Exception, match="has files"):
        indexed_vcf.write_windows(lines, path)
    indexed_vcf.write_windows(lines.limit(3), path, overwrite=True)
    assert indexed_vcf.read_windows(spark, path).count() == 3


def test_partitions_are_windows(lines, tmp_path):
    indexed_vcf.write_windows(lines.coalesce(1), str(tmp_path / "v"))
    reader = indexed_vcf.WindowReader({"path": str(tmp_path / "v")})
    spans = {(w.chrom, w.start, w.end) for w in reader.partitions()}
    assert all(end - start <= 5_000_000 and start // 5_000_000 == (end - 1) // 5_000_000 for _, start, end in spans)
    assert {c for c, *_ in spans} == {"chr1", "chr2", "chrX"} and len({s for c, s, _ in spans if c == "chr1"}) == 5
    one = indexed_vcf.WindowReader({"path": str(tmp_path / "v"), "chrom": "X", "start": "5000000", "end": "10000000"}).partitions()
    assert {(w.chrom, w.start, w.end) for w in one} == {("chrX", 5_000_000, 10_000_000)}


def test_filters_choose_windows(spark, lines, tmp_path):
    path = str(tmp_path / "v")
    indexed_vcf.write_windows(lines, path)
    reader = indexed_vcf.PushingReader({"path": path})
    filters = [EqualTo(("chrom",), "2"), GreaterThan(("pos",), 6_000_000), LessThanOrEqual(("pos",), 7_000_000)]
    assert list(reader.pushFilters(filters)) == filters
    assert {(w.chrom, w.start, w.end) for w in reader.partitions()} == {("chr2", 6_000_000, 7_000_000)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = indexed_vcf.read_windows(spark, path).where("chrom = '2' and pos > 6000000 and pos <= 7000000")
        want = readers.vcf_records(lines).where("chrom = '2' and pos > 6000000 and pos <= 7000000")
        assert sorted(r["pos"] for r in found.collect()) == sorted(r["pos"] for r in want.collect()) != []
        assert found.rdd.getNumPartitions() < indexed_vcf.read_windows(spark, path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_empty_and_failed_writes(spark, lines, tmp_path):
    indexed_vcf.write_windows(lines.limit(0), str(tmp_path / "none"), HEADER)
    assert indexed_vcf.read_windows(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        indexed_vcf.write_windows(lines.select(F.when(F.col("value").contains("r77\t"), "no record").otherwise(F.col("value")).alias("value")), str(tmp_path / "bad"))
    assert os.listdir(tmp_path / "bad") == []


def test_missing_index(spark, lines, tmp_path):
    indexed_vcf.write_windows(lines.limit(5), str(tmp_path / "v"))
    for f in os.listdir(tmp_path / "v"):
        if f.endswith(".tbi"):
            os.remove(tmp_path / "v" / f)
    with pytest.raises(Exception, match="index"):
        indexed_vcf.read_windows(spark, str(tmp_path / "v")).count()


@pytest.mark.parametrize("shift", [0, 1 << 29, 5 << 32])
def test_places_beyond_a_tbi(shift):
    """Sequences longer than 2^29 places get a deeper index, which finds the same records and reads no more."""
    places = sorted({1, 5, 16_384, 16_385, 70_000, *range(100_000, 4_000_000, 977)})
    records = [("1", shift + p, "A" * (40_000 if p == 16_385 else 1)) for p in places]
    out = io.BytesIO()
    index = bgzf.write_indexed(out, b"", [(c, p - 1, p - 1 + len(r), line(c, p).encode()) for c, p, r in records], far=True)
    assert bgzf.index_ending(index) == (".tbi" if shift == 0 else ".csi")
    for start, end in ((0, 5), (16_000, 17_000), (50_000, 110_000), (3_000_000, 3_100_000), (0, 4_000_000)):
        rows, read = window(out.getvalue(), index, "1", shift + start, shift + end)
        assert rows == [shift + p for p in places if start < p <= end]
    assert window(out.getvalue(), index, "1", shift + 3_990_000, shift + 4_000_000)[1] <= 2 * bgzf.MEMBER


def test_written_parts_beyond_a_tbi(spark, tmp_path):
    far = [line("chr1", p) for p in (0, 7, 600_000_000, 7_000_000_000)]
    indexed_vcf.write_windows(spark.createDataFrame([(t,) for t in far], "value string").coalesce(1), str(tmp_path / "far"))
    assert any(f.endswith(".csi") for f in os.listdir(tmp_path / "far"))
    found = indexed_vcf.read_windows(spark, str(tmp_path / "far"), "chr1", 599_999_999, 7_000_000_000)
    assert sorted(r["pos"] for r in found.collect()) == [600_000_000, 7_000_000_000]
