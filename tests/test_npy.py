"""NPY and NPZ rows by offset: types, asked rows and columns, bytes that are read, many tasks."""

import io

import numpy as np
import pytest
from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan

from phenoloom.sources import npy


class Counting(io.BytesIO):
    total = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total += len(out)
        return out


@pytest.fixture
def square(tmp_path):
    x = np.arange(3000 * 7, dtype=np.int16).reshape(3000, 7)
    np.save(tmp_path / "x.npy", x)
    return str(tmp_path / "x.npy"), x


def test_all_rows_in_ranges(spark, square):
    path, x = square
    found = npy.read_rows(spark, path, range_bytes=7000)
    assert found.rdd.getNumPartitions() == 6 and found.dtypes == [("file", "string"), ("row", "bigint"), ("values", "array<smallint>")]
    assert [r["values"] for r in found.orderBy("row").collect()] == x.tolist()


def test_asked_rows_and_columns(spark, square):
    path, x = square
    found = npy.read_rows(spark, path, rows=[2999, 5, 6, 7, 5], columns=[6, 0]).orderBy("row").collect()
    assert [(r["row"], r["values"]) for r in found] == [(k, x[k, [6, 0]].tolist()) for k in (5, 6, 7, 2999)]
    for bad in ({"rows": [3000]}, {"columns": [7]}):
        with pytest.raises(Exception, match="not row 3000|no column 7"):
            npy.read_rows(spark, path, **bad).collect()


def test_only_asked_bytes_are_read():
    x = np.arange(200 * 50_000, dtype=np.int32).reshape(200, 50_000)
    out = io.BytesIO()
    np.save(out, x)
    start = len(out.getvalue()) - x.nbytes
    array = npy.Array("f", start, x.dtype.str, x.shape)
    for runs, columns, most in (([(3, 5), (199, 200)], None, 3 * 200_000), ([(7, 9)], [100, 150], 2 * 51 * 4)):
        file = Counting(out.getvalue())
        rows = [v for b in npy.row_batches(file, npy.Runs(array, runs), columns) for v in b.column(2).to_pylist()]
        want = x[[r for a, b in runs for r in range(a, b)]]
        assert np.array_equal(rows, want if columns is None else want[:, columns]) and file.total == most


@pytest.mark.parametrize(("values", "kind"), [(np.array([True, False]), "boolean"), (np.array([1, 255], np.uint8), "smallint"), (np.array([1, 2], ">i8"), "bigint"), (np.array([0.5, np.nan], np.float32), "float"), (np.array(["ä", "bcd"]), "string"), (np.array([b"x", b"yz"]), "string")])
def test_types_of_npz(spark, tmp_path, values, kind):
    np.savez(tmp_path / "a.npz", v=values, w=np.zeros((2, 2)))
    found = npy.read_rows(spark, str(tmp_path / "a.npz"), "v")
    assert dict(found.dtypes)["value"] == kind
    got = [r["value"] for r in found.orderBy("row").collect()]
    want = [v.decode() if isinstance(v, bytes) else v for v in values.tolist()]
    assert got == want or (np.isnan(got[1]) and got[0] == want[0])


def test_what_has_no_offsets(spark, tmp_path):
    np.savez_compressed(tmp_path / "c.npz", v=np.zeros(3))
    np.save(tmp_path / "f.npy", np.asfortranarray(np.zeros((3, 4))))
    np.save(tmp_path / "z.npy", np.zeros((2, 2), complex))
    for name, key, text in (("c.npz", "v", "compressed"), ("c.npz", "w", "not w"), ("f.npy", None, "column order"), ("z.npy", None, "no Spark type"), ("no.npy", None, "no.npy")):
        with pytest.raises(Exception, match=text):
            npy.read_rows(spark, str(tmp_path / name), key).collect()


def test_folder_empty_array_and_filters(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(3):
        np.save(tmp_path / f"d/{k}.npy", np.full((4, 2), k, np.float64))
    found = npy.read_rows(spark, str(tmp_path / "d"), rows=[1])
    assert sorted(r["values"][0] for r in found.collect()) == [0.0, 1.0, 2.0]
    np.save(tmp_path / "e.npy", np.zeros((0, 5), np.int8))
    assert npy.read_rows(spark, str(tmp_path / "e.npy")).collect() == []
    reader = npy.PushingRowReader({}, npy.Array("f", 0, "<f8", (100, 2)), [])
    list(reader.pushFilters([In(("row",), (5, 6, 50, 1000)), GreaterThanOrEqual(("row",), 6), LessThan(("row",), 50)]))
    assert [p.runs for p in reader.partitions()] == [[(6, 7)]]
