"""Text files that Spark reads in many splits."""

import pytest

from quartzfield.sources import structures


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_keep_their_numbers(spark, tmp_path, small_splits, end):
    texts = {f"f{n}.txt": [f"line {i} of {n} " + "x" * (i * 7 % 50) if i % 11 else "" for i in range(size)] for n, size in enumerate((1, 300, 5, 777))}
    for name, rows in texts.items():
        (tmp_path / name).write_bytes(end.join(rows).encode() + (end.encode() if name != "f2.txt" else b""))
    got = structures.lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 10
    found = {}
    for r in got.collect():
        found.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.line
    for name, rows in texts.items():
        want = dict(enumerate(rows))
        assert found[name] == {k: v for k, v in want.items() if k < len(found[name])} and len(found[name]) in (len(rows), len(rows) - (rows[-1] == ""))


def test_structure_over_splits(spark, tmp_path, small_splits):
    """The header lies in the first split, atoms in all of them."""
    head = ["Supercell dimensions:\t40", "Cell (Ang/deg):\t8.0", "Element\tX\tXav\tRefNumber\tCoeff"]
    for n in range(2):
        (tmp_path / f"s{n}.f1d").write_text("\n".join(head + [f"Na\t{i / 1000 + n}\t{i / 1000}\t{1 + i % 3}\t{i}.5" for i in range(600)]) + "\n")
    got = structures.read_structure_1d(spark, str(tmp_path)).orderBy("file", "site_id").collect()
    assert [r.site_id for r in got] == list(range(600)) * 2 and all(r.coeff == r.site_id + 0.5 for r in got)
    assert all(abs(r.x - 8 * (r.site_id / 1000 + (i >= 600))) < 1e-9 for i, r in enumerate(got))


def test_values_of_one_axis_are_numbered_through(spark, tmp_path, small_splits):
    (tmp_path / "p.txt").write_text("\n".join(" ".join(str(float(10 * i + k)) for k in range(10)) for i in range(100)) + "\n\n")
    got = structures.read_points(spark, str(tmp_path), 1).orderBy("point_no").collect()
    assert [(r.point_no, r.p) for r in got] == [(i, [float(i)]) for i in range(1000)]
