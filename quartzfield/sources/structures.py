"""Structure files as tables: a whole directory in one job, the file as structure key, line numbers as order. Large files are read in splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import numbered

#: Names of the coefficient column in two-dimensional files, in any case (fixed values).
COEFF_NAMES = ("coeff", "ff", "form_factor", "formfactor")


#: Files and splits up to which their list of offsets is broadcast (about 200 bytes each); beyond, Spark chooses the join.
LISTED_SPLITS = 100_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line, words`` of text files, which Spark splits as it does any text: one file may be read by many tasks.

    Within a split the lines keep their order and increasing ids follow it, so a line's number is its place in the split and the lines of the splits before; those are
    counted first, one row for each split. The files must not change in between.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"))
    sizes = raw.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    if len(raw.inputFiles()) + raw.rdd.getNumPartitions() <= LISTED_SPLITS:
        offsets = F.broadcast(offsets)
    numbered_lines = raw.join(offsets, ["file", "_block"]).select("file", (F.col("_id") + F.col("_offset")).alias("line_no"), "line")
    return numbered_lines.withColumn("words", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "))


def _numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda x: x != ""), lambda x: x.cast("double"))


def _after(label: str) -> Column:
    return _numbers(F.max(F.when(F.col("line").contains(label), F.substring_index("line", ":", -1))))


def headers(rows: DataFrame) -> DataFrame:
    """``file, supercell, cell`` from the header lines of one- and two-dimensional files."""
    return rows.groupBy("file").agg(_after("Supercell dimensions").alias("supercell"), _after("Cell (Ang/deg)").alias("cell"))


def _table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    rows = lines(spark, path)
    head = rows.where(F.array_contains("words", "Element")).groupBy("file").agg(F.min("line_no").alias("_head"), F.min_by("words", "line_no").alias("_names"))
    body = rows.join(F.broadcast(head), "file").where((F.col("line_no") > F.col("_head")) & (F.size("words") > 1))
    low = F.transform("_names", F.lower)

    def value(name: str) -> Column:
        at = F.array_position("_names", name).cast("int")
        return F.when(at > 0, F.get("words", at - 1)).otherwise(F.raise_error(F.concat(F.lit(f"no column {name} in "), F.col("file"))).cast("string"))

    found = F.array_max(F.transform(F.array(*map(F.lit, COEFF_NAMES)), lambda c: F.array_position(low, c))).cast("int")
    coeff = F.when(found > 0, F.get("words", found - 1)).cast("double")
    out = body.select("file", (F.col("line_no") - F.col("_head") - 1).cast("bigint").alias("site_id"), value("Element").alias("element"), value("RefNumber").cast("int").alias("refnumber"), *(value(c).cast("double").alias(c.lower()) for c in columns), coeff.alias("coeff"))
    return out.join(F.broadcast(headers(rows)), "file")


def read_structure_1d(spark: SparkSession, path: str) -> DataFrame:
    """``file, site_id, element, refnumber, x, xav, coeff, supercell, cell``: positions are fractions of the box and come out Cartesian."""
    out = _table(spark, path, ["X", "Xav"])
    return out.withColumns({c: F.col(c) * F.col("cell")[0] for c in ("x", "xav")})


def read_structure_2d(spark: SparkSession, path: str) -> DataFrame:
    """As in one dimension with x, y; the cell is a, b, gamma."""
    out = _table(spark, path, ["X", "Y", "Xav", "Yav"])
    a, b, g = (F.col("cell")[i] for i in range(3))
    g = F.radians(g)
    return out.withColumns({"x": F.col("x") * a + F.col("y") * b * F.cos(g), "y": F.col("y") * b * F.sin(g), "xav": F.col("xav") * a + F.col("yav") * b * F.cos(g), "yav": F.col("yav") * b * F.sin(g)})


def read_structure_rmc6f(spark: SparkSession, path: str) -> DataFrame:
    """``file, site_id, element, x, y, z, refnumber, cell_x, cell_y, cell_z, supercell, cell`` of 9- or 10-column files.

    The line ``Atoms:`` must be among the first 151; another number of columns, or a cell without six numbers, is an error.
    """
    rows = lines(spark, path)
    start = rows.groupBy("file").agg(F.min(F.when(F.col("line").contains("Atoms:"), F.col("line_no"))).alias("_start"), _numbers(F.max(F.when(F.lower("line").contains("supercell"), F.substring_index("line", ":", -1)))).alias("supercell"), _numbers(F.max(F.when(F.col("line").startswith("Cell"), F.substring_index("line", ":", -1)))).alias("cell"))
    late = F.raise_error(F.concat(F.lit("no atoms within 151 lines of "), F.col("file"))).cast("int")
    start = start.withColumn("_start", F.when(F.col("_start") < 151, F.col("_start")).otherwise(late)).withColumn("cell", F.when(F.size("cell") == 6, F.col("cell")).otherwise(F.raise_error(F.concat(F.lit("the cell needs six numbers in "), F.col("file"))).cast("array<double>")))
    body = rows.join(F.broadcast(start), "file").where((F.col("line_no") > F.col("_start")) & (F.trim("line") != ""))
    n = F.size("words")
    skip = F.when(n == 10, 1).when(n == 9, 0).otherwise(F.raise_error(F.concat(F.lit("a row of "), n.cast("string"), F.lit(" columns in "), F.col("file"))).cast("int"))

    def at(i: int) -> Column:
        # names its line, so that a filter on a value is not pushed below the one that takes the header away
        return F.when(F.col("line_no") > F.col("_start"), F.get("words", skip + i))

    numbers = {"x": at(2), "y": at(3), "z": at(4)}
    whole = {"refnumber": at(5), "cell_x": at(6), "cell_y": at(7), "cell_z": at(8)}
    return body.select("file", F.get("words", F.lit(0)).cast("bigint").alias("site_id"), F.get("words", F.lit(1)).alias("element"), *(c.cast("double").alias(k) for k, c in numbers.items()), *(c.cast("int").alias(k) for k, c in whole.items()), "supercell", "cell")


def rmc6f_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Header facts of each file: atom types, owner, date."""
    rows = lines(spark, path).where(F.col("line_no") < 151)

    def fact(label: str) -> Column:
        return F.max(F.when(F.lower("line").contains(label), F.trim(F.substring_index("line", ":", -1))))

    return rows.groupBy("file").agg(fact("atom types present").alias("atom_types"), fact("metadata owner").alias("owner"), fact("metadata date").alias("date"))


def read_points(spark: SparkSession, path: str, dims: int, full_list: bool = False) -> DataFrame:
    """``file, point_no, p`` (array). In one dimension the values of all rows are one column, numbered through the file, unless ``full_list``."""
    rows = lines(spark, path).where(F.trim("line") != "").withColumn("v", F.transform(F.filter("words", lambda x: x != ""), lambda x: x.cast("double")))
    if dims == 1 and not full_list:
        values = rows.select("file", "line_no", F.posexplode("v").alias("_k", "x"))
        return numbered(values, ["line_no", "_k"], "point_no", by=["file"]).select("file", "point_no", F.array("x").alias("p"))
    return rows.select("file", F.col("line_no").cast("bigint").alias("point_no"), F.slice("v", 1, dims).alias("p"))


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, value, row_no`` of a matrix of numbers; one row or one column counts through in ``row_no``."""
    rows = lines(spark, path).where(F.trim("line") != "")
    out = rows.select(F.col("line_no").cast("int").alias("i"), F.posexplode("words").alias("j", "value"), F.size("words").alias("_n"))
    return out.select("i", "j", F.col("value").cast("double").alias("value"), (F.col("i").cast("bigint") * F.col("_n") + F.col("j")).alias("row_no"))


def read_reflections(spark: SparkSession, path: str) -> DataFrame:
    """``h, k, l`` under a header line."""
    rows = lines(spark, path).where((F.col("line_no") > 0) & (F.size("words") >= 3))
    return rows.select(*(F.when(F.col("line_no") > 0, F.col("words")[i]).cast("double").alias(a) for i, a in enumerate("hkl")))


def read_form_factors(spark: SparkSession, path: str) -> DataFrame:
    """``element, charge, a, b, c`` from nested JSON element -> charge -> {a, b, c}."""
    kind = "map<string,map<string,struct<a:array<double>,b:array<double>,c:double>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    by = text.select(F.explode("m").alias("element", "_c")).select("element", F.explode("_c").alias("charge", "_p"))
    return by.select(F.lower("element").alias("element"), F.col("charge").cast("int").alias("charge"), "_p.a", "_p.b", "_p.c")


#: Loaders by file type; a user may add one.
LOADERS = {"1d": read_structure_1d, "2d": read_structure_2d, "rmc6f": read_structure_rmc6f}
