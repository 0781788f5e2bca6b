"""Point tables over the given tables: two lattices of atoms, and small tables that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: DuckDB and Spark read these alike.
ATOMS_2D = """
SELECT p_partkey AS site_id, p_type AS element, CAST(floor(p_partkey / 2000e0) AS INT) + 1 AS refnumber,
       CAST(p_partkey % 40 AS INT) AS cell_x, CAST(CAST(floor(p_partkey / 40e0) AS BIGINT) % 50 AS INT) AS cell_y,
       CAST(p_size AS DOUBLE) AS coeff,
       (p_partkey % 40) / 40e0 AS xav, (CAST(floor(p_partkey / 40e0) AS BIGINT) % 50) / 50e0 AS yav,
       (p_partkey % 40) / 40e0 + (p_size - 25.5e0) * 4e-5 AS x,
       (CAST(floor(p_partkey / 40e0) AS BIGINT) % 50) / 50e0 + (p_retailprice - 950e0) * 2e-5 AS y
FROM part
"""
ATOMS_3D = """
SELECT l_orderkey * 10 + l_linenumber AS site_id, min(l_returnflag) AS element, CAST(l_linenumber AS INT) AS refnumber,
       CAST(l_orderkey % 20 AS INT) AS cell_x, CAST(min(l_partkey) % 20 AS INT) AS cell_y, CAST(min(l_suppkey) % 20 AS INT) AS cell_z, CAST(min(l_quantity) AS DOUBLE) AS coeff,
       (l_orderkey % 20) / 20e0 AS xav, (min(l_partkey) % 20) / 20e0 AS yav, (min(l_suppkey) % 20) / 20e0 AS zav,
       (l_orderkey % 20) / 20e0 + (min(l_discount) - 5e-2) * 2e-2 AS x,
       (min(l_partkey) % 20) / 20e0 + (min(l_tax) - 4e-2) * 2e-2 AS y,
       (min(l_suppkey) % 20) / 20e0 + (min(l_quantity) - 25.5e0) * 4e-5 AS z
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

#: Invented element properties (fixed values): name, z, b.
ELEMENTS = [("economy", 11.0, 0.363), ("large", 17.0, 0.9577), ("medium", 26.0, 0.945), ("promo", 3.0, -0.19), ("small", 8.0, 0.5803), ("standard", 82.0, 0.9405), ("a", 22.0, -0.3438), ("n", 28.0, 1.03), ("r", 41.0, 0.7054)]
#: Invented form factors (fixed values): element, charge, a, b, c. One element has only charge 0.
FORM_FACTORS = [
    ("a", 0, [2.0, 1.5], [10.0, 1.0], 0.25),
    ("a", 2, [2.5, 1.0], [9.0, 1.5], 0.125),
    ("n", 0, [3.0, 0.5], [8.0, 2.0], 0.5),
    ("r", 0, [1.0, 1.0], [12.0, 3.0], 0.75),
    ("r", 1, [1.5, 0.75], [11.0, 2.5], 0.375),
]


def view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def atoms_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part", ATOMS_2D)


def atoms_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "lineitem", ATOMS_3D)


def elements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ELEMENTS, "element string, z double, b double")


def form_factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORM_FACTORS, "element string, charge int, a array<double>, b array<double>, c double")


#: Cells along each axis of the lattices that the views above make, by the number of axes in use.
CELLS = {1: (40,), 2: (40, 50), 3: (20, 20, 20)}


def box_spec(atoms: DataFrame, dims: int, limit: float = 1.0, step: float = 1.0, cells: tuple[int, ...] | None = None) -> DataFrame:
    """One interval specification over a lattice (that of a view, or of so many ``cells``); a lattice has its size however many of its cells hold atoms."""
    row = [1] + [x for n in cells or CELLS[dims] for x in (float(n), limit, step)]
    names = ["spec_id int"] + [f"{k}_{n} double" for k in "hkl"[:dims] for n in ("size", "limit", "step")]
    return atoms.sparkSession.createDataFrame([tuple(row)], ", ".join(names))
