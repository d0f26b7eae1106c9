"""Rasters and point tables derived from the star-schema tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalgrid.operators.classify import ClassEntry
from shoalgrid.operators.grid import Shape, shape_of

WIDE = 100
DEPTH = 20011.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(key: str) -> tuple:
    return (F.col(key) / WIDE).cast("int").alias("r"), (F.col(key) % WIDE).cast("int").alias("c")


def depth_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(*_cell("o_orderkey"), (-F.col("o_totalprice") / DEPTH).alias("z"))


def both_grids(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Depth, and backscatter ``k`` with natural gaps; if ``placed``, each order's ``_file`` and ``_row`` as well.

    Doubles are added in the order of the files' rows, as SQL does in one thread: sums of partial sums differ in
    their last bit, which parts equal values and so changes their ranks.
    """
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    order = Window.partitionBy("l_orderkey").orderBy("_file", "_row")
    so_far = F.sum("l_extendedprice").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    back = lines.withColumns({"_sum": so_far, "_next": F.lead("_row").over(order)}).where("_next IS NULL").select("l_orderkey", (F.col("_sum") / 1013.0).alias("k"))
    orders = read(spark, sf_dir, "orders")
    place = ["_file", "_row"] if placed else []
    if placed:
        orders = orders.select("o_orderkey", "o_totalprice", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return orders.join(back, orders["o_orderkey"] == back["l_orderkey"], "left").select(*_cell("o_orderkey"), (-F.col("o_totalprice") / DEPTH).alias("z"), "k", *place)


def shape(cells: DataFrame) -> Shape:
    return shape_of(cells, 1.0)


def points(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        key.alias("id"), (key * 37 % (WIDE + 10) + 0.5).alias("x"), (-(key * 53 % (rows + 5)) - 0.5).alias("y"), F.col("c_mktsegment").alias("class"), "c_nationkey", "c_acctbal",
    )


#: Class dictionary of the flagship query: code, name, then lower and upper bounds of broad and fine position, slope and depth.
DICTIONARY = [
    ClassEntry(1, "Sink", broad_upper=-120, fine_upper=-80),
    ClassEntry(2, "Trough", broad_upper=-120),
    ClassEntry(3, "Summit", broad_lower=120, fine_lower=80, depth_lower=-9),
    ClassEntry(4, "Deep ridge", broad_lower=120, fine_lower=80),
    ClassEntry(5, "Shoulder", broad_lower=120),
    ClassEntry(6, "Wall", slope_lower=62),
    ClassEntry(7, "Shallow plain", -120, 120, -60, 60, slope_upper=25, depth_lower=-6.5),
    ClassEntry(8, "Plain", -120, 120, -60, 60, slope_upper=25),
    ClassEntry(9, "Hollow", fine_upper=-60, slope_upper=62),
    ClassEntry(10, "Knoll", fine_lower=60, slope_upper=62),
    ClassEntry(11, "Ramp", slope_lower=25, slope_upper=62),
]

GRID_SQL = f"g AS (SELECT CAST(o_orderkey // {WIDE} AS INT) AS r, CAST(o_orderkey % {WIDE} AS INT) AS c, -o_totalprice / {DEPTH} AS z FROM orders)"
BOTH_SQL = (
    f"g AS (SELECT CAST(o_orderkey // {WIDE} AS INT) AS r, CAST(o_orderkey % {WIDE} AS INT) AS c, -o_totalprice / {DEPTH} AS z, k FROM orders LEFT JOIN "
    "(SELECT l_orderkey, sum(l_extendedprice) / 1013.0 AS k FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"
)
SIZE_SQL = "n AS (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM g)"
POINTS_SQL = (
    f"p AS (SELECT c_custkey AS id, c_custkey * 37 % {WIDE + 10} + 0.5 AS x, -(c_custkey * 53 % (nr + 5)) - 0.5 AS y, c_mktsegment AS class, c_nationkey, c_acctbal FROM customer, n)"
)
