"""Ordered rule cascades: class dictionaries, and the older zone and structure classifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDS = ("broad", "fine", "slope", "depth")


@dataclass(frozen=True)
class ClassEntry:
    """One class: code, name, and lower and upper bounds (None: unbounded)."""

    code: int
    name: str
    broad_lower: float | None = None
    broad_upper: float | None = None
    fine_lower: float | None = None
    fine_upper: float | None = None
    slope_lower: float | None = None
    slope_upper: float | None = None
    depth_lower: float | None = None
    depth_upper: float | None = None


def matches(e: ClassEntry, columns: dict[str, Column], legacy_bounds: bool = False) -> Column:
    """All bounds hold: ``lower <= x < upper``; in the older form two bounds are both open, one is closed."""
    ok = F.lit(True)
    for k in BOUNDS:
        x, lo, hi = columns[k], getattr(e, f"{k}_lower"), getattr(e, f"{k}_upper")
        if legacy_bounds and lo is not None and hi is not None:
            ok = ok & (x > lo) & (x < hi)
        else:
            ok = ok & (F.lit(True) if lo is None else x >= lo)
            ok = ok & (F.lit(True) if hi is None else x <= hi if legacy_bounds else x < hi)
    return ok


def classify(cells: DataFrame, entries: list[ClassEntry], broad: str = "broad", fine: str = "fine", slope: str = "slope", depth: str = "z", out: str = "code", legacy_bounds: bool = False, zone: str | None = None) -> DataFrame:
    """The first class whose bounds hold, 0 for none or where any input is missing; ``zone`` adds its name."""
    if not entries:
        raise ValueError("the dictionary holds no class")
    columns = {"broad": F.col(broad), "fine": F.col(fine), "slope": F.col(slope), "depth": F.col(depth)}
    code = name = F.lit(None)
    for e in reversed(entries):
        hit = matches(e, columns, legacy_bounds)
        code, name = F.when(hit, e.code).otherwise(code), F.when(hit, e.name).otherwise(name)
    missing = columns["broad"].isNull() | columns["fine"].isNull() | columns["slope"].isNull() | columns["depth"].isNull()
    work = cells.withColumn(out, F.when(missing, 0).otherwise(F.coalesce(code, F.lit(0))).cast("int"))
    return work.withColumn(zone, F.when(~missing, name)) if zone else work


def zone_class(cells: DataFrame, position: str, slope: str, deviations: float = 1.0, flat: float = 5.0, out: str = "zone") -> DataFrame:
    """1 crest, 2 depression, 3 flat, 4 slope, by the position index in units of its deviation."""
    s = F.broadcast(cells.agg(F.stddev_pop(position).alias("_sd")))  # one row
    x = F.col(position)
    code = F.when(x >= deviations * F.col("_sd"), 1).when(x <= -deviations * F.col("_sd"), 2).when(F.col(slope) <= flat, 3).otherwise(4)
    return cells.crossJoin(s).withColumn(out, F.when(x.isNotNull() & F.col(slope).isNotNull(), code).cast("int")).drop("_sd")


def structure_class(cells: DataFrame, broad: str, fine: str, slope: str, depth: str, broad_unit: float = 100.0, fine_unit: float = 100.0, gentle: float = 5.0, steep: float = 70.0, shelf: float = -22.0, out: str = "structure") -> DataFrame:
    """Thirteen structures by broad and fine position (in whole units of their deviations), slope and depth.

    With a low, middle or high broad (rows) and fine (columns) position: low 1, 5, 9; middle 2 or 3
    (gentle or not), 6 to 8 or 13, 10 or 11; high 4, 6 to 8 or 13, 12. Middle fine positions above a
    broad depression are 6 or 7 where gentle (below the shelf depth, or not), 8 up to the steep
    angle, 13 beyond. NULL where an input is missing.
    """
    b, f, s, d = F.col(broad), F.col(fine), F.col(slope), F.col(depth)
    side = lambda x, u: F.when(x <= -u, -1).when(x >= u, 1).otherwise(0)
    work = cells.withColumn("_b", side(b, broad_unit)).withColumn("_f", side(f, fine_unit))
    level, detail, flat = F.col("_b"), F.col("_f"), s <= gentle
    low = F.when(level == -1, 1).when(level == 1, 4).when(flat, 2).otherwise(3)
    high = F.when(level == -1, 9).when(level == 1, 12).when(flat, 10).otherwise(11)
    middle = F.when(level == -1, 5).when(flat & (d < shelf), 6).when(flat, 7).when(s <= steep, 8).otherwise(13)
    code = F.when(detail == -1, low).when(detail == 1, high).otherwise(middle)
    there = b.isNotNull() & f.isNotNull() & s.isNotNull() & d.isNotNull()
    return work.withColumn(out, F.when(there, code).cast("int")).drop("_b", "_f")


def class_histogram(cells: DataFrame, code: str = "code") -> DataFrame:
    return cells.groupBy(code).agg(F.count("*").alias("n"))
