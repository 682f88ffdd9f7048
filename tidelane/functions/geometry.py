"""Layouts of probe contacts by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of layouts.
LAYOUTS = ("linear", "edge", "staggered", "poly2", "poly3", "poly5", "neurogrid", "twohundred", "double_sided", "neuropixel", "middle_finger")
#: Columns of a poly layout in the order in which sites fill them, in micrometres, and which of them lie half a pitch lower.
POLY = {"poly2": ((0.0, 20.0), (20.0,)), "poly3": ((-18.0, 0.0, 18.0), (0.0,)), "poly5": ((-36.0, -18.0, 0.0, 18.0, 36.0), (-18.0, 18.0))}


def _poly(kind: str, p: Column, n: Column, pitch: float) -> tuple[Column, Column]:
    """Sites that don't fill a last row come first: in the middle column, or with five columns on its two sides in turn. Each column counts down by itself."""
    columns, low = POLY[kind]
    k = len(columns)
    extra = n % k
    q = p - extra
    x = F.element_at(F.array(*map(F.lit, columns)), (F.pmod(q, F.lit(k)) + 1).cast("int"))
    if kind == "poly5":
        odd_x, odd_row = F.when(p % 2 == 0, -18.0).otherwise(18.0), F.floor(p / 2)
        above = F.when(x == -18.0, F.ceil(extra / 2)).when(x == 18.0, F.floor(extra / 2)).otherwise(0)
    else:
        odd_x, odd_row = F.lit(0.0), p
        above = F.when(x == 0.0, extra).otherwise(0)
    x = F.when(q < 0, odd_x).otherwise(x)
    row = F.when(q < 0, odd_row).otherwise(F.floor(q / k) + above)
    drop = F.when(x.isin(*low), -pitch / 2).otherwise(0.0)
    if kind == "poly3":  # its middle column begins higher by the sites that come first
        drop = drop + F.when(x == 0.0, extra * pitch).otherwise(0.0)
    return x, -pitch * row + drop


def layout(spark: SparkSession, kind: str, groups: list[list[int]], pitch: float = 20.0, shank_pitch: float = 200.0, side_sites: int = 12) -> DataFrame:
    """ch, shank, x, y of the channels of each group, from the top down.

    linear, edge: one column. staggered: sites swing out to both sides, farther towards the top. poly2, poly3, poly5: so many columns, filled row
    by row. neurogrid: a slanted line. twohundred: two heights in turn. double_sided: groups in pairs, front and back.
    neuropixel: four columns in a checkerboard. middle_finger: poly2, but for a deep line of its own in the middle group (side_sites: sites of the others).
    """
    kind = kind.lower().replace("-", "_").replace(" ", "")
    kind = {"neuro_pixel": "neuropixel", "middlefinger": "middle_finger", "doublesided": "double_sided"}.get(kind, kind)
    if kind not in LAYOUTS:
        raise ValueError(f"no such layout: {kind}")
    rows = spark.createDataFrame([(i, list(map(int, g))) for i, g in enumerate(groups)], "shank int, chs array<long>")
    rows = rows.select("shank", F.size("chs").alias("n"), F.posexplode("chs").alias("p", "ch"))
    p, n, g = F.col("p"), F.col("n"), F.col("shank")
    step, x, y = F.lit(shank_pitch), F.lit(0.0), -pitch * p
    if kind == "staggered":
        up = n - 1 - p  # from the lowest site
        reach = F.when(up == 0, 0.0).when(up == 1, 8.5).otherwise(17 + 4.0 * (up - 2))
        x = F.when(up % 2 == 1, -reach).otherwise(reach)  # sides in turn from the lowest site, however many there are
    elif kind in POLY:
        x, y = _poly(kind, p, n, pitch)
    elif kind == "neurogrid":
        x, step = (n - 1 - p).cast("double"), F.lit(pitch)
    elif kind == "twohundred":
        y = F.when(p % 2 == 1, shank_pitch).otherwise(0.0)
    elif kind == "double_sided":
        x = F.when(p % 2 == 0, -20.0).otherwise(20.0) + 400.0 * (F.floor(g / 2) + 1) + F.when(g % 2 == 1, 80.0).otherwise(0.0)
        y, step = -pitch * (p + 1), F.lit(0.0)
    elif kind == "neuropixel":
        x = F.element_at(F.array(*map(F.lit, (20.0, 60.0, 0.0, 40.0))), (p % 4 + 1).cast("int")) + shank_pitch
        y = -pitch * (F.floor(p / 2) + 1)
    elif kind == "middle_finger":
        middle = g == len(groups) // 2
        side_x, side_y = _poly("poly2", p, n, pitch)
        lowest = -(side_sites - 1) * pitch / 2 - 35.0 - 1200.0 + 50.0
        up = n - 1 - p
        x = F.when(middle, 10.0).otherwise(side_x)
        y = F.when(middle, lowest + 100.0 * F.least(up, F.lit(12)) + 500.0 * F.greatest(up - 12, F.lit(0))).otherwise(side_y)
    return rows.select("ch", "shank", (g * step + x).cast("double").alias("x"), y.cast("double").alias("y"))
