"""Boxes, places and directions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The angle ranges of directions, in the order in which they are tried.
SECTORS = [
    ("to the left of", -22.5, 22.5),
    ("to the bottom left of", 22.5, 67.5),
    ("below", 67.5, 112.5),
    ("to the bottom right of", 112.5, 157.5),
    ("to the right of", -180.0, -157.5),
    ("to the top right of", -157.5, -112.5),
    ("above", -112.5, -67.5),
    ("to the top left of", -67.5, -22.5),
]
OVERLAP = 15.0


def with_geometry(df: DataFrame) -> DataFrame:
    """Adds cx, cy, width, height and area of the box xmin, ymin, xmax, ymax."""
    return df.withColumns(
        {
            "cx": (F.col("xmin") + F.col("xmax")) / 2,
            "cy": (F.col("ymin") + F.col("ymax")) / 2,
            "width": F.col("xmax") - F.col("xmin"),
            "height": F.col("ymax") - F.col("ymin"),
            "area": (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")),
        }
    )


def corners(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x.alias("xmin"), y.alias("ymin"), (x + w).alias("xmax"), (y + h).alias("ymax")]


def xywh(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> list[Column]:
    return [xmin.alias("x"), ymin.alias("y"), (xmax - xmin).alias("w"), (ymax - ymin).alias("h")]


def box_gap(a: str, b: str) -> Column:
    """Euclidean gap of two boxes whose columns have these prefixes; 0 if they meet."""
    c = F.col
    gap = lambda lo, hi: F.greatest(F.lit(0), c(f"{b}{lo}") - c(f"{a}{hi}"), c(f"{a}{lo}") - c(f"{b}{hi}"))
    dx, dy = gap("xmin", "xmax"), gap("ymin", "ymax")
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def box_inside(a: str, b: str) -> Column:
    """Box a inside box b, edges included."""
    c = F.col
    return (
        (c(f"{a}xmin") >= c(f"{b}xmin")) & (c(f"{a}ymin") >= c(f"{b}ymin"))
        & (c(f"{a}xmax") <= c(f"{b}xmax")) & (c(f"{a}ymax") <= c(f"{b}ymax"))
    )


def centre_inside(a: str, b: str) -> Column:
    """Centroid of a inside box b, edges included."""
    c = F.col
    return c(f"{a}cx").between(c(f"{b}xmin"), c(f"{b}xmax")) & c(f"{a}cy").between(c(f"{b}ymin"), c(f"{b}ymax"))


def contained(a: str, b: str) -> Column:
    """Either box, or either centroid, inside the other's box."""
    return box_inside(a, b) | box_inside(b, a) | centre_inside(a, b) | centre_inside(b, a)


def _third(v: Column, size: Column, names: tuple[str, str, str]) -> Column:
    return F.when(v < size / 3, names[0]).when(v < size * 2 / 3, names[1]).otherwise(names[2])


def _place(vertical: Column, horizontal: Column) -> Column:
    both = (vertical == "center") & (horizontal == "center")
    return F.when(both, "in the center").otherwise(F.concat(F.lit("in the "), vertical, F.lit(" "), horizontal))


def grid_position(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """The cell of a 3 by 3 grid; a centroid on a boundary belongs to the later cell."""
    return _place(_third(cy, h, ("top", "center", "bottom")), _third(cx, w, ("left", "center", "right")))


def _near(v: Column, size: Column, names: tuple[str, str, str], delta: float) -> tuple[Column, Column]:
    """Whether v is near a boundary of thirds, and all names that fit."""
    low, high = F.abs(v - size / 3) < size * delta, F.abs(v - size * 2 / 3) < size * delta
    fits = (
        F.when(low & high, F.array(*map(F.lit, names)))
        .when(low, F.array(F.lit(names[0]), F.lit(names[1])))
        .when(high, F.array(F.lit(names[1]), F.lit(names[2])))
        .otherwise(F.array(_third(v, size, names)))
    )
    return low | high, fits


def possible_positions(cx: Column, cy: Column, w: Column, h: Column, delta: float = 0.10) -> tuple[Column, Column]:
    """(is_borderline, possible_positions): verticals by horizontals within `delta` of a boundary of thirds."""
    near_y, ys = _near(cy, h, ("top", "center", "bottom"), delta)
    near_x, xs = _near(cx, w, ("left", "center", "right"), delta)
    return near_x | near_y, F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: _place(y, x))))


def angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.degrees(F.atan2(ay - by, bx - ax))


def directions(a: Column, sectors: str = "reference") -> tuple[Column, Column, Column]:
    """(is_borderline, direction, second possible direction or null) of an angle, a column of degrees in [-180, 180].

    sectors="reference": nothing covers (157.5, 180], which falls to the bottom right. "eight": it is to the right.
    Within OVERLAP of an edge the direction that shares the edge is possible, too; the outer edges have no neighbour.
    The sector is a number, its neighbours are the numbers beside it; on an edge the one tried first counts.
    """
    if sectors not in ("reference", "eight"):
        raise ValueError(sectors)
    around = {round((low + high) / 90): name for name, low, high in SECTORS if low != -180}  # by multiples of 45 degrees
    last = "to the right of" if sectors == "eight" else "to the bottom right of"
    names = F.array(F.lit("to the right of"), *[F.lit(around[k]) for k in range(-3, 4)], F.lit(last))
    k = F.when(a == -22.5, 0).otherwise((F.ceil((a + 22.5) / 45) - 1).cast("int"))
    low, high = F.when(k == -4, -180.0).otherwise(k * 45 - 22.5), k * 45 + 22.5
    near_low, near_high = a - low < OVERLAP, high - a < OVERLAP
    name = lambda n: F.get(names, n + 4)
    outer = F.lit(sectors == "eight")
    second = (
        F.when(k == 4, F.when(outer & near_low, F.lit("to the bottom right of")))
        .when(near_low & (k > -4), name(k - 1))
        .when(near_high & (k < 3), name(k + 1))
    )
    return F.when(k == 4, outer & near_low).otherwise(near_low | near_high), name(k), second


def group_direction(a: Column) -> Column:
    """One of eight sectors, lower edges included."""
    out = F.when((a >= 157.5) | (a < -157.5), "to the right of")
    for name, low, high in SECTORS:
        if name != "to the right of":
            out = out.when((a >= low) & (a < high), name)
    return out


def crop_window(cx: Column, cy: Column, w: Column, h: Column, fraction: float = 0.5) -> list[Column]:
    """A square around a centroid, a fraction of the shorter side: its part inside the image, and the padding left out."""
    half = F.least(w, h) * fraction / 2
    left, right, top, bottom = ((v).cast("int") for v in (cx - half, cx + half, cy - half, cy + half))
    zero = F.lit(0)
    return [
        F.greatest(zero, left).alias("crop_left"), F.greatest(zero, top).alias("crop_top"),
        F.least(w.cast("int"), right).alias("crop_right"), F.least(h.cast("int"), bottom).alias("crop_bottom"),
        F.greatest(zero, -left).alias("pad_left"), F.greatest(zero, -top).alias("pad_top"),
        F.greatest(zero, right - w.cast("int")).alias("pad_right"), F.greatest(zero, bottom - h.cast("int")).alias("pad_bottom"),
    ]


def tile_xy(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Indices of the web-map tile of a place."""
    n = float(1 << zoom)
    r = F.radians(lat)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / 3.141592653589793) / 2 * n)
    return x, y
