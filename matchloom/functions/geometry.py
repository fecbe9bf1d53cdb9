"""Geometry, angles, clocks and clamps as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import DESTINATION_ROWS, GOAL_WIDTH, GRID_COLUMNS, GRID_ROWS, PITCH_X, PITCH_Y

EPS = 1e-6


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def at_6(x: Column) -> Column:
    """Half-up at six places by floor, which every engine does alike (round is not)."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row.

    The optimizer copies a projected expression to every place that names it, also into lambdas and pushed filters; a generator of one row stops
    that, at no shuffle.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def distance(x, y, to_x, to_y) -> Column:
    dx, dy = num(x) - num(to_x), num(y) - num(to_y)
    return F.sqrt(dx * dx + dy * dy)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def vector_angle(ax, ay, bx, by) -> Column:
    """Unsigned angle between two vectors, lengths padded by EPS."""
    a = F.sqrt(num(ax) * num(ax) + num(ay) * num(ay)) + F.lit(EPS)
    b = F.sqrt(num(bx) * num(bx) + num(by) * num(by)) + F.lit(EPS)
    return F.acos(clamp((num(ax) * num(bx) + num(ay) * num(by)) / (a * b), -1, 1))


def line_angle(x, y, ax, ay, bx, by) -> Column:
    """Angle at (x, y) between the lines to a and to b."""
    return vector_angle(num(ax) - num(x), num(ay) - num(y), num(bx) - num(x), num(by) - num(y))


def in_corridor(px, py, tx, ty, ox, oy, width: float = 10.0) -> Column:
    """Whether (ox, oy) lies strictly inside the rectangle of this width along p to t."""
    dx, dy = num(tx) - num(px), num(ty) - num(py)
    length = F.sqrt(dx * dx + dy * dy)
    along = ((num(ox) - num(px)) * dx + (num(oy) - num(py)) * dy) / length
    across = ((num(ox) - num(px)) * dy - (num(oy) - num(py)) * dx) / length
    inside = (along > 0) & (along < length) & (F.abs(across) < width / 2)
    return F.when(length < EPS, F.lit(False)).otherwise(inside)


def lane_distance(px, py, tx, ty, ox, oy) -> Column:
    """Distance of o to the segment from p to t."""
    dx, dy = num(tx) - num(px), num(ty) - num(py)
    length = F.sqrt(dx * dx + dy * dy) + F.lit(EPS)
    share = clamp(((num(ox) - num(px)) * dx + (num(oy) - num(py)) * dy) / (length * length), 0, 1)
    return distance(ox, oy, num(px) + share * dx, num(py) + share * dy)


def segment_distance(ax, ay, bx, by, ox, oy) -> Column:
    """Distance of o to the segment from a to b (no padding; a point if both ends meet)."""
    dx, dy = num(bx) - num(ax), num(by) - num(ay)
    square = dx * dx + dy * dy
    share = F.when(square > 0, clamp(((num(ox) - num(ax)) * dx + (num(oy) - num(ay)) * dy) / square, 0, 1)).otherwise(F.lit(0.0))
    return distance(ox, oy, num(ax) + share * dx, num(ay) + share * dy)


def side(ax, ay, bx, by, ox, oy) -> Column:
    return (num(bx) - num(ax)) * (num(oy) - num(ay)) - (num(by) - num(ay)) * (num(ox) - num(ax))


def near_triangle(ax, ay, bx, by, cx, cy, ox, oy, margin: float = 1.0) -> Column:
    """Whether o is inside the triangle or less than ``margin`` from it."""
    s1, s2, s3 = side(ax, ay, bx, by, ox, oy), side(bx, by, cx, cy, ox, oy), side(cx, cy, ax, ay, ox, oy)
    inside = ((s1 >= 0) & (s2 >= 0) & (s3 >= 0)) | ((s1 <= 0) & (s2 <= 0) & (s3 <= 0))
    near = F.least(segment_distance(ax, ay, bx, by, ox, oy), segment_distance(bx, by, cx, cy, ox, oy), segment_distance(cx, cy, ax, ay, ox, oy))
    return inside | (near < margin)


def triangle_area(ax, ay, bx, by, cx, cy) -> Column:
    return F.abs(side(ax, ay, bx, by, cx, cy)) / 2


def goal_side(x, y, ox, oy, goal_x: float = PITCH_X, half: float = GOAL_WIDTH / 2 - 1, margin: float = 1.0) -> Column:
    """Whether o stands in the shot triangle from (x, y) to the goal, grown by ``margin``."""
    low, high = PITCH_Y / 2 - half, PITCH_Y / 2 + half
    return (triangle_area(goal_x, low, goal_x, high, x, y) >= 1e-3) & near_triangle(goal_x, low, goal_x, high, x, y, ox, oy, margin)


def reflect_x(x: Column, away: Column) -> Column:
    return F.when(away, F.lit(PITCH_X) - x).otherwise(x)


def reflect_y(y: Column, away: Column) -> Column:
    return F.when(away, F.lit(PITCH_Y) - y).otherwise(y)


def grid_column(x: Column, columns: int = GRID_COLUMNS) -> Column:
    return F.floor(clamp(x, 0, PITCH_X - 1e-9) / F.lit(PITCH_X) * F.lit(float(columns))).cast("int")


def grid_row(y: Column, rows: int = GRID_ROWS) -> Column:
    """Row from the top: the lowest y has the last row."""
    return (F.lit(rows - 1) - F.floor(clamp(y, 0, PITCH_Y - 1e-9) / F.lit(PITCH_Y) * F.lit(float(rows)))).cast("int")


def grid_cells(columns: int, rows: int = DESTINATION_ROWS) -> Column:
    """Array of (cell, x, y) with the centre of each cell, x fastest."""
    step_x, step_y = PITCH_X / columns, PITCH_Y / rows
    return F.transform(
        F.sequence(F.lit(0), F.lit(columns * rows - 1)),
        lambda i: F.struct(i.alias("cell"), ((i % columns).cast("double") * F.lit(step_x) + F.lit(step_x / 2)).alias("x"), (F.floor(i / columns).cast("double") * F.lit(step_y) + F.lit(step_y / 2)).alias("y")),
    )


def falling(x: Column, low: float, high: float) -> Column:
    """1 at or below ``low``, 0 at or above ``high``, linear in between."""
    return clamp((F.lit(float(high)) - x) / F.lit(float(high - low)), 0, 1)


def rising(x: Column, low: float, high: float) -> Column:
    return clamp((x - F.lit(float(low))) / F.lit(float(high - low)), 0, 1)


def clock(seconds: Column) -> Column:
    """MM:SS.ff; a fraction that rounds up to 1.00 prints as .00 without a carry."""
    whole = F.floor(seconds)
    hundredths = F.bround((seconds - whole) * 100, 0).cast("int") % 100
    return F.format_string("%02d:%02d.%02d", F.floor(whole / 60).cast("int"), (whole % 60).cast("int"), hundredths)


def clock_seconds(text: Column) -> Column:
    parts = F.split(text, ":")
    return parts[0].cast("double") * 60 + parts[1].cast("double")


def centred_x(x: Column) -> Column:
    """Corner-origin x of a centre-origin one."""
    return x + PITCH_X / 2


def centred_y(y: Column) -> Column:
    return y + PITCH_Y / 2


def degrees(x: Column) -> Column:
    return x * F.lit(180.0 / math.pi)
