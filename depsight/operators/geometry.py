"""Geometry, as relations over (id, x, y) rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsight.operators.cycles import placed

# Fixed values of the picture: natural edge length; of boxes the width of a letter, the margins of a label, the gap between boxes, least width, height of a box
# without dependents and the most that dependents add.
SPRING, LETTER, MARGIN, GAP, LEAST_WIDTH, HEIGHT, MOST_GROWTH = 55.0, 7.2, 12.0, 24.0, 14.0, 20.0, 12.0
# Fixed values of the camera: bounds of the zoom, and the zoom of nothing.
LEAST_ZOOM, MOST_ZOOM, PLAIN_ZOOM = 0.05, 20.0, 1.0


def bbox(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def fit(boxes: DataFrame, width: float, height: float, padding: float) -> DataFrame:
    """Centre and zoom that frame each box in a window of width by height."""
    w, h = F.col("x1") - F.col("x0") + 2 * padding, F.col("y1") - F.col("y0") + 2 * padding
    zoom = F.greatest(F.lit(LEAST_ZOOM), F.least(F.lit(MOST_ZOOM), F.least(width / w, height / h)))
    real = (w > 0) & (h > 0) & F.lit(width > 0 and height > 0)
    rest = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]
    return boxes.select(*rest, F.round((F.col("x0") + F.col("x1")) / 2, 6).alias("cx"), F.round((F.col("y0") + F.col("y1")) / 2, 6).alias("cy"), F.round(F.when(real, zoom).otherwise(PLAIN_ZOOM), 6).alias("zoom"))


def ends(edges: DataFrame, points: DataFrame) -> DataFrame:
    """src, dst, ax, ay, bx, by for edges with both ends placed."""
    a = points.select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = points.select(F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return edges.join(a, "src").join(b, "dst")


def clipped(edges: DataFrame, points: DataFrame, half_width: float, half_height: float) -> DataFrame:
    """src, dst, x, y: where each edge leaves its source's rectangle; its centre for an edge without length."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    far = F.lit(float("inf"))
    t = F.least(F.when(dx == 0, far).otherwise(half_width / F.abs(dx)), F.when(dy == 0, far).otherwise(half_height / F.abs(dy)))
    t = F.when((dx == 0) & (dy == 0), 0.0).otherwise(t)
    return ends(edges, points).select("src", "dst", F.round(F.col("ax") + dx * t, 6).alias("x"), F.round(F.col("ay") + dy * t, 6).alias("y"))


def pick(boxes: DataFrame, x: float, y: float) -> DataFrame:
    """id of the smallest rectangle (x, y, w, h) around a point, the least id of equals; no row if there is none."""
    hit = (2 * F.abs(F.col("x") - x) <= F.col("w")) & (2 * F.abs(F.col("y") - y) <= F.col("h"))
    return boxes.where(hit).agg(F.min_by("id", F.struct(F.col("w") * F.col("h"), "id")).alias("id")).where("id IS NOT NULL")


def to_screen(points: DataFrame, cx: float, cy: float, zoom: float, width: float, height: float) -> DataFrame:
    return points.withColumn("sx", (F.col("x") - cx) * zoom + width / 2).withColumn("sy", (F.col("y") - cy) * zoom + height / 2)


def seeded(nodes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """id, x, y, vx, vy: nodes keep their place and speed of before; new ones go on a spiral in the order of their ids."""
    total = max(1, nodes.count())
    fresh = nodes.select("id") if before is None else nodes.select("id").join(before.select("id"), "id", "left_anti")
    i = F.col("place")
    angle, radius = i * (2 * math.pi) / total, 90.0 + i * 1.5
    new = placed(fresh, ["id"], "place").select("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    return new if before is None else new.unionByName(before.join(nodes.select("id"), "id", "left_semi").select("id", "x", "y", "vx", "vy"))


def spring(labels: DataFrame) -> DataFrame:
    """One row: the edge length that leaves room for the longest label, at least the usual one."""
    return labels.agg(F.greatest(F.lit(SPRING), F.max(F.length("label")) * F.lit(LETTER) + F.lit(MARGIN + GAP)).alias("spring"))


def sizes(nodes: DataFrame) -> DataFrame:
    """id, width, height of each node's box (id, label, dependents): room for its label, and higher the more depend on it."""
    width = F.greatest(F.length("label") * F.lit(LETTER) + F.lit(MARGIN), F.lit(LEAST_WIDTH))
    return nodes.select("id", width.alias("width"), (F.lit(HEIGHT) + F.least(2 * F.sqrt("dependents"), F.lit(MOST_GROWTH))).alias("height"))
