"""Gain curves: as-of intervals between nodes and interpolation in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gain_at(points: DataFrame, nodes: DataFrame, spline: bool = False) -> DataFrame:
    """``points`` (stream, t, ...) with gain_db of ``nodes`` (stream, t, gain_db, slope) at each t.

    Before the first node its gain holds, after the last one that node's, between two the line or the
    cubic through them. Points and nodes are merged by time in one sort of each stream: an as-of
    lookup without a range join, so no point meets more than the two nodes around it. A point at a
    node's time belongs to the interval that ends there. Streams without nodes get 0. Of nodes at one
    time the first by gain and slope counts before, the last after.
    """
    extra = [c for c in points.columns if c not in ("stream", "t")]
    one = points.select("stream", "t", F.lit(0).alias("__k"), *extra, F.lit(None).cast("struct<t:bigint,g:double,s:double>").alias("__n"))
    node = F.struct(F.col("t").cast("bigint").alias("t"), F.col("gain_db").cast("double").alias("g"), F.col("slope").cast("double").alias("s"))
    two = nodes.select("stream", "t", F.lit(1).alias("__k"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra], node.alias("__n"))
    # At equal times points come first, so the node there lies ahead of them and ends their interval.
    order = Window.partitionBy("stream").orderBy("t", "__k", "__n")
    left = F.last("__n", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("__n", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = one.unionByName(two).withColumns({"l": left, "r": right}).where("__k = 0")
    span = F.greatest(F.col("r.t") - F.col("l.t"), F.lit(1)).cast("double")
    x = (F.col("t") - F.col("l.t")) / span
    if spline:
        x2, x3 = x * x, x * x * x
        between = (2.0 * x3 - 3.0 * x2 + 1.0) * F.col("l.g") + (x3 - 2.0 * x2 + x) * span * F.col("l.s") + (-2.0 * x3 + 3.0 * x2) * F.col("r.g") + (x3 - x2) * span * F.col("r.s")
    else:
        between = F.col("l.g") + (F.col("r.g") - F.col("l.g")) * x
    value = F.when(F.col("l").isNull(), F.col("r.g")).when(F.col("r").isNull(), F.col("l.g")).otherwise(between)
    return rows.select("stream", "t", *extra, F.coalesce(value, F.lit(0.0)).alias("gain_db"))
