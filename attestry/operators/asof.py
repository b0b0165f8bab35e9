"""As-of joins: the nearest rows at or below and at or above a value, by a sorted merge that no long series slows down.

Values are cut into buckets of a given width. Within a bucket both sides are merged in order; what lies beyond its borders is carried over from the
nearest bucket that has anything, by a pass over bucket summaries. So the longest sorted run is a bucket's distinct values, and the carry a series' buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def neighbours(wanted: DataFrame, anchors: DataFrame, by: list[str], at: str, width: float) -> DataFrame:
    """Distinct (``by``, ``at``) of ``wanted`` with ``below`` and ``above``: the anchor at that value, or the nearest on either side; null if there is none.

    anchors: ``by``, ``at``, item; one row for each value. Anchors and wanted rows without a value are left out, and so are null keys.
    """
    bucket = F.floor(F.col(at) / width).alias("bucket")
    held = " and ".join(f"`{k}` is not null" for k in (*by, at))
    own = anchors.where(held).select(*by, at, bucket, F.struct(F.col(at).alias("at"), "item").alias("a"))
    asked = wanted.where(held).select(*by, at).distinct().select(*by, at, bucket)

    ends = own.groupBy(*by, "bucket").agg(F.min_by("a", at).alias("low"), F.max_by("a", at).alias("high"))
    marks = asked.select(*by, "bucket").distinct().withColumns({k: F.lit(None).cast(dict(ends.dtypes)[k]) for k in ("low", "high")})
    marks = ends.unionByName(marks).groupBy(*by, "bucket").agg(F.first("low", True).alias("low"), F.first("high", True).alias("high"))
    w = Window.partitionBy(*by).orderBy("bucket")  # a series' buckets
    carry = marks.select(*by, "bucket", F.last("high", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("low", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("later"))

    none = F.lit(None).cast(dict(own.dtypes)["a"]).alias("a")
    rows = own.withColumn("asked", F.lit(False)).unionByName(asked.select(*by, at, "bucket", none, F.lit(True).alias("asked")))
    inside = Window.partitionBy(*by, "bucket")
    upto = inside.orderBy(at, "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = inside.orderBy(F.desc(at), "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"below": F.last("a", True).over(upto), "above": F.last("a", True).over(beyond)}).where("asked")
    return rows.join(carry, [*by, "bucket"]).select(*by, at, F.coalesce("below", "earlier").alias("below"), F.coalesce("above", "later").alias("above"))
