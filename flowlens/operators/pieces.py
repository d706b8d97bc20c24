"""Ordered computations cut into pieces, so that no file, session or block has to fit into one task.

A piece is a stretch of time or of positions. Windows run inside pieces; what crosses a border is carried by a
small table with a row per piece, or by repeating a few rows in the piece that needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a piece of time, and rows of a piece of positions.
HOURS, ROWS = 6 * 3600, 100_000


def time_piece(time: Column, seconds: int = HOURS) -> Column:
    return F.floor(time / seconds)


def carried(pieces: DataFrame, by: list[str], **what: tuple[str, Column]) -> DataFrame:
    """pieces (a row per `by` and piece) with, for each name, an aggregate over the pieces before ("before") or after ("after")."""
    order = Window.partitionBy(*by) if by else Window.partitionBy()
    frames = {"before": order.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1), "after": order.orderBy("piece").rowsBetween(1, Window.unboundedFollowing)}
    return pieces.select(*by, "piece", *(c.over(frames[side]).alias(name) for name, (side, c) in what.items()))


def with_overlap(df: DataFrame, key: Column, size: int, overlap: int) -> DataFrame:
    """df with piece and own: each row in its piece, and those within `overlap` of the next piece there too, as context (own = false)."""
    piece = F.floor(key / size)
    at = F.when(key >= (piece + 1) * size - overlap, F.array(piece, piece + 1)).otherwise(F.array(piece))
    out = df.withColumn("__own", piece).withColumn("piece", F.explode(at))
    return out.withColumn("own", F.col("piece") == F.col("__own")).drop("__own")


def numbered(df: DataFrame, name: str, time: str, order: list[str], lead: list[str] | None = None) -> DataFrame:
    """df with its rows numbered from 1 in the order of `lead`, `time` and `order`.

    Rows are ranked among those of one time only; the rows of earlier times are sums of counts, inside pieces and over them.
    """
    lead = lead or []
    times = df.groupBy(*lead, time).agg(F.count("*").alias("n")).withColumn("piece", time_piece(F.col(time)))
    before = Window.orderBy(*lead, "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row per piece
    ahead = times.groupBy(*lead, "piece").agg(F.sum("n").alias("n")).select(*lead, "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__ahead"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(*lead, "piece").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    times = times.withColumn("__earlier", earlier).join(ahead, [*lead, "piece"]).select(*lead, time, (F.col("__ahead") + F.col("__earlier")).alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy(*lead, time).orderBy(*(order or [time])))
    out = df.withColumn("__inside", inside).join(times, [*lead, time])
    return out.select(*df.columns, (F.col("__ahead") + F.col("__inside")).alias(name))


def with_row_before(df: DataFrame, value: Column, by: list[str], order: str, name: str) -> DataFrame:
    """df with a value of the row before in the order of a column of numbers, per `by`; a piece's first row gets it from the pieces before."""
    out = df.withColumn("piece", F.floor(F.col(order) / ROWS)).withColumn("__v", F.struct(value.alias("x")))
    ahead = carried(out.groupBy(*by, "piece").agg(F.max_by("__v", order).alias("v")), by, __ahead=("before", F.last("v")))
    inside = F.lag("__v").over(Window.partitionBy(*by, "piece").orderBy(order))
    out = out.withColumn("__lag", inside).join(ahead, [*by, "piece"], "left")
    return out.withColumn(name, F.coalesce("__lag", "__ahead")["x"]).drop("piece", "__v", "__lag", "__ahead")
