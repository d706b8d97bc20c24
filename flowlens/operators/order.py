"""Total order, natural sessions, positions, purges and blocks, without a window over all rows.

Time leads the total order, so positions are ranks inside a second, shifted by the number of rows in earlier
seconds; sessions come from distinct times, cut by day. No session, however long, is one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens import contracts
from flowlens.operators.pieces import ROWS, carried, numbered, with_row_before

DAY = 86_400


def with_record_id(df: DataFrame, column: str = "record_id") -> DataFrame:
    """Zero-based position of each row in its file (files read by Spark only); a reserved name is refused."""
    contracts.forbid_columns(df, [column])
    return df.withColumn(column, F.col("_metadata.row_index"))


def stable_sort(df: DataFrame, keys: tuple[str, ...] = contracts.ORDER) -> DataFrame:
    """A distributed sort by a total order; the schema stays."""
    return contracts.require_schema(df.orderBy(*keys), df)


def natural_sessions(flows: DataFrame, gap: int) -> DataFrame:
    """flows with temporal_session: a new one begins where distinct times lie more than `gap` seconds apart, over all files."""
    times = flows.select("Stime").distinct().withColumn("day", F.floor(F.col("Stime") / DAY))
    own = Window.partitionBy("day").orderBy("Stime")
    days = times.groupBy("day").agg(F.max("Stime").alias("last"))
    days = days.select("day", F.lag("last").over(Window.orderBy("day")).alias("before"))  # a row per day
    cut = times.join(days, "day").withColumn("previous", F.coalesce(F.lag("Stime").over(own), F.col("before")))
    cut = cut.withColumn("new", F.coalesce((F.col("Stime") - F.col("previous") > gap).cast("int"), F.lit(0)))
    ahead = cut.groupBy("day").agg(F.sum("new").alias("new"))
    ahead = ahead.select("day", F.coalesce(F.sum("new").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = cut.withColumn("inside", F.sum("new").over(own)).join(ahead, "day")
    return flows.join(placed.select("Stime", (F.col("ahead") + F.col("inside")).cast("int").alias("temporal_session")), "Stime")


def session_summary(flows: DataFrame) -> DataFrame:
    """Per session: rows, extent, attacks and attack categories."""
    return flows.groupBy("temporal_session").agg(
        F.count("*").alias("n_rows"), F.min("Stime").alias("min_stime"), F.max("Ltime").alias("max_ltime"), F.sum("Binary_Label").cast("bigint").alias("attacks"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("Binary_Label") == 1, F.col("attack_cat")))), "|").alias("categories"),
    )


def positions(flows: DataFrame, name: str = "position") -> DataFrame:
    """Zero-based position in the total order over all rows: ranks inside a second, and sums over the seconds before."""
    first, *rest = contracts.ORDER
    return numbered(flows, name, first, rest).withColumn(name, F.col(name) - 1)


def holdout_splits(flows: DataFrame, width: int) -> DataFrame:
    """flows with split and purged: the last session is the test, the one before the validation, all others train.

    width - 1 rows on each side of every border between sessions are purged, in train too. At least three sessions
    are needed, and none may be as short as width - 1 rows.
    """
    contracts.require_columns(flows, ["temporal_session"])
    sizes = flows.groupBy("temporal_session").agg(F.count("*").alias("n"), F.max("Ltime").alias("max_ltime"), F.min("Stime").alias("min_stime"))
    few = sizes.agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max("temporal_session").alias("last")).first()
    if few["k"] < 3:
        raise contracts.ContractError("at least three sessions are needed")
    if few["least"] <= width - 1:
        raise contracts.ContractError("a session has too few rows for the purge")
    s, last = F.col("temporal_session"), few["last"]
    split = F.when(s == last, "test").when(s == last - 1, "validation").otherwise("train")
    out = positions(flows, "__at")
    # Sessions are contiguous, so a row's rank in its session is its position less the rows before the session.
    before = Window.orderBy("temporal_session").rowsBetween(Window.unboundedPreceding, -1)  # a row per session
    first = sizes.select("temporal_session", F.col("n").alias("__n"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    rank = F.col("__at") - F.col("__first")
    purged = ((rank < width - 1) & (s > 0)) | ((F.col("__n") - 1 - rank < width - 1) & (s < last))
    return out.join(first, "temporal_session").withColumn("split", split).withColumn("purged", purged).drop("__at", "__first", "__n")


def crossing_sessions(flows: DataFrame) -> DataFrame:
    """Neighbouring sessions where the left one ends at or after the start of the right one."""
    s = flows.groupBy("temporal_session").agg(F.max("Ltime").alias("max_ltime"), F.min("Stime").alias("min_stime"))
    before = F.lag("max_ltime").over(Window.orderBy("temporal_session"))  # a row per session
    return s.withColumn("left_end", before).where("left_end >= min_stime").select(F.col("temporal_session").alias("right_session"), "left_end", "min_stime")


def purge_events(flows: DataFrame, width: int) -> DataFrame:
    """Borders between sessions: rows purged on each side and the gap in seconds."""
    s = flows.groupBy("temporal_session").agg(F.max("Ltime").alias("max_ltime"), F.min("Stime").alias("min_stime"))
    by = Window.orderBy("temporal_session")
    return s.select(
        F.lag("temporal_session").over(by).alias("left_session"), F.col("temporal_session").alias("right_session"),
        F.lit(width - 1).alias("rows_each_side"), (F.col("min_stime") - F.lag("max_ltime").over(by)).alias("gap_seconds"),
    ).where("left_session IS NOT NULL")


def partition_summary(splits: DataFrame) -> DataFrame:
    """Per split, purged rows apart: rows, extent, attacks and the windows of `width` its sessions hold."""
    return splits.groupBy(F.when(F.col("purged"), "purged").otherwise(F.col("split")).alias("part")).agg(
        F.count("*").alias("n_rows"), F.min("Stime").alias("min_stime"), F.max("Stime").alias("max_stime"), F.max("Ltime").alias("max_ltime"),
        F.sum("Binary_Label").cast("bigint").alias("attacks"), F.count_distinct("temporal_session").alias("sessions"),
    )


def check_partitions(splits: DataFrame, width: int) -> None:
    """Each split is non-empty, has width rows, both classes, and lies strictly after the one before."""
    rows = {r["part"]: r for r in partition_summary(splits).collect()}
    before = None
    for name in ("train", "validation", "test"):
        r = rows.get(name)
        if r is None or r["n_rows"] < width or r["attacks"] in (0, r["n_rows"]):
            raise contracts.ContractError(f"{name} is empty, too short, or has one class")
        if before is not None and before >= r["min_stime"]:
            raise contracts.ContractError(f"{name} does not begin after the partition before it")
        before = r["max_stime"]


def contiguous_blocks(flows: DataFrame, *extra: str) -> DataFrame:
    """flows with position and block: a new block where the session, the file or an extra column changes in row order."""
    keys = ["temporal_session", "source_file", *extra]
    out = positions(flows).withColumn("piece", F.floor(F.col("position") / ROWS))
    lasts = out.groupBy("piece").agg(F.max_by(F.struct(*keys), "position").alias("last"))
    lasts = lasts.select("piece", F.lag("last").over(Window.orderBy("piece")).alias("__last"))  # a row per piece
    own = Window.partitionBy("piece").orderBy("position")
    before = F.coalesce(F.lag(F.struct(*keys)).over(own), "__last")
    out = out.join(lasts, "piece").withColumn("__new", F.when(F.col("position") == 0, 0).otherwise((~before.eqNullSafe(F.struct(*keys))).cast("int")))
    ahead = carried(out.groupBy("piece").agg(F.sum("__new").alias("n")), [], __ahead=("before", F.sum("n")))
    out = out.withColumn("__inside", F.sum("__new").over(own)).join(ahead, "piece")
    return out.withColumn("block", F.coalesce("__ahead", F.lit(0)) + F.col("__inside")).drop("piece", "__last", "__new", "__inside", "__ahead")


def disorder(rows: DataFrame, by: str = "source_file", order: str = "record_id") -> DataFrame:
    """Per group: rows in input order that lie before the row ahead of them by (Stime, Ltime), and repeated order keys."""
    now = F.struct("Stime", "Ltime")
    seen = with_row_before(rows, F.struct(now.alias("time"), F.col(order).alias("key")), [by], order, "before")
    each = seen.select(by, (now < F.col("before.time")).alias("back"), (F.col(order) == F.col("before.key")).alias("again"))
    return each.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_if("back").alias("out_of_order"), F.count_if("again").alias("repeated"))
