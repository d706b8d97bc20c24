"""Causal measures over open-closed intervals: flows of the same file completed in (t - W, t]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens import contracts
from flowlens.operators.pieces import HOURS, with_overlap

DISTINCT = {"distinct_src_ips": "srcip", "distinct_dst_ips": "dstip", "distinct_src_ports": "sport", "distinct_dst_ports": "dsport"}
ENTROPY = {"dst_ip_entropy": "dstip", "dst_port_entropy": "dsport"}


def _check(lookbacks: list[int]) -> None:
    if len(set(lookbacks)) != len(lookbacks) or any(not isinstance(w, int) or w < 2 for w in lookbacks):
        raise contracts.ContractError("lookbacks must be distinct integers of at least 2")


def interval_pairs(queries: DataFrame, flows: DataFrame, width: int, time: str = "Ltime") -> DataFrame:
    """Bucketed interval join: queries (source_file, Stime) with the flows of the same file whose time is in (Stime - width, Stime].

    A plain join would compare all pairs of a file. Buckets of `width` seconds make it an equi-join: a query meets
    two buckets at most, so each flow is shuffled once and each query twice.
    """
    contracts.require_columns(flows, ["source_file", time])
    cell = lambda c: F.floor(c / width)
    asked = queries.select("source_file", F.col("Stime").alias("t"))
    asked = asked.withColumn("bucket", F.explode(F.array_distinct(F.array(cell(F.col("t") - width + 1), cell(F.col("t"))))))
    done = flows.withColumn("bucket", cell(F.col(time)))
    return asked.join(done, ["source_file", "bucket"]).where((F.col(time) > F.col("t") - width) & (F.col(time) <= F.col("t")))


def additive_features(queries: DataFrame, flows: DataFrame, lookbacks: list[int]) -> DataFrame:
    """Counts, sums, rates, shares, growth and trend per lookback, without a join.

    Flows are first summed per (file, end second), then queries and sums are united and one RANGE frame per
    measure runs over whole seconds, in pieces of a file's time that repeat the longest lookback before them.
    """
    _check(lookbacks)
    share = lambda c, value, f: F.sum((F.coalesce(f(F.col(c)), F.lit("")) == value).cast("bigint"))
    seconds = flows.groupBy("source_file", F.col("Ltime").alias("s")).agg(
        F.count("*").alias("n"), F.sum(F.col("Spkts") + F.col("Dpkts")).alias("packets"), F.sum(F.col("sbytes") + F.col("dbytes")).alias("bytes"),
        F.sum("dur").alias("dur"), F.sum(F.col("dur") * F.col("dur")).alias("dur2"),
        share("proto", "tcp", F.lower).alias("tcp"), share("proto", "udp", F.lower).alias("udp"),
        share("state", "FIN", F.upper).alias("fin"), share("state", "CON", F.upper).alias("con"), share("state", "INT", F.upper).alias("int"),
    )
    measures = [c for c in seconds.columns if c not in ("source_file", "s")]
    asked = queries.select("source_file", F.col("Stime").alias("s")).distinct().withColumn("asked", F.lit(True))
    both = seconds.withColumn("asked", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    both = both.withColumn("sx", F.col("n") * F.col("s").cast("double"))
    out = with_overlap(both, F.col("s"), max(HOURS, 4 * max(lookbacks)), max(lookbacks))
    by = Window.partitionBy("source_file", "piece").orderBy("s")
    for w in lookbacks:
        frame = by.rangeBetween(-(w - 1), 0)
        for m in [*measures, "sx"]:
            out = out.withColumn(f"{m}_{w}", F.coalesce(F.sum(m).over(frame), F.lit(0)))
        # The newer half is (t - W/2, t]; in whole seconds it starts floor(W/2 - tiny) seconds back.
        out = out.withColumn(f"recent_{w}", F.coalesce(F.sum("n").over(by.rangeBetween(-((w + 1) // 2 - 1), 0)), F.lit(0)))
    out = out.where("asked and own")
    cols = [F.col("source_file"), F.col("s").alias("Stime")]
    for w in lookbacks:
        n, of = F.col(f"n_{w}"), (lambda m, w=w: F.coalesce(F.try_divide(F.col(f"{m}_{w}").cast("double"), F.col(f"n_{w}").cast("double")), F.lit(0.0)))
        mean, old = of("dur"), F.col(f"n_{w}") - F.col(f"recent_{w}")
        sx, sxx = w * (w - 1) / 2, w * (w - 1) * (2 * w - 1) / 6
        x = F.col(f"sx_{w}") - n * (F.col("s") - w + 1)
        named = {
            "completed_flows": n, "total_packets": F.col(f"packets_{w}"), "total_bytes": F.col(f"bytes_{w}"),
            "duration_mean": F.round(mean, 6), "duration_std": F.round(F.sqrt(F.greatest(of("dur2") - mean * mean, F.lit(0.0))), 4),
            "packets_per_second": F.round(F.col(f"packets_{w}") / w, 6), "bytes_per_second": F.round(F.col(f"bytes_{w}") / w, 6),
            "tcp_fraction": F.round(of("tcp"), 6), "udp_fraction": F.round(of("udp"), 6),
            "state_fin_fraction": F.round(of("fin"), 6), "state_con_fraction": F.round(of("con"), 6), "state_int_fraction": F.round(of("int"), 6),
            "flow_rate_growth": F.round((F.col(f"recent_{w}") - old).cast("double") / (old + 1), 6),
            "flow_count_trend": F.round((w * x - sx * n) / (w * sxx - sx * sx), 8),
        }
        cols += [c.alias(f"{k}_{w}s") for k, c in named.items()]
    return out.select(*cols)


def distinct_features(queries: DataFrame, flows: DataFrame, lookbacks: list[int]) -> DataFrame:
    """Exact distinct counts and Shannon entropies (base 2) per lookback; a null key counts as UNKNOWN.

    No join: a flow enters a lookback's window at its end and leaves it W seconds later. Per value, running counts give
    what each such second adds to the number of values and to the sum of c log2 c; running sums of these are the
    measures. The work is linear in the flows, whatever the lookbacks hold; all runs in pieces of a file's time that
    repeat the longest lookback before them, after one shuffle.
    """
    _check(lookbacks)
    columns = list(dict.fromkeys(DISTINCT.values()))
    known = flows.select("source_file", F.col("Ltime").alias("s"), *(F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias(c) for c in columns))
    asked = queries.select("source_file", F.col("Stime").alias("s")).distinct().withColumn("asked", F.lit(True))
    both = known.withColumn("asked", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    both = with_overlap(both, F.col("s"), max(HOURS, 4 * max(lookbacks)), max(lookbacks)).where("own or not asked").repartition("source_file", "piece")
    moves = lambda w: (F.struct(F.lit(w).alias("w"), F.col("s").alias("time"), F.lit(1).alias("d")), F.struct(F.lit(w).alias("w"), (F.col("s") + w).alias("time"), F.lit(-1).alias("d")))
    when = F.when(F.col("asked"), F.array(*(F.struct(F.lit(w).alias("w"), F.col("s").alias("time"), F.lit(0).alias("d")) for w in lookbacks))).otherwise(F.array(*(m for w in lookbacks for m in moves(w))))
    each = both.select("source_file", "piece", "asked", F.inline(when), *columns)
    what = F.when(F.col("asked"), F.array(F.struct(F.lit("").alias("c"), F.lit("").alias("v")))).otherwise(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns)))
    each = each.select("source_file", "piece", "asked", "w", "time", "d", F.inline(what))
    by = ["source_file", "piece", "w"]
    steps = each.groupBy(*by, "c", "v", "time").agg(F.sum("d").alias("d"), F.max("asked").alias("asked"))
    steps = steps.withColumn("n", F.sum("d").over(Window.partitionBy(*by, "c", "v").orderBy("time")))
    weight = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)
    n, old = F.col("n"), F.col("n") - F.col("d")
    of = lambda c, x: F.sum(F.when(F.col("c") == c, x).otherwise(F.lit(0)))
    sums = {name: of(c, (n > 0).cast("long") - (old > 0).cast("long")) for name, c in DISTINCT.items()} | {name: of(c, weight(n) - weight(old)) for name, c in ENTROPY.items()}
    seconds = steps.groupBy(*by, "time").agg(of(columns[0], F.col("d")).alias("n"), *(x.alias(k) for k, x in sums.items()), F.max("asked").alias("asked"))
    sofar = Window.partitionBy(*by).orderBy("time")
    seconds = seconds.select(*by, "time", "asked", *(F.sum(k).over(sofar).alias(k) for k in ("n", *sums))).where("asked")
    total = F.col("n").cast("double")
    shown = {k: F.col(k) for k in DISTINCT} | {k: F.round(F.when(F.col("n") > 0, F.log2(total) - F.col(k) / total).otherwise(0.0), 6) + 0.0 for k in ENTROPY}
    wide = seconds.groupBy("source_file", "piece", F.col("time").alias("Stime")).agg(*(F.max(F.when(F.col("w") == w, x)).alias(f"{k}_{w}s") for w in lookbacks for k, x in shown.items()))
    return wide.drop("piece")


def causal_features(queries: DataFrame, flows: DataFrame, lookbacks: list[int]) -> DataFrame:
    """All 20 measures per lookback; a query without flows gets 0 everywhere. Targets must not come near."""
    contracts.forbid_columns(queries, ["future_attack", "seconds_to_attack", "next_onset", "next_event_id"])
    return additive_features(queries, flows, lookbacks).join(distinct_features(queries, flows, lookbacks), ["source_file", "Stime"])


def attacks_before(queries: DataFrame, flows: DataFrame, width: int) -> DataFrame:
    """Queries with the number of attacks of their file completed in (t - width, t]; one range frame."""
    ends = flows.where("Binary_Label = 1").groupBy("source_file", F.col("Ltime").alias("s")).agg(F.count("*").alias("n"))
    asked = queries.select("source_file", F.col("Stime").alias("s")).distinct().withColumn("asked", F.lit(True))
    both = ends.withColumn("asked", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    both = with_overlap(both, F.col("s"), max(HOURS, 4 * width), width)
    n = F.coalesce(F.sum("n").over(Window.partitionBy("source_file", "piece").orderBy("s").rangeBetween(-(width - 1), 0)), F.lit(0))
    return both.withColumn("prior_attacks", n).where("asked and own").select("source_file", F.col("s").alias("Stime"), "prior_attacks")


def attack_free(queries: DataFrame, flows: DataFrame, width: int) -> DataFrame:
    """Queries without any attack completed in (t - width, t]; one that ended exactly at t - width does not count."""
    return attacks_before(queries, flows, width).where("prior_attacks = 0").drop("prior_attacks")


def prior_attack_share(labels: DataFrame, flows: DataFrame, width: int) -> DataFrame:
    """Per horizon and class: rows, and the share that has an attack in its past `width` seconds."""
    prior = attacks_before(labels, flows, width)
    out = labels.select("source_file", "Stime", "horizon", "future_attack").join(prior, ["source_file", "Stime"])
    return out.groupBy("horizon", "future_attack").agg(F.count("*").alias("n_rows"), F.round(F.avg((F.col("prior_attacks") > 0).cast("double")), 8).alias("share"))
