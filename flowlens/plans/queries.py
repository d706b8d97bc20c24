"""The engine's queries over the test tables: each applies one or more operators to the flow view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import scalars
from flowlens.operators import audit, clean, history, interval, labels, metrics, models, onset, order, prep, report, scenario, splits, windows
from flowlens.sources import files, sinks
from flowlens.sources.flows import flows, predictions
from flowlens.streaming import flows as streams

LOOKBACKS = (600, 1800, 3600)
HORIZONS = [60, 300, 900, 1800]
GAP, WIDTH, FOLDS, PURGE = 21_600, 5, 3, 5400
FEATURES = ["dur", "sbytes", "dbytes", "Spkts", "Dpkts"]


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.prospective_labels(flows(spark, sf), HORIZONS)


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    return order.natural_sessions(flows(spark, sf), GAP)


def _blocked(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks forced to interleave by taking the user for the file."""
    return order.contiguous_blocks(_sessions(spark, sf).withColumn("source_file", F.concat(F.lit("part-"), (F.col("srcip").cast("long") % 2).cast("string"))))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an alert history."""
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id AS seq", "CASE event_id % 6 WHEN 0 THEN 'Normal Traffic' WHEN 1 THEN 'SYN Flood - High Intensity' WHEN 2 THEN 'BENIGN' WHEN 3 THEN 'normal' WHEN 4 THEN 'SYN Flood - Low Intensity' ELSE concat('Attack ', event_type) END AS prediction",
        "cast(event_id * 7 % 100 AS double) / 100D AS confidence", "concat('model-', cast(user_id % 3 AS string)) AS model", "ts AS timestamp",
    )


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as scenario samples."""
    return spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string), '-', cast(l_suppkey AS string)) AS sample_id", "l_returnflag AS traffic_group",
        "l_quantity * 4 AS syn_flag_count", "cast(l_partkey % 20 AS double) AS ack_flag_count", "l_extendedprice / 200 AS flow_packets_s", "cast(l_orderkey % 10000 AS double) AS flow_duration_ms",
        "0.7D + l_tax * 3 AS same_srv_rate", "l_quantity * 6 AS total_fwd_packets", "cast(l_suppkey % 90 AS double) AS total_bwd_packets", "cast(l_returnflag <> 'N' AS int) AS Binary_Label",
    )


# Onsets and runs


def attack_run_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return onset.run_catalog(flows(spark, sf))


def attack_categories(spark: SparkSession, sf: str) -> DataFrame:
    return onset.run_categories(flows(spark, sf))


def onset_diagnostics_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return onset.onset_diagnostics(flows(spark, sf))


def event_span_summary(spark: SparkSession, sf: str) -> DataFrame:
    return onset.five_numbers(onset.run_catalog(flows(spark, sf)), "span_seconds", "confirmed_onset")


def raw_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return onset.raw_transitions(flows(spark, sf))


def backward_steps(spark: SparkSession, sf: str) -> DataFrame:
    shuffled = flows(spark, sf).withColumn("record_id", (F.col("record_id") * 7919) % 10007 * 1_000_000 + F.col("record_id"))
    return onset.backward_steps(shuffled)


def instants(spark: SparkSession, sf: str) -> DataFrame:
    return onset.instants(flows(spark, sf))


# Audit


def temporal_audit_profile(spark: SparkSession, sf: str) -> DataFrame:
    return audit.profile(flows(spark, sf))


def per_file_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.per_file(flows(spark, sf))


def label_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return audit.histogram(flows(spark, sf), "Binary_Label")


def category_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return audit.histogram(flows(spark, sf), "attack_cat")


def audit_readiness(spark: SparkSession, sf: str) -> DataFrame:
    return audit.readiness(flows(spark, sf))


# Labels


def prospective_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).drop("next_event_id")


def label_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_diagnostics(_labels(spark, sf))


def label_examples(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_examples(_labels(spark, sf))


def derived_onsets(spark: SparkSession, sf: str) -> DataFrame:
    return labels.derived_onsets(flows(spark, sf))


def catalog_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels from an explicit onset catalog instead of the derived onsets."""
    f = flows(spark, sf)
    return labels.prospective_labels(f, [300], onset.run_catalog(f).where("confirmed_onset").select("event_id", "source_file", "onset_stime"))


# Causal windows


def _causal(width: int):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        f = flows(spark, sf)
        return interval.causal_features(f.select("source_file", "Stime").distinct(), f, [width])

    return query


causal_window_features_600, causal_window_features_1800, causal_window_features_3600 = map(_causal, LOOKBACKS)


def prior_attack_share(spark: SparkSession, sf: str) -> DataFrame:
    return interval.prior_attack_share(_labels(spark, sf), flows(spark, sf), 1800)


def attack_free_history(spark: SparkSession, sf: str) -> DataFrame:
    f = flows(spark, sf)
    return interval.attack_free(f.select("source_file", "Stime").distinct(), f, 600)


def precursor_ranking(spark: SparkSession, sf: str) -> DataFrame:
    f, lab = flows(spark, sf), _labels(spark, sf)
    feats = interval.additive_features(lab, f, [1800])
    cols = [c for c in feats.columns if c.split("_1800s")[0] in ("completed_flows", "total_bytes", "duration_mean", "tcp_fraction", "flow_rate_growth")]
    return metrics.precursor_ranking(lab.join(feats, ["source_file", "Stime"]), cols)


# Sessions, splits, folds


def natural_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf).select("record_id", "temporal_session")


def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    return order.session_summary(_sessions(spark, sf))


def session_holdout_purged(spark: SparkSession, sf: str) -> DataFrame:
    return order.holdout_splits(_sessions(spark, sf), WIDTH).select("record_id", "temporal_session", "split", "purged")


def partition_summary(spark: SparkSession, sf: str) -> DataFrame:
    return order.partition_summary(order.holdout_splits(_sessions(spark, sf), WIDTH))


def purge_events(spark: SparkSession, sf: str) -> DataFrame:
    return order.purge_events(_sessions(spark, sf), WIDTH)


def _folds(spark: SparkSession, sf: str) -> DataFrame:
    rows = order.positions(_sessions(spark, sf))
    return splits.expanding_folds(splits.purged_blocks(rows, splits.fold_boundaries(rows, FOLDS), WIDTH), FOLDS)


def expanding_folds(spark: SparkSession, sf: str) -> DataFrame:
    return _folds(spark, sf).select("record_id", "development_block", "fold", "role")


def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    return splits.fold_summary(_folds(spark, sf))


def _anchored(spark: SparkSession, sf: str) -> DataFrame:
    return splits.event_anchored_split(_labels(spark, sf), PURGE, least=3600 + max(HORIZONS))


def event_anchored_split(spark: SparkSession, sf: str) -> DataFrame:
    return _anchored(spark, sf).select("source_file", "Stime", "horizon", "split")


def split_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_diagnostics(_anchored(spark, sf))


def viable_horizons(spark: SparkSession, sf: str) -> DataFrame:
    return splits.viable_horizons(_anchored(spark, sf))


# Windows of rows


def window_manifest(spark: SparkSession, sf: str) -> DataFrame:
    m = windows.window_manifest(_blocked(spark, sf), WIDTH)
    return windows.window_columns(m, WIDTH)


def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    return windows.window_counts(_blocked(spark, sf), WIDTH, 2, "block")


def realized_window_means(spark: SparkSession, sf: str) -> DataFrame:
    return windows.window_means(_blocked(spark, sf), ["dur", "sbytes"], WIDTH)


def realized_windows_flat(spark: SparkSession, sf: str) -> DataFrame:
    w = windows.realized_windows(_blocked(spark, sf), ["sbytes", "Spkts"], WIDTH)
    return w.select("block", "target_record_id", "target_label", F.array_join("flat", ",").alias("flat"))


# Cleaning and preprocessing


def dedupe_clean(spark: SparkSession, sf: str) -> DataFrame:
    raw = flows(spark, sf).selectExpr("concat(' ', attack_cat, ' ') AS attack_cat", "Binary_Label AS label", "proto", "state", "CASE WHEN record_id % 3 = 0 THEN cast(record_id % 5 AS int) END AS is_ftp_login")
    return clean.clean_flows(raw)


def normalize_category(spark: SparkSession, sf: str) -> DataFrame:
    raw = flows(spark, sf).selectExpr("record_id", "CASE record_id % 5 WHEN 0 THEN ' Fuzzers ' WHEN 1 THEN 'Backdoors' WHEN 2 THEN 'None' WHEN 3 THEN NULL ELSE attack_cat END AS c")
    return raw.select("record_id", scalars.category(F.col("c")).alias("category"))


def null_inf_fill(spark: SparkSession, sf: str) -> DataFrame:
    raw = flows(spark, sf).selectExpr("record_id", "CASE record_id % 4 WHEN 0 THEN double('inf') WHEN 1 THEN double('nan') WHEN 2 THEN NULL ELSE dur END AS dur", "CASE WHEN record_id % 3 = 0 THEN NULL ELSE sbytes END AS sbytes", "state")
    return clean.fill_invalid(raw)


def hex_coercion(spark: SparkSession, sf: str) -> DataFrame:
    return clean.numbers(flows(spark, sf).select("record_id", "sport"), ["sport"])


def cleaned_names(spark: SparkSession, sf: str) -> DataFrame:
    raw = flows(spark, sf).select(F.col("record_id").alias(" record id"), F.col("dur").alias("flow-dur/s "), F.col("dur").alias("dur duplicated"))
    return clean.clean_names(clean.drop_repeated_columns(raw))


def _train(spark: SparkSession, sf: str) -> DataFrame:
    return order.holdout_splits(_sessions(spark, sf), WIDTH).where("split = 'train' and not purged")


def _raw(df: DataFrame) -> DataFrame:
    return df.select("record_id", "split", "Binary_Label", "proto", "state", "service", "dur", (F.col("sbytes") * 1000).alias("sbytes"), "Spkts", "sport")


def robust_scaled(spark: SparkSession, sf: str) -> DataFrame:
    rows = _raw(_train(spark, sf))
    p = prep.Preprocessor().fit(rows, ["dur", "sbytes", "Spkts", "sport"])
    return p.transform(rows).select("record_id", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("dur", "sbytes", "Spkts", "sport")))


def onehot_service(spark: SparkSession, sf: str) -> DataFrame:
    rows = _raw(_train(spark, sf))
    out = prep.Preprocessor(("service",)).fit(rows, ["dur"]).transform(rows)
    return out.select("record_id", *(F.col(c).cast("int").alias(c.replace("-", "dash")) for c in ("service___MISSING__", "service_-", "service_dns", "service_http")))


# Metrics


def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.binary_metrics(predictions(spark, sf), "source_file")


def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.roc_auc(predictions(spark, sf), "source_file")


def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.average_precision(predictions(spark, sf), "source_file")


def metrics_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.by_type(predictions(spark, sf))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of six configurations over three folds: thresholds stand for algorithms and variants."""
    p = predictions(spark, sf)
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("algorithm"), F.lit(v).alias("variant"), F.lit(t).alias("t"), F.lit(k).alias("feature_count")) for a, v, t, k in GRID)))
    p = p.withColumn("g", grid).select("*", "g.*").withColumn("y_pred", (F.col("y_score") >= F.col("t")).cast("int"))
    p = p.where("not (algorithm = 'lstm' and variant = 'top_10' and fold = 2)")  # an unfinished configuration
    return metrics.fold_metrics(p, "algorithm", "variant", "feature_count", "fold")


GRID = [("tree", "all", 0.5, 204), ("tree", "top_10", 0.4, 10), ("forest", "all", 0.45, 204), ("forest", "top_10", 0.35, 10), ("lstm", "all", 0.3, 204), ("lstm", "top_10", 0.6, 10)]


def fold_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.leaderboard(_results(spark, sf), [0, 1, 2])


def winner_selection(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.winners(metrics.leaderboard(_results(spark, sf), [0, 1, 2])).select("algorithm", "variant", "f1_mean", "fpr_mean", "features_max")


def development_vs_test(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf)
    return report.development_vs_test(metrics.leaderboard(r, [0, 1, 2]), r.where("fold = 0"))


# Scenarios and history


def heuristic_score(spark: SparkSession, sf: str) -> DataFrame:
    return scenario.scored(_samples(spark, sf)).select("sample_id", "prediction", "confidence", "severity", F.array_join("triggered", "|").alias("triggered"), "correct")


def scenario_groups(spark: SparkSession, sf: str) -> DataFrame:
    return scenario.group_summary(scenario.scored(_samples(spark, sf)))


def scenario_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scenario.summary(scenario.scored(_samples(spark, sf)))


def severity_three_rules(spark: SparkSession, sf: str) -> DataFrame:
    return history.with_severities(_history(spark, sf)).select("seq", "severity_scenario", "severity_dashboard", "severity_mail")


def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return history.severity_counts(_history(spark, sf))


def ranked_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.ranked(_history(spark, sf)).select("seq", "prediction", "confidence", "rank")


def newest_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.newest(history.without_model(_history(spark, sf), "model-1"), history.AUTOLOAD).select("seq", "prediction", "model")


def threat_types(spark: SparkSession, sf: str) -> DataFrame:
    return history.threat_types(_history(spark, sf))


def most_recent_prediction(spark: SparkSession, sf: str) -> DataFrame:
    return history.most_recent(_history(spark, sf)).select("prediction", "confidence")


def decided_history(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf).withColumn("timestamp", F.col("seq").cast("string")).withColumn("source_prediction", F.lit(None).cast("string"))
    d = h.where("seq % 9 = 0").select(scalars.alert_id(F.col("timestamp"), F.col("prediction"), F.col("prediction"), F.col("model")).alias("alert_id"), F.lit("resolved").alias("status"))
    return history.filtered(history.with_decisions(h, d), status="resolved", threat="Normal Traffic").select("seq", "alert_id", "status")


def mock_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return history.mock_predictions(_history(spark, sf).select("seq"))


def scenario_windows(spark: SparkSession, sf: str) -> DataFrame:
    events = _history(spark, sf).select("seq", "prediction", "confidence")
    return files.scenario_windows(events, 3, ["sport", "dur", "sbytes", "Sload", "ct_srv_src", "sloss", "sttl", "other"]).drop("prediction", "confidence")


def scenario_template(spark: SparkSession, sf: str) -> DataFrame:
    """Windows over all of the template's features."""
    events = _history(spark, sf).select("seq", "prediction", "confidence")
    return files.scenario_windows(events, 2, [*files.TEMPLATE, "other"]).select("seq", "step", "sport", "dur", "tcprtt", "ct_dst_ltm", "other")


def scenario_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """A synthetic scenario, held against its ranges."""
    return files.outside_scenario(files.synthetic_scenario(spark, 2000))


def scenario_times(spark: SparkSession, sf: str) -> DataFrame:
    """Flows as samples, 5 seconds apart in the order of their ids."""
    start = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    out = scenario.with_times(flows(spark, sf).select("record_id"), start, "record_id")
    return out.select("record_id", (F.unix_timestamp("timestamp") - F.unix_timestamp(start)).alias("seconds"))


def labelled_features(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of attack-free instants with their features."""
    f = flows(spark, sf)
    lab = labels.at_instants(_labels(spark, sf), interval.attack_free(f.select("source_file", "Stime"), f, 600))
    feats = interval.additive_features(lab, f, [600]).select("source_file", "Stime", "completed_flows_600s", "total_bytes_600s")
    return labels.with_features(lab, feats).select("source_file", "Stime", "horizon", "future_attack", "completed_flows_600s", "total_bytes_600s")


def window_rows(spark: SparkSession, sf: str) -> DataFrame:
    f = _blocked(spark, sf)
    return windows.window_rows(windows.window_manifest(f, WIDTH), f.select("record_id", "sbytes")).select("window_id", "step", "record_id", "sbytes")


def train_nesting(spark: SparkSession, sf: str) -> DataFrame:
    return splits.train_nesting(_folds(spark, sf))


def disorder(spark: SparkSession, sf: str) -> DataFrame:
    return order.disorder(flows(spark, sf).withColumn("record_id", (F.col("record_id") * 7919) % 10007 * 1_000_000 + F.col("record_id")))


def record_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.id_digest(flows(spark, sf))


def stream_sliding_measures(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming form of windowed measures, run to the end of what is there; the windows' ends in seconds."""
    closed = streams.drained(streams.sliding_measures(streams.table_stream(flows(spark, sf))))
    return closed.select("source_file", F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"), "flows", "bytes", "attacks")


# Models


def top_features_rf(spark: SparkSession, sf: str) -> DataFrame:
    ranked = models.importances(streams.stored(_train(spark, sf).select(*FEATURES, "Binary_Label")), FEATURES)
    return spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate(ranked, 1)], "rank int, feature string, importance double")


def forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Plans are cut by tables in the shared folder: a fit runs many jobs over its input."""
    rows = streams.stored(order.holdout_splits(_sessions(spark, sf), WIDTH).where("not purged"))
    w = windows.realized_windows(order.contiguous_blocks(rows, "split"), FEATURES, WIDTH)
    fold = rows.select(F.col("record_id").alias("target_record_id"), "split")
    w = streams.stored(w.join(fold, "target_record_id").select("target_record_id", "target_label", "flat", "split"))
    scored = models.forest_scores(w.where("split = 'train'"), w.where("split = 'test'"), len(FEATURES) * WIDTH)
    return scored.select("target_record_id", "target_label", F.round("y_score", 6).alias("y_score"), "y_pred")
