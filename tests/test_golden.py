"""Small frames with known results."""

import pytest
from pyspark.sql import functions as F

from flowlens import contracts
from flowlens.functions import scalars
from flowlens.operators import audit, clean, history, interval, labels, metrics, onset, order, prep, report, scenario, splits, windows
from flowlens.sources import files, sinks

BASE = 1_421_927_400


def flow(spark, rows):
    """(file, Stime, Ltime, label, cat), offsets from BASE."""
    return spark.createDataFrame([(i, f, BASE + s, BASE + e, b, c) for i, (f, s, e, b, c) in enumerate(rows)], "record_id long, source_file string, Stime long, Ltime long, Binary_Label int, attack_cat string")


@pytest.fixture(scope="module")
def onset_flows(spark):
    a = [(0, 0, 0, "BENIGN"), (1, 1, 0, "BENIGN"), (1, 2, 1, "Exploits"), (1, 1, 0, "BENIGN"), (1, 2, 1, "Exploits"), (2, 2, 1, "Exploits"), (3, 3, 0, "BENIGN"), (4, 5, 1, "DoS")]
    b = [(0, 0, 1, "Generic"), (1, 1, 0, "BENIGN"), (2, 2, 1, "Generic")]
    return flow(spark, [("part-a", *r) for r in a] + [("part-b", *r) for r in b])


def test_run_catalog(onset_flows):
    rows = onset.run_catalog(onset_flows, "E").orderBy("event_id").collect()
    assert [r.event_id for r in rows] == ["E000001", "E000002", "E000003", "E000004"]
    assert [r.onset_stime - BASE for r in rows if r.source_file == "part-a"] == [1, 4]
    assert [r.confirmed_onset for r in rows] == [True, True, False, True]
    assert sum(r.mixed_bins for r in rows) == 1
    assert sum(r.transitions for r in onset.raw_transitions(onset_flows).collect()) == 4
    cats = {r.event_id: r for r in onset.run_categories(onset_flows, "E").collect()}
    assert cats["E000001"].primary_category == "Exploits" and cats["E000001"].categories == "Exploits"


def test_attack_interval_absorbs_a_later_benign_start(spark):
    f = flow(spark, [("a", -1, -1, 0, "BENIGN"), ("a", 0, 5, 1, "x"), ("a", 1, 1, 0, "BENIGN"), ("a", 2, 2, 1, "x")])
    (r,) = onset.run_catalog(f).collect()
    assert (r.onset_stime - BASE, r.last_stime - BASE) == (0, 2)


def test_a_first_attack_is_never_a_derived_onset(onset_flows):
    assert [r.onset_stime - BASE for r in labels.derived_onsets(onset_flows).orderBy("event_id").collect()] == [1, 4, 2]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [("part-a", t, t, b, "x") for t, b in ((0, 0), (4, 0), (5, 0), (5, 1), (6, 1), (7, 0), (15, 1))] + [("part-b", t, t, b, "x") for t, b in ((0, 0), (3, 0), (4, 1))]
    onsets = spark.createDataFrame([("E-A1", "part-a", BASE + 5), ("E-A2", "part-a", BASE + 15), ("E-B1", "part-b", BASE + 4)], "event_id string, source_file string, onset_stime long")
    return flow(spark, rows), onsets


def test_prospective_labels(labelled):
    f, onsets = labelled
    got = {(r.source_file, r.Stime - BASE): (r.future_attack, r.seconds_to_attack, r.next_event_id) for r in labels.prospective_labels(f, [5], onsets).collect()}
    assert got[("part-a", 0)] == (1, 5, "E-A1") and got[("part-a", 4)] == (1, 1, "E-A1") and got[("part-a", 7)] == (0, 8, "E-A2")
    assert not {("part-a", t) for t in (5, 6, 15)} & set(got)
    many = labels.prospective_labels(f, [60, 5, 10], onsets)
    assert many.count() == 3 * len(got)
    assert all(r.obeys_rule for r in labels.label_examples(many).collect())


def test_a_file_without_onset_and_an_onset_without_attack(spark, labelled):
    f, onsets = labelled
    quiet = f.unionByName(flow(spark, [("part-c", 0, 0, 0, "x")]))
    (r,) = labels.prospective_labels(quiet, [5], onsets).where("source_file = 'part-c'").collect()
    assert (r.future_attack, r.seconds_to_attack, r.next_event_id) == (0, None, None)
    wrong = onsets.unionByName(spark.createDataFrame([("X", "part-a", BASE + 7)], onsets.schema))
    with pytest.raises(contracts.ContractError):
        labels.prospective_labels(f, [5], wrong)
    with pytest.raises(contracts.ContractError):
        labels.prospective_labels(f, [5, 5])


def causal_flows(spark, future=9000):
    rows = [("part-a", 0, 1, 1.0, 100, 10, 2, 1, "a", "x", "1", "80", "tcp", "FIN", 0), ("part-a", 2, 4, 2.0, 200, 20, 4, 2, "b", "y", "2", "443", "udp", "CON", 0), ("part-a", 8, 20, 12.0, future, 900, 90, 9, "f", "f", "9", "9", "tcp", "INT", 1), ("part-b", 0, 1, 1.0, 50, 5, 1, 1, "z", "x", "1", "80", "tcp", "FIN", 0)]
    return spark.createDataFrame([(f, BASE + s, BASE + e, *r) for f, s, e, *r in rows], "source_file string, Stime long, Ltime long, dur double, sbytes long, dbytes long, Spkts long, Dpkts long, srcip string, dstip string, sport string, dsport string, proto string, state string, Binary_Label int")


def test_causal_features(spark):
    q = spark.createDataFrame([("part-a", BASE + 5), ("part-b", BASE + 5), ("part-a", BASE + 11), ("part-a", BASE + 100)], "source_file string, Stime long")
    rows = interval.causal_features(q, causal_flows(spark), [10]).collect()
    got = {(r.source_file, r.Stime - BASE): r for r in rows}
    a, b = got[("part-a", 5)], got[("part-b", 5)]
    assert (a.completed_flows_10s, a.total_bytes_10s, a.total_packets_10s, a.distinct_dst_ips_10s) == (2, 330, 9, 2)
    assert (b.completed_flows_10s, b.total_bytes_10s) == (1, 55)
    assert a.dst_ip_entropy_10s == 1.0 and a.tcp_fraction_10s == 0.5 and a.duration_std_10s == 0.5
    assert got[("part-a", 11)].completed_flows_10s == 1  # one ended exactly at t - W
    empty = got[("part-a", 100)]
    assert all(v == 0 for k, v in empty.asDict().items() if k.endswith("_10s"))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, interval.causal_features(q, causal_flows(spark, future=1), [10]).collect()))  # what comes later changes nothing
    with pytest.raises(contracts.ContractError):
        interval.causal_features(q, causal_flows(spark), [1])
    with pytest.raises(contracts.ContractError):
        interval.causal_features(q.withColumn("future_attack", F.lit(1)), causal_flows(spark), [10])


def test_attack_free_history(spark):
    f = flow(spark, [("part-a", t, t, int(t == 50), "x") for t in (0, 50, 100, 500)])
    q = spark.createDataFrame([("part-a", BASE + t) for t in (100, 170, 171)], "source_file string, Stime long")
    assert sorted(r.Stime - BASE for r in interval.attack_free(q, f, 120).collect()) == [170, 171]


def three_sessions(spark):
    rows = [(i, "s", start + k, start + k, k % 2, "A" if k % 2 else "BENIGN", float(k)) for n, start in enumerate((100, 5000, 10000)) for k in range(12) for i in [n * 12 + k]]
    return spark.createDataFrame(rows, "record_id long, source_file string, Stime long, Ltime long, Binary_Label int, attack_cat string, feature double").repartition(3)


def test_sessions_and_holdout(spark):
    s = order.natural_sessions(three_sessions(spark), 1000)
    assert [r.min_stime for r in order.session_summary(s).orderBy("temporal_session").collect()] == [100, 5000, 10000]
    h = order.holdout_splits(s, 3)
    n = {r.part: r.n_rows for r in order.partition_summary(h).collect()}
    assert n == {"train": 10, "validation": 8, "test": 10, "purged": 8}
    order.check_partitions(h, 3)
    w = windows.window_counts(h.where("not purged"), 3, 2, "split")
    assert {r.split: r.windows for r in w.collect()} == {"train": 8, "validation": 6, "test": 8}
    assert order.crossing_sessions(s).count() == 0
    with pytest.raises(contracts.ContractError):
        order.holdout_splits(s.where("temporal_session < 2"), 3)


def fold_rows(spark):
    rows = [(i, 100 + i, 100 + i, "f", i % 2, "x", 0) for i in range(80)] + [(100 + i, 1000 + i, 1000 + i, "f", i % 2, "x", 1) for i in range(20)]
    return spark.createDataFrame(rows, "record_id long, Stime long, Ltime long, source_file string, Binary_Label int, attack_cat string, temporal_session int")


def test_expanding_folds(spark):
    rows = order.positions(fold_rows(spark))
    bounds = splits.fold_boundaries(rows, 3)
    blocks = splits.purged_blocks(rows, bounds, 3)
    assert blocks.where("purged").count() == 12
    folded = splits.expanding_folds(blocks, 3)
    splits.check_folds(folded, 3)
    n = {(r.fold, r.role): r.n_rows for r in splits.fold_summary(folded).collect()}
    assert [n[(i, "train")] for i in (1, 2, 3)] == sorted({n[(i, "train")] for i in (1, 2, 3)})


def test_embargo_waits_for_flows_that_still_run(spark):
    rows = order.positions(fold_rows(spark)).withColumn("Ltime", F.when(F.col("position") == 5, F.col("Stime") + 30).otherwise(F.col("Stime")))
    plain, late = (splits.purged_blocks(r, [20], 3).where("purged").count() for r in (order.positions(fold_rows(spark)), rows))
    assert plain == 4 and late == 18  # positions 18 to 35: that flow ends at the time of position 35


def test_blocks_and_windows(spark):
    rows = spark.createDataFrame([(100 + i, 10 + i, 20 + i, "f", i % 2, 0 if i < 6 else 1) for i in range(11)], "record_id long, Stime long, Ltime long, source_file string, Binary_Label int, temporal_session int")
    m = windows.window_manifest(order.contiguous_blocks(rows), 3).orderBy("window_id").collect()
    assert len(m) == 4 + 3 and [r.window_id for r in m] == list(range(7))
    assert (m[0].record_ids, m[0].target_record_id, m[0].start_stime, m[0].end_ltime) == ([100, 101, 102], 102, 10, 22)
    moved = rows.withColumn("source_file", F.when(F.col("record_id") == 102, "g").otherwise(F.col("source_file")))
    b = order.contiguous_blocks(moved)
    assert [r["count"] for r in b.groupBy("block").count().orderBy("block").collect()] == [2, 1, 3, 5]
    counts = windows.window_counts(b, 3, 2, "block")
    assert [r.windows for r in counts.orderBy("block").collect()] == [0, 0, 1, 3]
    realized = windows.realized_windows(b.withColumn("x", F.col("record_id").cast("double")), ["x"], 3)
    assert windows.differences(realized, windows.window_manifest(b, 3)).count() == 0
    extra = order.contiguous_blocks(rows.withColumn("cut", (F.col("record_id") >= 103).cast("int") + (F.col("record_id") >= 106).cast("int")), "cut")
    assert [r["count"] for r in extra.groupBy("block").count().orderBy("block").collect()] == [3, 3, 5]
    assert windows.window_counts(extra, 3, 2, "block").agg(F.sum("batches")).first()[0] == 4


def event_labels(spark):
    onsets = [BASE + 1000 * k for k in range(1, 6)]
    rows = []
    for t in range(BASE + 800, BASE + 5201, 20):
        ahead = min((o for o in onsets if o > t), default=None)
        rows += [("part-a", t, h, int(ahead is not None and ahead - t <= h), ahead) for h in (5, 60)]
    return spark.createDataFrame(rows, "source_file string, Stime long, horizon int, future_attack int, next_onset long")


def test_event_anchored_split(spark):
    lab = event_labels(spark)
    assert splits.event_boundaries(lab)[:3] == (3, 1, 1)
    out = splits.event_anchored_split(lab, 180, least=180)
    splits.check_splits(out, 180)
    high = {r.split: r for r in out.groupBy("split").agg(F.min("Stime").alias("low"), F.max("Stime").alias("high")).collect()}
    assert high["train"].high <= BASE + 3410 and BASE + 3590 <= high["validation"].low and high["test"].low >= BASE + 4590
    with pytest.raises(contracts.ContractError):
        splits.event_anchored_split(lab.where(F.col("Stime") < BASE + 2500), 180)
    with pytest.raises(contracts.ContractError):
        splits.event_anchored_split(lab, 100, least=180)


def test_numbers_and_categories(spark):
    df = spark.createDataFrame([("80",), ("0x0016",), ("-",), ("443",), ("1d",), ("inf",), (" 7.5 ",), ("-0x10",), (None,)], "x string")
    assert [r.x for r in clean.numbers(df, ["x"]).collect()] == [80, 22, 0, 443, 0, 0, 7.5, -16, 0]
    raw = spark.createDataFrame([(None, 0, None), (" Fuzzers", 1, 1), (" Fuzzers", 1, 1)], "attack_cat string, label int, is_ftp_login int")
    got = sorted((r.attack_cat, r.Binary_Label, r.is_ftp_login) for r in clean.clean_flows(raw).collect())
    assert got == [("BENIGN", 0, 0), ("Fuzzer", 1, 1)]
    odd = spark.createDataFrame([(float("inf"), None), (float("nan"), 2)], "a double, b int")
    assert [tuple(r) for r in clean.fill_invalid(odd).collect()] == [(0.0, 0), (0.0, 2)]
    assert clean.clean_names(spark.createDataFrame([(1,)], "`a b/c-d ` int")).columns == ["a_b_c_d"]
    assert clean.top_columns(["a", "b", "c"], "top_2") == ["a", "b"]


def test_preprocessor(spark):
    rows = spark.createDataFrame([(i, "train", p, s, v, float(sm), lg) for i, (p, s, v, sm, lg) in enumerate((("tcp", "FIN", "http", 1, 0.0), ("tcp", "CON", None, 2, 2e6), ("udp", "FIN", "dns", 3, 4e6), ("udp", "CON", "http", 4, 8e6)))], "record_id long, split string, proto string, state string, service string, small double, large double")
    p = prep.Preprocessor().fit(rows, ["small", "large"])
    assert p.state["logged"] == ["large"]
    out = p.transform(rows).orderBy("record_id").collect()
    assert [round(r.small, 4) for r in out] == [-1.0, -0.3333, 0.3333, 1.0] and [r.service___MISSING__ for r in out] == [0, 1, 0, 0]
    other = rows.limit(1).withColumn("proto", F.lit("gre")).withColumn("split", F.lit("validation"))
    (r,) = p.transform(other).collect()
    assert (r.proto_tcp, r.proto_udp) == (0, 0)
    assert prep.Preprocessor.from_json(p.to_json()).state == p.state
    for wrong in (lambda: p.fit(rows), lambda: prep.Preprocessor().fit(other), lambda: prep.Preprocessor().transform(rows)):
        with pytest.raises(contracts.ContractError):
            wrong()


def test_metrics(spark):
    s = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.8), (1, 1, 0.9), (1, 0, 0.2)], "y_true int, y_pred int, y_score double").withColumn("g", F.lit(1))
    r = metrics.fold_metrics(s, "g").first()
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 1, 1, 1) and (r.precision, r.recall, r.f1, r.fpr) == (0.5, 0.5, 0.5, 0.5)
    assert r.roc_auc == 0.75 and abs(r.average_precision - 0.8333333333) < 1e-7
    res = spark.createDataFrame([("tree", "all", f, v, 0.1, 0.5, 0.5, 10) for f, v in ((0, 0.6), (1, 0.8))] + [("tree", "top_2", 0, 0.9, 0.1, 0.5, 0.5, 2)], "algorithm string, variant string, fold int, f1 double, fpr double, roc_auc double, average_precision double, feature_count int")
    (b,) = metrics.leaderboard(res, [0, 1]).collect()
    assert (b.variant, b.f1_mean, b.f1_std) == ("all", 0.7, 0.1)
    one = spark.createDataFrame([(1, 1, 0.5)], "y_true int, y_pred int, y_score double").withColumn("g", F.lit(1))
    assert metrics.roc_auc(one, "g").first().roc_auc is None


def test_by_type(spark):
    p = spark.createDataFrame([("Normal", 0, 0), ("Normal", 0, 1), ("DoS", 1, 1), ("Exploits", 1, 0)], "attack_type string, y_true int, y_pred int")
    got = {r.attack_type: (r.tn, r.fp, r.fn, r.tp) for r in metrics.by_type(p).collect()}
    assert got == {"DoS": (1, 1, 0, 1), "Exploits": (1, 1, 1, 0)}


def test_history(spark):
    h = spark.createDataFrame([(1, "SYN Flood - Low Intensity", 0.68, "m", "2026-01-01T20:45:01Z"), (2, "SYN Flood - Low Intensity", 0.77, "m", "2026-01-01T20:43:01Z"), (3, "BENIGN", 0.99, "m", "2026-01-01T20:40:00Z")], "seq int, prediction string, confidence double, model string, timestamp string")
    assert [r.confidence for r in history.ranked(h).collect()][:2] == [0.77, 0.68]
    s = history.with_severities(h).orderBy("seq").collect()
    assert (s[0].severity_dashboard, s[2].severity_dashboard, s[2].severity_mail, s[0].severity_scenario) == ("info", "safe", "critical", "safe")
    assert history.most_recent(h).first().confidence == 0.68
    c = history.severity_counts(h).first()
    assert (c.warning, c.info, c.safe, c.active, c.syn_flood) == (1, 1, 1, 2, True)


def test_scenario_and_sources(spark, tmp_path):
    s = files.synthetic_scenario(spark, 25)
    assert [f.name for f in s.schema] == [f.name for f in files.SCENARIO]
    got = scenario.summary(scenario.scored(s)).first()
    assert (got.n_rows, got.tp + got.fn) == (100, 75) and got.accuracy > 0.9
    sinks.write_csv(s, f"{tmp_path}/csv")
    assert sorted(map(tuple, files.scenario_csv(spark, f"{tmp_path}/csv").select("sample_id", "syn_flag_count").collect())) == sorted(map(tuple, s.select("sample_id", "syn_flag_count").collect()))
    (tmp_path / "e.json").write_text('[{"prediction": "a", "confidence": 0.5}, {"prediction": "b"}]')
    assert files.event_json(spark, str(tmp_path / "e.json")).count() == 2
    w = files.scenario_windows(spark.createDataFrame([("SYN Flood - High Intensity", 0.5), ("Normal", 0.9)], "prediction string, confidence double"), 2, ["sbytes", "sport", "sloss", "dur", "x"])
    got = {(r.prediction[:3], r.step): (r.sbytes, r.sport, r.sloss, r.dur, r.x) for r in w.collect()}
    assert got == {("SYN", 0): (1200.0, 49152.0, 4.0, 0.02, 0.0), ("SYN", 1): (2400.0, 49153.0, 4.0, 0.02, 0.0), ("Nor", 0): (160.0, 49152.0, 0.0, 1.2, 0.0), ("Nor", 1): (320.0, 49153.0, 0.0, 1.2, 0.0)}
    one = files.outside_scenario(s).collect()
    assert len(one) == 4 and all((r.n_rows, r.n_ids, r.n_outside) == (25, 25, 0) for r in one)
    assert s.where("sample_id = 'syn-flood-low-007'").count() == 1
    with pytest.raises(contracts.ContractError):
        files.synthetic_scenario(spark, 0)


def test_request_bodies(spark):
    bodies = ['{"features": [{"a": 1, "b": "true"}, {"a": 0.5, "b": "[x"}]}', '{"features": {"a": [3, 4], "b": ["y", null]}}', '{"features": {"a": 5, "b": true}, "model": "m"}', '[{"a": {"c": 1}, "b": [1]}, 7]']
    bad = ['{"a": [1, 2, 3], "b": [4]}', '{"features": []}', "[]", "3", "not json", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(bodies + bad)], "i int, payload string")
    rows = files.payload_rows(df, ["a", "b"])
    got = [(r.i, r.row, r.a, r.b) for r in rows.orderBy("i", "row").collect()]
    assert got == [(0, 0, "1", "true"), (0, 1, "0.5", "[x"), (1, 0, "3", "y"), (1, 1, "4", None), (2, 0, "5", None), (3, 0, None, None), (3, 1, None, None)]
    assert {r.i: r.error for r in files.payload_errors(df).collect()} == {4: "columns of unequal length", 5: "no window", 6: "no window", 7: "neither an object nor a list", 8: "neither an object nor a list", 9: "neither an object nor a list"}
    missing = {(r.i, r.row): r.missing for r in clean.invalid_rows(rows, ["a", "b"]).collect()}
    assert missing == {(1, 1): ["b"], (2, 0): ["b"], (3, 0): ["a", "b"], (3, 1): ["a", "b"]}


def test_every_critical_alert_is_handed_over(spark):
    got = []
    batch = spark.range(100).selectExpr("CASE WHEN id % 2 = 0 THEN 'DoS' ELSE ' Normal' END AS prediction", "0.9D + (id % 4 - 1) * 0.01 AS confidence", "id")
    sinks.alert_batches(got.append, 7)(batch, 0)
    assert sorted(r["id"] for x in got for r in x) == list(range(2, 100, 4)) and max(map(len, got)) == 7
    sinks.alert_batches()(batch, 1)


def test_alert_windows_and_report_tables(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01T00:00:03Z",), ("soon",)], "t string").select(*(c.alias(n) for c, n in zip(scalars.alert_window(F.col("t")), "ab", strict=True)))
    assert sorted(map(tuple, df.collect())) == [("2025-12-31T23:59:58Z", "2026-01-01T00:00:03Z"), ("soon", "soon")]
    t = spark.createDataFrame([("rf", "all", 1.0, 0.5, 0.25, 0.1, 0.9, 0.8, 1, 2, 3, 4)], "algorithm string, variant string, f1 double, precision double, recall double, fpr double, roc_auc double, average_precision double, tn int, fp int, fn int, tp int")
    assert tuple(report.confusion_table(t).first()) == ("rf", "all", 1, 2, 3, 4) and report.model_table(t).first().average_precision == 0.8
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/ids")
    assert [r.record_id for r in order.with_record_id(spark.read.parquet(f"{tmp_path}/ids")).orderBy("id").collect()] == [0, 1, 2]


def test_parquet_and_sinks(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    assert sinks.write_parquet(df.coalesce(1), f"{tmp_path}/p") == 5
    with pytest.raises(Exception):
        sinks.write_parquet(df, f"{tmp_path}/p")
    back = files.parquet_folder(spark, f"{tmp_path}/p")
    assert [r.record_id for r in back.orderBy("id").collect()] == [0, 1, 2, 3, 4] and files.column_names(spark, f"{tmp_path}/p") == ["id", "x"]
    assert sinks.id_digest(back, "id").first() == sinks.id_digest(back.repartition(3), "id").first()
    sinks.readable(spark, f"{tmp_path}/p")
    sinks.write_json(f"{tmp_path}/r.json", {"b": 1, "a": 2})
    with pytest.raises(contracts.ContractError):
        sinks.write_json(f"{tmp_path}/r.json", {})
    with pytest.raises(contracts.ContractError):
        sinks.guard(["a/b"], ["a/./b"])
    with pytest.raises(contracts.ContractError):
        files.parquet_folder(spark, f"{tmp_path}/none")
    (tmp_path / "r.json.sha256").write_text(sinks.file_digest(f"{tmp_path}/r.json"))
    sinks.verify_sidecar(f"{tmp_path}/r.json")


def test_audit(spark):
    f = flow(spark, [("part-1", 5, 6, 0, "BENIGN"), ("part-1", 3, 2, 1, "x")])
    assert audit.per_file(f).first().backward_steps == 1
    r = audit.readiness(f).first()
    assert not r.ready and r.reasons == "negative durations"
    assert audit.profile(f).first().first_utc == "2015-01-22T11:50:03+00:00"


def test_scalar_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert df.select(scalars.safe_divide(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_sort_is_total(spark):
    f = flow(spark, [("b", 1, 1, 0, "x"), ("a", 1, 1, 0, "x"), ("a", 1, 1, 1, "y"), ("a", 0, 5, 0, "x")])
    assert [r.record_id for r in order.stable_sort(f, ("source_file", "Stime", "Ltime", "record_id")).collect()] == [3, 1, 2, 0]


def test_flow_view_and_sessions_agree_with_a_global_window(spark):
    from pyspark.sql import Window

    from flowlens.sources.flows import flows

    f = flows(spark, "/root/testdata/sf0.001")
    s = order.positions(order.natural_sessions(f, 21_600))
    plain = s.withColumn("p", F.row_number().over(Window.orderBy(*contracts.ORDER)) - 1)
    assert plain.where("p <> position").count() == 0 and s.agg(F.max("temporal_session")).first()[0] == 29


def test_pieces_do_not_change_results(spark, monkeypatch):
    """With tiny pieces everything crosses borders."""
    from flowlens.operators import pieces
    from flowlens.sources.flows import flows

    f = flows(spark, "/root/testdata/sf0.001")
    s = order.natural_sessions(f, 21_600).cache()

    def everything():
        blocked = order.contiguous_blocks(s)
        tables = [
            onset.run_catalog(f), labels.prospective_labels(f, [900]), order.positions(s).select("record_id", "position"), blocked.select("record_id", "block"),
            windows.window_manifest(blocked, 4), windows.window_means(blocked, ["dur"], 4), order.holdout_splits(s, 4).select("record_id", "split", "purged"),
            interval.attacks_before(f.select("source_file", "Stime"), f, 3600), interval.causal_features(f.select("source_file", "Stime").distinct(), f, [600, 900]),
            onset.raw_transitions(f), onset.backward_steps(f), order.disorder(f),
        ]
        return [sorted(map(repr, t.collect())) for t in tables]

    want = everything()
    monkeypatch.setattr(pieces.time_piece, "__defaults__", (700,))
    for module in (order, windows, pieces):
        monkeypatch.setattr(module, "ROWS", 5)
    monkeypatch.setattr(interval, "HOURS", 900)
    for a, b in zip(everything(), want, strict=True):
        assert a == b
