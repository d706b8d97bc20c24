"""Tree models, artifacts, the grid, the closed test and streams."""

import pytest
from pyspark.sql import functions as F

from flowlens import contracts
from flowlens.operators import models, order, prep, report, windows
from flowlens.sources.flows import flows
from flowlens.streaming import flows as streams


@pytest.fixture(scope="module")
def rows(spark):
    raw = [(i, 10 + i, 10 + i, "f", int(i % 7 > 3), i // 40, float(i % 7 > 3) * 5 + i % 2, float(i % 5), ("tcp", "udp")[i % 2]) for i in range(120)]
    df = spark.createDataFrame(raw, "record_id long, Stime long, Ltime long, source_file string, Binary_Label int, temporal_session int, signal double, noise double, proto string")
    return order.contiguous_blocks(df).withColumn("split", F.when(F.col("temporal_session") < 2, "train").otherwise("test"))


def test_signal_ranks_first(rows):
    ranked = models.importances(rows.where("split = 'train'"), ["noise", "signal"], trees=5, depth=4)
    assert ranked[0][0] == "signal" and models.select(ranked, top_n=1) == ["signal"]
    with pytest.raises(contracts.ContractError):
        models.select(ranked, threshold=2.0)


def test_artifact_round_trip(spark, rows, tmp_path):
    p = prep.Preprocessor(("proto",)).fit(rows.where("split = 'train'"), ["signal", "noise"])
    a = models.Artifact("decision_tree", p, ["signal", "proto_tcp"], 3, None, ["signal", "noise", "proto"])
    train = a.windows(rows.where("split = 'train'"))
    a.model = models.classifier("decision_tree", depth=4).fit(train)
    a.save(spark, str(tmp_path / "artifact"))
    b = models.Artifact.load(spark, str(tmp_path / "artifact"))
    test = rows.where("split = 'test'")
    got, again = (x.predict(test).orderBy("target_record_id").collect() for x in (a, b))
    assert got == again and sum(r.y_pred == r.target_label for r in got) / len(got) > 0.95
    with pytest.raises(contracts.ContractError):
        b.predict(test.drop("noise"))


def test_grid_resumes(spark, rows, tmp_path):
    calls = []

    def parts(fold, variant):
        calls.append((fold, variant))
        w = windows.realized_windows(rows, ["signal", "noise"][: 1 if variant == "top_1" else 2], 3, vector=True)
        return w.where("block < 2"), w.where("block = 2")

    how = {"depth": 3, "trees": 3}
    out = models.run_grid(parts, ["decision_tree"], ["all", "top_1"], [1], str(tmp_path / "r"), spark, lambda f, v: 2, **how)
    assert out.count() == 2 and len(calls) == 2
    assert models.run_grid(parts, ["decision_tree"], ["all", "top_1"], [1], str(tmp_path / "r"), spark, lambda f, v: 2, **how).count() == 2 and len(calls) == 2
    with pytest.raises(contracts.ContractError):
        models.classifier("lstm")


def test_closed_test_runs_once(spark, tmp_path):
    t = models.ClosedTest(str(tmp_path / "state.json"))
    with pytest.raises(contracts.ContractError):
        t.run(lambda: None, lambda x: x, lambda x: {})
    t.advance("prepared")
    assert t.run(lambda: spark.range(3), lambda x: x, lambda x: {"n": x.count()}) == {"n": 3} and t.state == "completed"
    with pytest.raises(contracts.ContractError):
        t.run(lambda: None, lambda x: x, lambda x: {})


def test_report(spark):
    t = report.importance_table(spark.createDataFrame([("a", 0.2), ("b", 0.8)], "feature string, importance double"), spark.createDataFrame([("b",)], "feature string"))
    assert [(r.feature, r.rank, r.used) for r in t.orderBy("rank").collect()] == [("b", 1, True), ("a", 2, False)]
    assert report.markdown(t.select("feature").orderBy("feature")).splitlines()[2] == "| a |"


def _run(query):
    query.processAllAvailable()
    query.stop()


def test_streams_equal_batches(spark, tmp_path):
    f = flows(spark, "/root/testdata/sf0.001")
    f.repartition(1).sortWithinPartitions("Ltime").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))
    _run(streams.sliding_measures(stream).writeStream.format("memory").queryName("measures").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").start())
    end = f.agg(F.max("Ltime")).first()[0]
    batch = f.withColumn("ended", F.timestamp_seconds("Ltime")).groupBy("source_file", F.window("ended", "10 minutes", "5 minutes").alias("w")).count()
    batch = batch.where(F.col("w.end") <= F.timestamp_seconds(F.lit(end - 600)))
    got = spark.table("measures")
    assert got.count() == batch.count() and got.agg(F.sum("flows")).first()[0] == batch.agg(F.sum("count")).first()[0]
    _run(streams.last_rows(stream, 5).writeStream.format("memory").queryName("last").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").start())
    sizes = f.groupBy("source_file").count().collect()
    assert spark.table("last").count() == sum(max(0, r["count"] - 4) for r in sizes)
    assert spark.table("last").where("size(values) <> 5").count() == 0


def test_capped_history(spark, tmp_path):
    each = streams.capped_history(str(tmp_path / "h"), keep=3)
    for epoch in range(3):
        each(spark.createDataFrame([(epoch * 10 + i,) for i in range(2)], "timestamp int"), epoch)
    assert sorted(r.timestamp for r in spark.read.parquet(str(tmp_path / "h/v0")).collect()) == [11, 20, 21]


def test_errors_have_codes(spark, rows, tmp_path):
    with pytest.raises(contracts.ModelNotLoaded) as e:
        (tmp_path / "none/manifest").mkdir(parents=True)
        models.Artifact.load(spark, str(tmp_path / "none"))
    assert e.value.code == "MODEL_NOT_LOADED"
    p = prep.Preprocessor(("proto",)).fit(rows.where("split = 'train'"), ["signal", "noise"])
    a = models.Artifact("decision_tree", p, ["signal"], 3, None, ["signal", "noise", "proto"])
    a.model = models.classifier("decision_tree", depth=3).fit(a.windows(rows.where("split = 'train'")))
    with pytest.raises(contracts.InvalidFeatures):
        a.predict_last(rows.drop("noise"))
    (last,) = a.predict_last(rows.where("split = 'test'")).collect()
    assert last.target_record_id == 119


def test_disjoint(spark):
    a, b = spark.range(3), spark.range(3, 5)
    contracts.require_disjoint(a, b, "id")
    with pytest.raises(contracts.ContractError):
        contracts.require_disjoint(a, a, "id")


def test_a_polled_stream_picks_up_what_comes_later(spark, tmp_path):
    from flowlens.streaming import flows as streams

    spark.range(3).write.parquet(f"{tmp_path}/in")
    query = streams.polled(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), str(tmp_path), "1 second")
    query.processAllAvailable()
    spark.range(3, 5).write.mode("append").parquet(f"{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 4]
