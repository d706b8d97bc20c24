"""The pipeline stage by stage on small tables."""

import re
from collections import Counter

import corpus_pipeline as cp
import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm import common, queries
from tests.llm.test_dups_and_phrases import bench_items, linked, sets_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, seen = common.documents(spark, SF), {}
    for name, f in cp.STAGES:
        out = common.scratch(spark, name)
        f(spark, docs, SF).write.parquet(out)
        docs = seen[name] = spark.read.parquet(out)
        if f is not cp.token_files:
            assert docs.columns == cp.COLUMNS
    every = common.documents(spark, SF)
    assert seen["language"].count() == every.where(F.col("text").rlike(r"\p{L}")).count()
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(seen["near_dedup"]) < ids(seen["language"]) and ids(seen["decontamination"]) < ids(seen["near_dedup"])
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    before, after = (sum(words(r.text) for r in seen[k].select("text").collect()) for k in ("decontamination", "mixing"))
    assert abs(before - after) <= seen["decontamination"].select("source").distinct().count()
    assert seen["token_files"].count() == seen["mixing"].count()


def test_run_of_an_odd_and_an_empty_corpus(spark, rows, docs, empty, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.select(*cp.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()}
    assert kept and kept <= {r[0] for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])}
    empty.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_stages_equal_brute_force_on_odd_rows(spark, rows, docs, tmp_path):
    """Near duplicates against all pairs; decontamination and the mix against SQL, each on its own input."""
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    components = linked(sets_of(rows, 5), 80)
    assert ids(cp.near_dedup(spark, docs, "")) == sorted(i for i, c in components.items() if i == c)

    spark.createDataFrame(bench_items(rows), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[3] for r in rows]}))
    c.register("benchmark", pa.table({"item_id": [r[0] for r in bench_items(rows)], "text": [r[1] for r in bench_items(rows)]}))
    clean = sorted(r[0] for r in c.execute(f"SELECT doc_id FROM ({queries.OP1_SQL}) WHERE NOT contaminated").fetchall())
    assert ids(cp.decontamination(spark, docs, str(tmp_path))) == clean and len(clean) < len(rows)

    taken = Counter()
    for r in cp.mixing(spark, docs, "").collect():
        taken[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert taken == Counter(dict(c.execute(f"SELECT doc_id, taken FROM ({queries.OP3_SQL}) WHERE taken > 0").fetchall()))
