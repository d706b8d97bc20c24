"""Tree models over flat windows, importance selection, artifacts, the experiment grid and the closed test."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import contracts
from flowlens.functions.scalars import decode
from flowlens.operators import forest
from flowlens.operators.metrics import fold_metrics
from flowlens.operators.prep import Preprocessor
from flowlens.operators.windows import realized_windows

#: MLlib grows trees to depth 30 at most; DEEPEST stands for no limit.
SEED, TREES, DEPTH, DEEPEST = 42, 100, 20, 30


def classifier(algorithm: str, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    common = {"featuresCol": "features", "labelCol": "target_label", "maxDepth": depth, "seed": seed}
    if algorithm == "decision_tree":
        return DecisionTreeClassifier(**common)
    if algorithm == "random_forest":
        return RandomForestClassifier(numTrees=trees, **common)
    raise contracts.ContractError(f"no such algorithm: {algorithm}; a recurrent network has no equivalent in MLlib")


def importances(rows: DataFrame, features: list[str], label: str = "Binary_Label", trees: int = TREES, depth: int = DEEPEST, seed: int = SEED) -> list[tuple[str, float]]:
    """Features with their forest importance, by importance falling, then by their order. Fit on training rows."""
    x = rows.select(F.array(*(F.col(f).cast("double") for f in features)).alias("x"), (F.col(label).cast("double") > 0).cast("int").alias("y"))
    found = forest.importances(x, len(features), trees, depth, seed)
    ranked = sorted(range(len(features)), key=lambda i: (-float(found[i]), i))
    return [(features[i], float(found[i])) for i in ranked]


def forest_scores(train: DataFrame, test: DataFrame, width: int, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """target_record_id, target_label, y_score, y_pred and confidence of the test windows, by a forest that is fit on train and not kept.

    Both: windows with flat, of `width` numbers. A forest on many rows is too large for a driver, so tasks grow its trees
    and score with them; classifier() fits one that can be stored.
    """
    x = [F.col("flat").alias("x"), F.col("target_record_id").alias("id"), F.col("target_label").cast("int").alias("y")]
    out = forest.scores(train.select(*x), test.select(*x), width, trees, depth, seed)
    hit, sure = decode(F.col("y_score"))
    return out.select(F.col("id").alias("target_record_id"), F.col("y").alias("target_label"), "y_score").withColumn("y_pred", hit).withColumn("confidence", sure)


def select(ranked: list[tuple[str, float]], top_n: int | None = None, threshold: float = 0.0) -> list[str]:
    """The names to keep: those that reach a threshold above 0, or else the first top_n; none is an error."""
    names = [n for n, v in ranked if v >= threshold] if threshold > 0 else [n for n, _ in ranked[:top_n]]
    if not names:
        raise contracts.ContractError("no feature is left")
    return names


def save_ranking(path: str, ranked: list[tuple[str, float]]) -> None:
    Path(path).write_text(json.dumps([{"rank": i, "feature": n, "importance": v} for i, (n, v) in enumerate(ranked, 1)], sort_keys=True))


def load_ranking(path: str) -> list[tuple[str, float]]:
    return [(r["feature"], r["importance"]) for r in json.loads(Path(path).read_text())]


def score(model, windows: DataFrame) -> DataFrame:
    """windows with y_score, y_pred and confidence. A copy of the model leaves out the fit's summary, which holds the session and cannot always be shipped."""
    out = model.copy().transform(windows).withColumn("y_score", vector_to_array("probability")[1])
    hit, sure = decode(F.col("y_score"))
    return out.withColumn("y_pred", hit).withColumn("confidence", sure).drop("rawPrediction", "probability", "prediction", "features", "window", "flat")


class Artifact:
    """A fitted preprocessor, the selected features, the window width and a tree model, stored as one folder."""

    MODELS = {"decision_tree": DecisionTreeClassificationModel, "random_forest": RandomForestClassificationModel}

    def __init__(self, algorithm: str, prep: Preprocessor, features: list[str], width: int, model, raw_columns: list[str], extra: dict | None = None):
        self.algorithm, self.prep, self.features, self.width, self.model, self.raw_columns, self.extra = algorithm, prep, features, width, model, raw_columns, extra or {}

    def save(self, spark: SparkSession, path: str) -> None:
        """The model by its own writer; the manifest is a one-row table, so that any file system will do."""
        self.model.write().save(f"{path}/model")
        manifest = {"algorithm": self.algorithm, "features": self.features, "width": self.width, "raw_columns": self.raw_columns, "preprocessor": self.prep.to_json(), "extra": self.extra}
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.json(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Artifact:
        row = spark.read.schema("manifest string").json(f"{path}/manifest").first()
        if row is None:
            raise contracts.ModelNotLoaded(f"no artifact at {path}")
        m = json.loads(row["manifest"])
        if lacking := [k for k in ("algorithm", "features", "width", "raw_columns", "preprocessor") if k not in m]:
            raise contracts.ContractError(f"the manifest lacks {lacking}")
        return cls(m["algorithm"], Preprocessor.from_json(m["preprocessor"]), m["features"], m["width"], cls.MODELS[m["algorithm"]].load(f"{path}/model"), m["raw_columns"], m["extra"])

    def windows(self, blocked: DataFrame) -> DataFrame:
        contracts.require_columns(blocked, [*self.raw_columns, "block", "position"])
        keep = ["block", "position", "record_id", "Binary_Label"]
        return realized_windows(self.prep.transform(blocked, keep=keep).select(*keep, *self.features), self.features, self.width, vector=True)

    def predict(self, blocked: DataFrame) -> DataFrame:
        """Check columns, preprocess, select, window, score, decode. blocked: raw rows with block and position."""
        return score(self.model, self.windows(blocked))

    def predict_last(self, blocked: DataFrame) -> DataFrame:
        """The answer to a request: the last window's prediction only."""
        lacking = [c for c in self.raw_columns if c not in blocked.columns]
        if lacking:
            raise contracts.InvalidFeatures(f"missing features: {', '.join(lacking[:10])}")
        return self.predict(blocked).orderBy(F.desc("block"), F.desc("target_record_id")).limit(1)


def run_grid(parts: Callable[[int, str], tuple[DataFrame, DataFrame]], algorithms: list[str], variants: list[str], folds: list[int], results: str, spark: SparkSession, features_of: Callable[[int, str], int], **how) -> DataFrame:
    """Fit and score each (algorithm, variant, fold) not yet in the results table, appending a row each; resumable.

    parts(fold, variant) gives training and validation windows (features, target_label, y_true).
    """
    try:
        done = {(r["algorithm"], r["variant"], r["fold"]) for r in spark.read.parquet(results).select("algorithm", "variant", "fold").collect()}
    except Exception as e:  # nothing is there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = set()
    for algorithm in algorithms:
        for variant in variants:
            for fold in folds:
                if (algorithm, variant, fold) in done:
                    continue
                train, valid = parts(fold, variant)
                out = score(classifier(algorithm, **how).fit(train), valid).withColumn("y_true", F.col("target_label").cast("int"))
                row = fold_metrics(out.withColumn("fold", F.lit(fold)), "fold")
                row.withColumns({"algorithm": F.lit(algorithm), "variant": F.lit(variant), "feature_count": F.lit(features_of(fold, variant))}).write.mode("append").parquet(results)
    return spark.read.parquet(results)


class ClosedTest:
    """The test set is read once: prepared, test_opened, test_transformed, completed; no step back, no second run."""

    STATES = ("prepared", "test_opened", "test_transformed", "completed")

    def __init__(self, path: str):
        self.path = Path(path)

    @property
    def state(self) -> str | None:
        return json.loads(self.path.read_text())["state"] if self.path.exists() else None

    def advance(self, to: str) -> None:
        at = -1 if self.state is None else self.STATES.index(self.state)
        if self.STATES.index(to) != at + 1:
            raise contracts.ContractError(f"the closed test is {self.state}; it cannot become {to}")
        new = self.path.with_suffix(".new")
        new.write_text(json.dumps({"state": to}))
        new.replace(self.path)

    def run(self, read: Callable[[], DataFrame], transform: Callable[[DataFrame], DataFrame], evaluate: Callable[[DataFrame], dict]) -> dict:
        self.advance("test_opened")
        raw = read()
        ready = transform(raw)
        self.advance("test_transformed")
        out = evaluate(ready)
        self.advance("completed")
        return out
