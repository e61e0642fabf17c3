"""A model run's folder: one unit per model and fold (or final fit), written whole or not at all, so that a broken run can go on.

    predictions/model=<name>/fold_id=<fold>   the fold's predictions
    models/<name>_<fold>                      the fitted model
    manifest/model=<name>/fold=<fold>         one row, written last: how the model is read back, its parameters and inner score
    metrics, confusion, roc                   tables over all folds, made from the predictions at the end of each call
"""
from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, features array<string>, labels array<string>, state string, chosen string, inner_score double"
PREDICTIONS = "y_true string, y_pred string, y_score double, subject_id string"


@dataclass(frozen=True)
class RunStore:
    """The folder of one run. Writing a unit again replaces it."""

    spark: SparkSession
    path: str

    def _there(self, part: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def manifest(self) -> DataFrame:
        """(model, fold, path, features, labels, state, chosen, inner_score) of every finished unit."""
        empty = self.spark.createDataFrame([], f"{MANIFEST}, model string, fold string")
        if not self._there("manifest"):
            return empty
        return self.spark.read.schema(f"{MANIFEST}, model string, fold string").parquet(f"{self.path}/manifest")

    def predictions(self) -> DataFrame:
        schema = f"{PREDICTIONS}, model string, fold_id int"
        if not self._there("predictions"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/predictions")

    def model_path(self, model: str, fold: str) -> str:
        return f"{self.path}/models/{model}_{fold}"

    def write_predictions(self, df: DataFrame, model: str, fold: int) -> None:
        df.select("y_true", "y_pred", F.col("y_score").cast("double").alias("y_score"), "subject_id").write.mode("overwrite").parquet(f"{self.path}/predictions/model={model}/fold_id={fold}")

    def finish(self, model: str, fold: str, path: str, features: list[str], labels: list[str], state: dict, chosen: dict, inner_score: float | None) -> None:
        """The unit's manifest row; what it names has been written."""
        row = (path, features, labels, json.dumps(state), json.dumps(chosen, sort_keys=True), inner_score)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/model={model}/fold={fold}")

    def write_table(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
