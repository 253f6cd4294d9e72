"""A fitted ``PipelineModel`` scores a batch or a streaming DataFrame.

The reference has no streams; this is the one extension its scoring entry
point allows for free, because ``transform`` accepts a streaming frame.
Columns are aligned to the model's input (B3: extra columns dropped, a
missing column is an error) and each micro-batch's predictions get the
correct flag (I9) when a label is present.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.results import align


def score_batch(model: PipelineModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Predictions of a batch; input without rows or without a column of the
    model is an error.  ``keep`` names the columns to carry (all others than the
    model's by default)."""
    cols = model_input_columns(model)
    if df.isEmpty():
        raise ValueError("the input to score has no rows")
    keep = [c for c in df.columns if c not in cols] if keep is None else keep
    return model.transform(align(df, cols, keep=keep)).select(*keep, "prediction")


def class_probabilities(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., label_idx, probability) of every class; a model without
    probabilities (the support vector machines) is an error."""
    if df.isEmpty():
        raise ValueError("the input to score has no rows")
    last = model.stages[-1]
    if not last.hasParam("probabilityCol"):
        raise ValueError(f"{type(last).__name__} gives no class probabilities")
    rows = model.transform(align(df, model_input_columns(model), keep=keep))
    return rows.select(*keep, F.posexplode(vector_to_array(last.getOrDefault("probabilityCol"))).alias("label_idx", "probability"))


def model_input_columns(model: PipelineModel) -> list[str]:
    for st in model.stages:
        if hasattr(st, "getInputCols"):
            return list(st.getInputCols())
    raise ValueError("model has no assembler stage")


def score_stream(model: PipelineModel, stream: DataFrame, key: str = "row_key",
                 label: str | None = "label") -> DataFrame:
    cols = model_input_columns(model)
    missing = [c for c in cols if c not in stream.columns]
    if missing:
        raise ValueError(f"stream lacks model columns: {missing}")
    keep = [key] + ([label] if label and label in stream.columns else [])
    out = model.transform(stream.select(*keep, *cols)).select(*keep, "prediction")
    if label and label in stream.columns:
        out = out.withColumn("correct", F.col("prediction") == F.col(label))
    return out
