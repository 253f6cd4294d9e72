"""Scans of the labelled tables (A1-A3) and the labelled views used by queries.

A labelled table is a DataFrame with a unique ``row_key`` column, a ``label``
column and numeric feature columns.  ``Labelled`` carries the column names so
operators never guess which columns are features.
"""

from __future__ import annotations

import os

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "row_key"
LABEL = "label"


@dataclass(frozen=True)
class Labelled:
    df: DataFrame
    features: tuple[str, ...]
    key: str = KEY
    label: str = LABEL
    extra: tuple[str, ...] = field(default_factory=tuple)

    def with_df(self, df: DataFrame, features=None) -> "Labelled":
        return Labelled(df, tuple(features or self.features), self.key, self.label, self.extra)

    @property
    def columns(self) -> list[str]:
        return [self.key, self.label, *self.features]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# ---------------------------------------------------------------- A1 / A2 ---
def read_labelled_csv(spark: SparkSession, path: str, label_col: str = "Label",
                      schema: T.StructType | None = None,
                      require_label: bool = True) -> Labelled:
    """A1/A2: CSV with header -> features + label.  Every other column is a feature.

    With ``require_label`` a missing label column is an error (A1); without it
    the result has a null label and only predictions make sense (A2).
    ``row_key`` is a content key (see ``_with_content_key``);
    ``monotonically_increasing_id`` is not stable across re-reads.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    raw = reader.csv(path)
    if label_col not in raw.columns:
        if require_label:
            raise ValueError(f"label column {label_col!r} not found in {path}")
        raw = raw.withColumn(label_col, F.lit(None).cast("double"))
    feats = [c for c in raw.columns if c != label_col]
    df = _with_content_key(raw).select(
        KEY, F.col(label_col).alias(LABEL),
        *[F.col(c).cast("double").alias(c) for c in feats])
    return Labelled(df, tuple(feats))


def _with_content_key(df: DataFrame) -> DataFrame:
    """Stable row key without a Python round trip: md5 of the row's values
    plus the copy number among identical rows.  Identical rows are
    interchangeable, so the key multiset does not depend on file order or
    partitioning; counting copies is map-side combined and the copies are
    re-expanded with ``explode(sequence)`` (no window, no hot partition)."""
    cols = df.columns
    content = F.md5(F.to_json(F.struct(*[F.col(c) for c in cols])))
    grouped = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    return (grouped.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
            .withColumn(KEY, F.concat(content, F.lit("#"), F.col("_copy").cast("string")))
            .drop("_copies", "_copy"))


# --------------------------------------------------------------------- A3 ---
def dataset_folders(spark: SparkSession, data_dir: str, file_name: str = "train.csv") -> DataFrame:
    """A3: dataset folders that hold ``file_name``; numeric ids first, then names.

    Lists the files with Spark's binary-file source (metadata only, contents
    are not read) so the listing itself is distributed.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", file_name)
             .option("recursiveFileLookup", "true").load(data_dir).select("path"))
    name = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return (files.select(name.alias("dataset"), F.col("path"))
            .withColumn("dataset_num", F.expr("try_cast(dataset AS INT)"))
            .orderBy(F.col("dataset_num").isNull(), "dataset_num", F.lower("dataset")))


# ----------------------------------------------------- driver-table views ---
# Null injection rule for the lineitem view: the data has no nulls, the
# reference imputes them, so a deterministic rule creates some.
def lineitem_view(spark: SparkSession, sf_dir: str) -> Labelled:
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws(
        "|",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
        F.round(F.col("l_quantity") * 100).cast("bigint").cast("string"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        F.date_format("l_shipdate", "yyyy-MM-dd"))
    df = li.select(
        key.alias(KEY),
        F.col("l_returnflag").alias(LABEL),
        F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.when(F.col("l_linenumber") == 6, F.lit(None)).otherwise(F.col("l_tax")).alias("tax"),
        F.col("l_suppkey").alias("suppkey"),
    )
    return Labelled(df, ("quantity", "extendedprice", "discount", "tax"), extra=("suppkey",))


def vector_length(df: DataFrame, column: str) -> int:
    """The common length of the vectors of a column; mixed lengths are an error."""
    low, high = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise ValueError(f"{column} holds vectors of {low} to {high} entries")
    return int(low or 0)


def embeddings_view(spark: SparkSession, sf_dir: str) -> Labelled:
    emb = table(spark, sf_dir, "embeddings")
    n_dims = vector_length(emb.where("embedding IS NOT NULL"), "embedding")
    feats = [f"f{i + 1}" for i in range(n_dims)]
    df = emb.select(
        F.col("vec_id").alias(KEY), F.col("label").alias(LABEL),
        *[F.col("embedding")[i].cast("double").alias(feats[i]) for i in range(n_dims)])
    return Labelled(df, tuple(feats))


def orders_view(spark: SparkSession, sf_dir: str) -> Labelled:
    o = table(spark, sf_dir, "orders")
    df = o.select(F.col("o_orderkey").alias(KEY), F.col("o_orderpriority").alias(LABEL),
                  F.col("o_totalprice").alias("totalprice"),
                  (F.col("o_custkey") % 100).cast("double").alias("cust_mod"))
    return Labelled(df, ("totalprice", "cust_mod"))


def documents_view(spark: SparkSession, sf_dir: str) -> Labelled:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    text = F.coalesce(F.col("text"), F.lit(""))
    df = d.join(lab, "doc_id").select(
        F.col("doc_id").alias(KEY), F.col("quality").alias(LABEL),
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, " ", "")) + 1).cast("double").alias("n_words"),
        F.length(F.regexp_replace(text, "[^0-9]", "")).cast("double").alias("n_digits"),
        (F.length(text) - F.length(F.regexp_replace(text, "\n", "")) + 1).cast("double").alias("n_lines"))
    return Labelled(df, ("n_chars", "n_words", "n_digits", "n_lines"))


def events_view(spark: SparkSession, sf_dir: str) -> Labelled:
    e = table(spark, sf_dir, "events")
    df = e.select(F.col("event_id").alias(KEY), F.col("event_type").alias(LABEL),
                  F.col("value").alias("value"),
                  F.col("user_id").cast("double").alias("user_id"),
                  F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("k"))
    return Labelled(df, ("value", "user_id", "k"))


VIEWS = {
    "li": lineitem_view,
    "emb": embeddings_view,
    "ord": orders_view,
    "doc": documents_view,
    "ev": events_view,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> Labelled:
    return VIEWS[name](spark, sf_dir)
