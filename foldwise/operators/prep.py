"""Preprocessing fitted on training rows only.

Mean imputation and standardisation are column expressions, not Spark ML
stages: ``ml.feature.StandardScaler`` divides by the sample std and maps a
zero-variance column to 0, and ``Imputer`` fails on an all-null column.  The
scikit-learn contract kept here:

* impute with the training mean of the non-null values (NaN counts as null);
* scale by the *population* std of the imputed training column;
* a zero-variance column is only centred (scale 1);
* a column with no training values is constant 0 after scaling.

``fold_moments`` serves all K folds from one scan: per (fold, column) it
aggregates (rows, n, mean, M2); the training moments of fold f are the merge
of the other K-1 folds (Chan et al. parallel variance).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import null_safe_join


def clean(c: str) -> Column:
    """NaN -> null so one rule handles both."""
    return F.nanvl(F.col(c), F.lit(None).cast("double"))


def column_moments(df: DataFrame, features: list[str], group_cols: list[str]) -> DataFrame:
    """Long table (group..., feature, n_rows, n, mean, m2) from one wide aggregate.

    The aggregate is map-side combined; only len(groups) rows are shuffled.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(features):
        x = clean(c)
        aggs += [F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_m{i}"),
                 (F.var_pop(x) * F.count(x)).alias(f"_q{i}")]
    wide = df.groupBy(*group_cols).agg(*aggs)
    entries = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("feature_idx"),
                        F.col(f"_n{i}").alias("n"), F.col(f"_m{i}").alias("mean"),
                        F.coalesce(F.col(f"_q{i}"), F.lit(0.0)).alias("m2"))
               for i, c in enumerate(features)]
    return (wide.select(*group_cols, F.col("_rows").alias("n_rows"),
                        F.explode(F.array(*entries)).alias("_e"))
            .select(*group_cols, "_e.feature", "_e.feature_idx", "n_rows", "_e.n", "_e.mean", "_e.m2"))


def merge_moments(mom: DataFrame, by: list[str]) -> DataFrame:
    """Merge (n_rows, n, mean, m2) rows that share ``by`` (exact pooled moments)."""
    w = Window.partitionBy(*by)
    pooled_mean = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    m = mom.withColumn("_pm", pooled_mean)
    return m.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"),
        F.first("_pm").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.coalesce(F.col("mean") - F.col("_pm"), F.lit(0.0)), 2))
        .alias("m2"))


def with_scale(mom: DataFrame) -> DataFrame:
    """Add std (population std of the imputed column) and scale (std, or 1 if 0)."""
    std = F.sqrt(F.col("m2") / F.col("n_rows"))
    return (mom.withColumn("std", F.when(F.col("n") > 0, std).otherwise(F.lit(0.0)))
            .withColumn("scale", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0))))


def fold_moments(df: DataFrame, features: list[str], n_folds: int = 10,
                 fold_col: str = "fold", group_cols: list[str] | None = None) -> DataFrame:
    """Training moments of every fold context from one scan.

    Returns (group..., ctx, feature, feature_idx, n_rows, n, mean, m2, std, scale)
    where ctx f means "all rows whose fold != f".
    """
    group_cols = list(group_cols or [])
    per_fold = column_moments(df, features, [*group_cols, fold_col])
    ctx = (per_fold.withColumn("ctx", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
           .filter(F.col("ctx") != F.col(fold_col)).drop(fold_col))
    merged = merge_moments(ctx, [*group_cols, "ctx", "feature", "feature_idx"])
    return with_scale(merged)


def moments(df: DataFrame, features: list[str], group_cols: list[str] | None = None) -> DataFrame:
    """Training moments of a whole table (final test, selection on all training rows)."""
    return with_scale(column_moments(df, features, list(group_cols or [])))


def apply_moments(df: DataFrame, mom: DataFrame, features: list[str],
                  join_cols: list[str], scale: bool = True) -> DataFrame:
    """Impute (and scale) ``df`` with a moments table, joined on ``join_cols``.

    The moments table is pivoted to one row per join key (K rows for folds),
    so the join moves p numbers per key, not per row.
    """
    wide = mom.groupBy(*join_cols).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(f"_mean_{i}") for i, c in enumerate(features)],
        *[F.max(F.when(F.col("feature") == c, F.col("scale"))).alias(f"_sc_{i}") for i, c in enumerate(features)])
    d = null_safe_join(df, wide, join_cols)
    exprs = []
    for i, c in enumerate(features):
        m = F.col(f"_mean_{i}")
        x = F.coalesce(clean(c), m)
        v = (x - m) / F.col(f"_sc_{i}") if scale else x
        exprs.append(F.when(m.isNull(), F.lit(0.0)).otherwise(v).alias(c))
    keep = [c for c in df.columns if c not in features]
    return d.select(*keep, *exprs)


def impute_mean(df: DataFrame, features: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """D1 alone: fill nulls/NaN with the training mean (``fit_on``, default df).

    The fitted state is p numbers (one aggregate row), held like model weights.
    """
    src = fit_on if fit_on is not None else df
    row = src.agg(*[F.avg(clean(c)).alias(c) for c in features]).first()
    keep = [c for c in df.columns if c not in features]
    return df.select(*keep, *[
        (F.coalesce(clean(c), F.lit(float(row[c]))) if row[c] is not None else F.lit(None).cast("double")).alias(c)
        for c in features])


def class_weights(df: DataFrame, label: str = "label", group_cols: list[str] | None = None,
                  out: str = "weight") -> DataFrame:
    """D3: balanced class weight n / (k * n_c), per group (e.g. per fold context)."""
    group_cols = list(group_cols or [])
    counts = df.groupBy(*group_cols, label).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
    counts = counts.withColumn(
        out, F.sum("_nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("_nc")))
    return null_safe_join(df, counts.drop("_nc"), [*group_cols, label])


def label_index(df: DataFrame, label: str = "label", out: str = "label_idx") -> DataFrame:
    """Dense 0-based index of the distinct labels in label order."""
    labels = df.select(label).distinct()
    idx = labels.withColumn(out, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))
    return null_safe_join(df, idx, [label])


def label_domain(*dfs: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels of several tables (train ∪ test), ordered index."""
    u = reduce(lambda a, b: a.unionByName(b), [d.select(label) for d in dfs]).distinct()
    return u.withColumn("label_idx", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))
