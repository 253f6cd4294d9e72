"""Prediction metrics (I3-I9) from a long confusion table.

Everything derives from ``confusion`` = (group..., actual, predicted, n), the
output of one map-side-combined ``groupBy``: at most k² rows per group reach
the shuffle, whatever the number of scored rows.

Macro F1 follows the scikit-learn default used by the reference: average of
per-label F1 over the labels present in truth *or* prediction, 0 where
undefined.  (``MulticlassClassificationEvaluator('f1')`` is the weighted F1,
so it is not used.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ratio_round(num, den, digits: int = 4):
    """num / den rounded half-up to ``digits`` with integer arithmetic, so a
    ratio such as 41967/60000 = 0.69945 rounds the same way everywhere."""
    scale = 10 ** digits
    return F.floor((F.lit(2 * scale) * num + den) / (F.lit(2) * den)) / F.lit(float(scale))


def confusion(df: DataFrame, actual: str = "label", predicted: str = "prediction",
              group_cols: list[str] | None = None) -> DataFrame:
    """I5 (long form): counts per (group, actual, predicted)."""
    g = list(group_cols or [])
    return (df.groupBy(*g, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def per_class_f1(conf: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Per (group, label): support, predicted count, true positives, precision, recall, f1."""
    g = list(group_cols or [])
    hit = (F.col("actual") == F.col("predicted")).cast("long") * F.col("n")
    sides = conf.select(*g, F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("n_actual"),
                 F.lit(0).cast("long").alias("n_pred"), hit.alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("n_actual"),
                 F.col("n").alias("n_pred"), F.lit(0).cast("long").alias("tp")))).alias("s"))
    per = (sides.groupBy(*g, "s.label")
           .agg(F.sum("s.n_actual").alias("support"), F.sum("s.n_pred").alias("n_pred"),
                F.sum("s.tp").alias("tp")))
    return (per
            .withColumn("precision", F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0))
            .withColumn("recall", F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0))
            .withColumn("f1", F.when(F.col("support") + F.col("n_pred") > 0,
                                     2.0 * F.col("tp") / (F.col("support") + F.col("n_pred"))).otherwise(0.0)))


def accuracy_macro_f1(conf: DataFrame, group_cols: list[str] | None = None,
                      digits: int | None = 4) -> DataFrame:
    """I3 + I4 (+ I8 counts): accuracy, macro F1, samples and labels per group."""
    g = list(group_cols or [])
    if not g:
        return accuracy_macro_f1(conf.withColumn("_all", F.lit(0)), ["_all"], digits).drop("_all")
    hits = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    acc = conf.groupBy(*g).agg(
        (ratio_round(hits, F.sum("n"), digits) if digits is not None else hits / F.sum("n")).alias("accuracy"),
        F.sum("n").alias("n_samples"))
    f1 = (per_class_f1(conf, g).groupBy(*g)
          .agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_labels")))
    out = acc.join(f1, g)
    if digits is not None:
        out = out.withColumn("macro_f1", F.round("macro_f1", digits))
    return out


def domain_labels(*dfs: DataFrame, label: str = "label") -> list:
    """Sorted distinct labels of train ∪ test.  Bounded by the class count; it
    is plan metadata (pivot values, grid), like a parameter grid."""
    from functools import reduce
    u = reduce(lambda a, b: a.unionByName(b), [d.select(F.col(label).alias("l")) for d in dfs])
    return [r["l"] for r in u.distinct().orderBy("l").collect()]


def confusion_on_domain(conf: DataFrame, labels: list,
                        group_cols: list[str] | None = None) -> DataFrame:
    """I5 on the full label domain (train ∪ test): every (actual, predicted)
    pair of the k domain labels, zero-filled.  The k² grid is generated per
    group with ``explode`` of a literal array, no cross join."""
    g = list(group_cols or [])
    arr = F.array(*[F.lit(v) for v in labels])
    base = conf.select(*g).distinct() if g else conf.sparkSession.range(1).select()
    grid = (base.withColumn("actual", F.explode(arr)).withColumn("predicted", F.explode(arr)))
    return (grid.join(conf, [*g, "actual", "predicted"], "left")
            .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("long")))


def confusion_wide(conf_full: DataFrame, labels: list, group_cols: list[str] | None = None) -> DataFrame:
    """I5 wide: index ``actual``, one column per predicted label (export form)."""
    g = list(group_cols or [])
    return (conf_full.groupBy(*g, "actual").pivot("predicted", labels).agg(F.sum("n"))
            .fillna(0))


def row_percent(conf_full: DataFrame, group_cols: list[str] | None = None, digits: int = 2) -> DataFrame:
    """Row-percent confusion with row, column and grand totals.

    Totals come from GROUPING SETS; an empty actual row is 0 %.
    ``actual``/``predicted`` are null on total rows/columns, flagged by
    ``is_row_total``/``is_col_total``.
    """
    g = list(group_cols or [])
    cube = (conf_full.cube(*g, "actual", "predicted").agg(F.sum("n").alias("n"),
                                                           F.grouping("actual").alias("_ga"),
                                                           F.grouping("predicted").alias("_gp"),
                                                           *[F.grouping(c).alias(f"_g_{c}") for c in g]))
    for c in g:
        cube = cube.filter(F.col(f"_g_{c}") == 0).drop(f"_g_{c}")
    w = Window.partitionBy(*g, "actual", "_ga")
    row_total = F.sum(F.when(F.col("_gp") == 1, F.col("n"))).over(w)
    return (cube.withColumn("row_pct", F.when(row_total > 0, ratio_round(100 * F.col("n"), row_total, digits))
                            .otherwise(0.0))
            .withColumn("is_row_total", F.col("_ga") == 1)
            .withColumn("is_col_total", F.col("_gp") == 1)
            .drop("_ga", "_gp"))


def prediction_distribution(pred: DataFrame, predicted: str = "prediction",
                            group_cols: list[str] | None = None, digits: int = 2) -> DataFrame:
    """Class, count, percent of the predictions."""
    g = list(group_cols or [])
    w = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    return (pred.groupBy(*g, F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("pct", ratio_round(100 * F.col("n"), F.sum("n").over(w), digits)))


def correct_flags(pred: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Per-row correct flag (null when the actual is unknown)."""
    return pred.withColumn("correct", F.col(predicted) == F.col(actual))
