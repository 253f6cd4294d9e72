"""Report aggregates over fold / summary / test records.

Fold metrics are 4-decimal numbers; means of them tie at the fifth decimal
often, so means are taken over ``decimal(12,4)`` (exact) and rounded half-even
(``bround``), the rule that reproduces the reference's stored summaries.
Text cells are built from the rounded decimals, never from binary formatting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Classifier display order used by the reference's reports.
CLASSIFIER_ORDER = ["SVM", "KNN", "DT", "RF", "MLP"]


def _dec(c: str) -> Column:
    return F.col(c).cast("decimal(12,4)")


def _mean4(c: str) -> Column:
    return F.bround(F.avg(_dec(c)), 4).cast("double")


def _std4(c: str) -> Column:
    return F.bround(F.stddev_samp(F.col(c).cast("double")), 4)


def _text(mean: Column, std: Column, sep: str) -> Column:
    fmt = lambda x: F.coalesce(x.cast("decimal(12,4)").cast("string"), F.lit("nan"))
    return F.concat(fmt(mean), F.lit(sep), fmt(std))


def fold_summary(folds: DataFrame, group_cols: list[str], metrics=("accuracy", "f1"),
                 sep: str = " ± ") -> DataFrame:
    """Mean and sample std of the fold metrics per group, plus text."""
    aggs = []
    for m in metrics:
        aggs += [F.round(F.avg(_dec(m)), 4).alias(f"_{m}_mean_hu"),
                 _mean4(m).alias(f"{m}_mean"), _std4(m).alias(f"{m}_std")]
    out = folds.groupBy(*group_cols).agg(*aggs)
    for m in metrics:
        # text: the exact (decimal) mean rounded half-up, std rounded to 4
        out = out.withColumn(f"{m}_text", _text(F.col(f"_{m}_mean_hu"), F.col(f"{m}_std"), sep)) \
            .drop(f"_{m}_mean_hu")
    return out


def phase2_summary(folds: DataFrame, group_cols: list[str]) -> DataFrame:
    """J1 plus features before and mean features after (1 decimal)."""
    s = fold_summary(folds, group_cols)
    feats = folds.groupBy(*group_cols).agg(
        F.first("n_features_before").alias("avg_features_before"),
        F.bround(F.avg(F.col("n_features_after").cast("decimal(12,4)")), 1).cast("double")
        .alias("avg_features_after"))
    return s.join(feats, group_cols)


def modal_value(df: DataFrame, group_cols: list[str], value_cols: list[str],
                seq_col: str) -> DataFrame:
    """Most frequent non-null value (as text) per column and group.

    Ties go to the value seen first (smallest ``seq_col``); a column with no
    values gives "N/A".  Long form: (group..., param, value).
    """
    stacked = df.select(*group_cols, seq_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("param"), _as_text(F.col(c), df.schema[c].dataType).alias("value"))
        for c in value_cols])).alias("e")) \
        .select(*group_cols, seq_col, "e.param", "e.value")
    counts = (stacked.filter(F.col("value").isNotNull())
              .groupBy(*group_cols, "param", "value")
              .agg(F.count(F.lit(1)).alias("n"), F.min(seq_col).alias("first_seq")))
    w = Window.partitionBy(*group_cols, "param").orderBy(F.desc("n"), F.asc("first_seq"))
    best = counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*group_cols, "param", "value")
    params = stacked.select(*group_cols, "param").distinct()
    return (params.join(best, [*group_cols, "param"], "left")
            .withColumn("value", F.coalesce("value", F.lit("N/A"))))


def _as_text(c: Column, dtype=None) -> Column:
    """Text of a parameter value.  Doubles go through a fixed-point decimal so
    there is no scientific notation, and whole doubles lose the '.0'
    (10.0 -> 10, 0.0001 -> 0.0001)."""
    from pyspark.sql import types as T
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        s = c.cast("decimal(20,10)").cast("string")
        return F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")
    return c.cast("string")


# Report text layout per classifier (parameter, label) pairs.
PARAM_LAYOUT = {
    "SVM": [("best_kernel", "kernel"), ("best_c", "C"), ("best_gamma", "gamma")],
    "KNN": [("best_k", "k"), ("best_metric", "metric")],
    "DT": [("best_max_depth", "max_depth"), ("best_min_split", "min_samples_split"),
           ("best_criterion", "criterion")],
    "RF": [("best_n_estimators", "n_estimators"), ("best_max_depth", "max_depth"),
           ("best_min_samples_split", "min_samples_split")],
    "MLP": [("best_hidden_layers", "hidden_layers"), ("best_learning_rate", "lr"),
            ("best_alpha", "alpha")],
}


def param_summary(folds: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Per (classifier, phase) the per-column modal parameters as one text.

    SVM with a linear modal kernel omits gamma, as in the reference table.
    """
    cols = sorted({p for layout in PARAM_LAYOUT.values() for p, _ in layout})
    modes = modal_value(folds, ["classifier", "phase"], cols, seq_col)
    wide = modes.groupBy("classifier", "phase").pivot("param", cols).agg(F.first("value"))
    text = None
    for clf, layout in PARAM_LAYOUT.items():
        parts = []
        for i, (p, name) in enumerate(layout):
            piece = F.concat(F.lit(("" if i == 0 else ", ") + name + "="), F.col(p))
            if clf == "SVM" and p == "best_gamma":
                piece = F.when(F.col("best_kernel") == "linear", F.lit("")).otherwise(piece)
            parts.append(piece)
        expr = F.concat(*parts)
        text = F.when(F.col("classifier") == clf, expr) if text is None else text.when(F.col("classifier") == clf, expr)
    return wide.select("classifier", "phase", text.otherwise(F.lit("N/A")).alias("best_hyperparameters"))


def results_pivot(summaries: DataFrame, metric: str = "f1") -> DataFrame:
    """Rows (dataset, phase), one column per classifier, "mean +/- std", gaps "N/A"."""
    cell = _text(F.col(f"{metric}_mean"), F.col(f"{metric}_std"), " +/- ")
    return (summaries.withColumn("cell", cell)
            .groupBy("dataset_name", "phase").pivot("classifier", CLASSIFIER_ORDER).agg(F.first("cell"))
            .fillna("N/A"))


def dataset_group(dataset_num: Column) -> Column:
    """Dataset group bucket."""
    return F.when(dataset_num.between(1, 8), F.lit("1-8")).when(dataset_num.between(9, 16), F.lit("9-16"))


def phase_comparison(summaries: DataFrame, value: str = "f1_mean", digits: int = 4) -> DataFrame:
    """Mean and sample std of a per-dataset value by group x classifier x phase."""
    return (summaries.withColumn("dataset_group", dataset_group(F.col("dataset")))
            .groupBy("dataset_group", "classifier", "phase")
            .agg(_mean4(value).alias("mean"),
                 F.coalesce(_std4(value), F.lit(0.0)).alias("std"),
                 F.count(F.lit(1)).alias("n_datasets")))


def best_classifier(summaries: DataFrame, value: str = "f1_mean", digits: int = 4) -> DataFrame:
    """Per phase, mean/std of ``value`` per classifier and the arg-max
    (first in the fixed classifier order wins ties)."""
    order = F.create_map(*[x for i, c in enumerate(CLASSIFIER_ORDER) for x in (F.lit(c), F.lit(i))])
    per = (summaries.groupBy("phase", "classifier")
           .agg(_mean4(value).alias("mean"),
                F.coalesce(_std4(value), F.lit(0.0)).alias("std")))
    w = Window.partitionBy("phase").orderBy(F.desc("mean"), F.coalesce(order[F.col("classifier")], F.lit(999)))
    return per.withColumn("is_best", F.row_number().over(w) == 1)


def feature_reduction(folds: DataFrame) -> DataFrame:
    """Mean features before/after per dataset, from the SVM phase-2 rows."""
    return (folds.filter((F.col("classifier") == "SVM") & (F.col("phase") == "After FS/DR"))
            .groupBy("dataset").agg(F.round(F.avg("n_features_before"), 1).alias("features_before"),
                                    F.round(F.avg("n_features_after"), 1).alias("features_after")))


def std_comparison(summaries: DataFrame, digits: int = 4) -> DataFrame:
    """Mean of the fold std by group x classifier x phase."""
    return (summaries.withColumn("dataset_group", dataset_group(F.col("dataset")))
            .groupBy("dataset_group", "classifier", "phase")
            .agg(_mean4("f1_std").alias("mean_f1_std")))


def test_f1_pivot(tests: DataFrame, by_group: bool = False, digits: int = 4) -> DataFrame:
    """Mean test macro-F1 by (group,) classifier, pivoted to phases;
    every classifier of the fixed order appears, gaps 0."""
    keys = ["dataset_group"] if by_group else []
    t = tests.withColumn("dataset_group", dataset_group(F.col("dataset"))) if by_group else tests
    piv = (t.groupBy(*keys, "classifier").pivot("phase", ["Before FS/DR", "After FS/DR"])
           .agg(_mean4("test_f1_macro")))
    spine = t.sparkSession.createDataFrame([(c, i) for i, c in enumerate(CLASSIFIER_ORDER)],
                                           "classifier string, clf_order int")
    if by_group:
        spine = spine.withColumn("dataset_group", F.explode(F.array(F.lit("1-8"), F.lit("9-16"))))
    out = spine.join(piv, [*keys, "classifier"], "left").fillna(0.0, ["Before FS/DR", "After FS/DR"])
    return out.withColumnsRenamed({"Before FS/DR": "before_fs", "After FS/DR": "after_fs"})


def dataset_classifier_matrix(tests: DataFrame, phase: str) -> DataFrame:
    """Dataset x classifier matrix of test F1 for one phase; gaps stay null."""
    t = tests.filter(F.col("phase") == phase)
    grid = t.select("dataset").distinct()
    piv = t.groupBy("dataset").pivot("classifier", CLASSIFIER_ORDER).agg(F.first("test_f1_macro"))
    return grid.join(piv, "dataset", "left")


def merge_dedupe(results: DataFrame, key_cols: list[str], seq_col: str, source_col: str) -> DataFrame:
    """Drop exact duplicates (within a source file), keep the last row per
    key, sort by natural dataset order then classifier order (stable on seq)."""
    data_cols = [c for c in results.columns if c != seq_col]
    dedup = results.groupBy(*data_cols).agg(F.min(seq_col).alias(seq_col))
    w = Window.partitionBy(*key_cols).orderBy(F.desc(seq_col))
    last = dedup.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return last.withColumn("dataset_sort", natural_key(F.col("dataset_name"))) \
        .withColumn("classifier_sort", classifier_key(F.col("classifier"))) \
        .orderBy("dataset_sort", "classifier_sort", seq_col)


def global_mean_std(folds: DataFrame, digits: int = 4) -> DataFrame:
    """Mean and sample std per classifier (and phase) over all folds of all datasets."""
    return folds.groupBy("phase", "classifier").agg(
        _mean4("accuracy").alias("accuracy_mean"), _std4("accuracy").alias("accuracy_std"),
        _mean4("f1").alias("f1_mean"), _std4("f1").alias("f1_std"),
        F.count(F.lit(1)).alias("n_folds"))


def fold_lookup(folds: DataFrame, phase: str) -> DataFrame:
    """(dataset, fold) rows with accuracy, F1 and parameters per classifier."""
    f = fold_parameters(folds.filter(F.col("phase") == phase))
    return (f.groupBy("dataset", "fold").pivot("classifier", CLASSIFIER_ORDER)
            .agg(F.first("accuracy").alias("acc"), F.first("f1").alias("f1"),
                 F.first("parameters").alias("parameters")))


def fold_parameters(folds: DataFrame) -> DataFrame:
    """Fold records with ``parameters``: the text of the classifier's own Best
    columns ("name=value, ..."); a missing value is N/A."""
    text = F.lit(None).cast("string")
    for clf, layout in PARAM_LAYOUT.items():
        own = [F.concat(F.lit(f"{name}="), F.coalesce(_as_text(F.col(p), folds.schema[p].dataType), F.lit("N/A")))
               for p, name in layout]
        text = F.when(F.col("classifier") == clf, F.concat_ws(", ", *own)).otherwise(text)
    return folds.withColumn("parameters", text)


def sort_folds(folds: DataFrame) -> DataFrame:
    """K1: fold records by dataset (natural order), classifier and fold number,
    with ``fold_rank``, the place of the fold among those of its classifier."""
    w = Window.partitionBy("phase", "dataset_name", "classifier").orderBy("fold")
    return folds.withColumn("fold_rank", F.row_number().over(w)).orderBy(
        "phase", natural_key(F.col("dataset_name")), classifier_key(F.col("classifier")), "fold")


# ------------------------------------------------------------------- K ---
def natural_key(name: Column) -> Column:
    """K2: trailing number of a dataset name; none sorts last."""
    num = F.regexp_extract(name, r"(\d+)$", 1)
    return F.when(num != "", num.cast("bigint")).otherwise(F.lit(2**62))


def classifier_key(clf: Column) -> Column:
    """K3: fixed classifier order SVM, KNN, DT, RF, MLP; others 999."""
    order = F.create_map(*[x for i, c in enumerate(CLASSIFIER_ORDER) for x in (F.lit(c), F.lit(i))])
    return F.coalesce(order[F.upper(clf)], F.lit(999))
