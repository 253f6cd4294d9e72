"""Rule-based predictors and the shared ``rule_folds`` fold-record table.

The reference's own datasets are not shipped, so the report operators (J)
run on fold records produced here from the lineitem view: dataset =
``suppkey % 16 + 1``, folds by E1 inside each dataset, and five fixed CASE
predictors standing in for the five classifier families, in two variants
("Before FS/DR" uses all four columns, "After FS/DR" fewer).  The CASE texts
are plain SQL so that the DuckDB oracle evaluates the very same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import accuracy_macro_f1, confusion
from ..operators.split import stratified_folds
from ..sources.tables import lineitem_view

PHASE_BEFORE = "Before FS/DR"
PHASE_AFTER = "After FS/DR"
CLASSIFIERS = ("SVM", "KNN", "DT", "RF", "MLP")

# (classifier, phase) -> (CASE predictor over the lineitem view, columns it uses)
RULES = {
    ("SVM", PHASE_BEFORE): ("CASE WHEN coalesce(quantity, 25) + 400 * discount > 35 THEN 'R' "
                            "WHEN tax > 0.04 THEN 'A' ELSE 'N' END",
                            ["quantity", "discount", "tax"]),
    ("SVM", PHASE_AFTER): ("CASE WHEN discount > 0.05 THEN 'R' ELSE 'N' END", ["discount"]),
    ("KNN", PHASE_BEFORE): ("CASE WHEN extendedprice > 50000 THEN 'A' "
                            "WHEN coalesce(quantity, 0) > 20 THEN 'R' ELSE 'N' END",
                            ["quantity", "extendedprice"]),
    ("KNN", PHASE_AFTER): ("CASE WHEN extendedprice > 50000 THEN 'A' ELSE 'N' END", ["extendedprice"]),
    ("DT", PHASE_BEFORE): ("CASE WHEN coalesce(tax, 0.04) < 0.02 THEN 'N' "
                           "WHEN discount < 0.03 THEN 'A' ELSE 'R' END", ["discount", "tax"]),
    ("DT", PHASE_AFTER): ("CASE WHEN discount < 0.03 THEN 'A' ELSE 'R' END", ["discount"]),
    ("RF", PHASE_BEFORE): ("CASE WHEN extendedprice / coalesce(quantity, 25) > 1500 THEN 'A' "
                           "WHEN discount > 0.06 THEN 'R' ELSE 'N' END",
                           ["quantity", "extendedprice", "discount"]),
    ("RF", PHASE_AFTER): ("CASE WHEN extendedprice > 40000 THEN 'R' ELSE 'A' END", ["extendedprice"]),
    ("MLP", PHASE_BEFORE): ("CASE WHEN tax + discount > 0.1 THEN 'A' "
                            "WHEN coalesce(quantity, 0) < 10 THEN 'N' ELSE 'R' END",
                            ["quantity", "discount", "tax"]),
    ("MLP", PHASE_AFTER): ("CASE WHEN tax > 0.05 THEN 'A' ELSE 'N' END", ["tax"]),
}

LI_FEATURES = ["quantity", "extendedprice", "discount", "tax"]

# Best_* parameter columns of a fold record, as SQL over (dataset, fold1).
# fold1 is the 1-based fold number.  Shared with the oracle.
PARAM_SQL = {
    "best_kernel": "CASE WHEN classifier = 'SVM' THEN CASE WHEN (dataset + fold1) % 3 = 0 THEN 'rbf' ELSE 'linear' END END",
    "best_c": "CASE WHEN classifier = 'SVM' THEN CASE (dataset * fold1) % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 1.0 ELSE 10.0 END END",
    "best_gamma": "CASE WHEN classifier = 'SVM' THEN CASE WHEN (dataset + fold1) % 3 = 0 THEN CASE WHEN fold1 % 2 = 0 THEN 'scale' ELSE 'auto' END ELSE 'N/A' END END",
    "best_k": "CASE WHEN classifier = 'KNN' THEN 3 + 2 * ((dataset + fold1) % 5) END",
    "best_metric": "CASE WHEN classifier = 'KNN' THEN CASE WHEN dataset % 2 = 0 THEN 'euclidean' ELSE 'manhattan' END END",
    "best_max_depth": "CASE WHEN classifier = 'DT' THEN CASE (dataset + fold1) % 4 WHEN 0 THEN NULL WHEN 1 THEN 3.0 WHEN 2 THEN 5.0 ELSE 10.0 END "
                      "WHEN classifier = 'RF' THEN CASE WHEN fold1 % 3 = 0 THEN NULL WHEN dataset % 3 = 0 THEN 5.0 ELSE 10.0 END END",
    "best_min_split": "CASE WHEN classifier = 'DT' THEN CASE fold1 % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 10 END END",
    "best_criterion": "CASE WHEN classifier = 'DT' THEN CASE WHEN dataset % 2 = 0 THEN 'gini' ELSE 'entropy' END END",
    "best_n_estimators": "CASE WHEN classifier = 'RF' THEN CASE WHEN (dataset + fold1) % 2 = 0 THEN 100 ELSE 200 END END",
    "best_min_samples_split": "CASE WHEN classifier = 'RF' THEN CASE WHEN dataset % 2 = 0 THEN 2 ELSE 5 END END",
    "best_hidden_layers": "CASE WHEN classifier = 'MLP' THEN CASE (dataset + fold1) % 3 WHEN 0 THEN '(64,)' WHEN 1 THEN '(128,)' ELSE '(64, 64)' END END",
    "best_learning_rate": "CASE WHEN classifier = 'MLP' THEN CASE WHEN fold1 % 2 = 0 THEN 0.001 ELSE 0.01 END END",
    "best_alpha": "CASE WHEN classifier = 'MLP' THEN CASE WHEN dataset % 2 = 0 THEN 0.0001 ELSE 0.001 END END",
}
PARAM_TYPES = {
    "best_kernel": "string", "best_c": "double", "best_gamma": "string", "best_k": "int",
    "best_metric": "string", "best_max_depth": "double", "best_min_split": "int",
    "best_criterion": "string", "best_n_estimators": "int", "best_min_samples_split": "int",
    "best_hidden_layers": "string", "best_learning_rate": "double", "best_alpha": "double",
}


def rule_view(spark: SparkSession, sf_dir: str, with_folds: bool = True) -> DataFrame:
    """Lineitem view with dataset and (optionally) per-dataset stratified fold."""
    v = lineitem_view(spark, sf_dir)
    df = v.df.withColumn("dataset", (F.col("suppkey") % 16 + 1).cast("int"))
    return stratified_folds(df, group_cols=["dataset"]) if with_folds else df


def rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per (phase, classifier, row): 10 rules x rows.

    All ten CASE predictors are evaluated in one projection before the folds are
    assigned, so the table is scanned once and the shuffle of the ranks carries a
    row's predictions as one short string, not its features.
    """
    base = rule_view(spark, sf_dir, with_folds=False).select(
        "row_key", "dataset", "label",
        F.concat_ws(",", *[F.coalesce(F.expr(sql), F.lit("")) for sql, _ in RULES.values()]).alias("_preds"))
    base = stratified_folds(base, group_cols=["dataset"]).withColumn("_preds", F.split("_preds", ",", -1))
    preds = F.array(*[F.struct(F.lit(ph).alias("phase"), F.lit(clf).alias("classifier"),
                               F.nullif(F.col("_preds")[i], F.lit("")).alias("prediction"))
                      for i, (clf, ph) in enumerate(RULES)])
    return base.select("row_key", "dataset", "fold", "label", F.explode(preds).alias("p")) \
        .select("row_key", "dataset", "fold", "label", "p.phase", "p.classifier", "p.prediction")


def rule_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold records (phase, dataset, classifier, fold, accuracy, f1, Best_*, features)."""
    preds = rule_predictions(spark, sf_dir)
    g = ["phase", "dataset", "classifier", "fold"]
    m = accuracy_macro_f1(confusion(preds, group_cols=g), g)
    m = m.withColumn("fold1", F.col("fold") + 1)
    sel = F.create_map(*[x for (clf, ph), (_, cols) in RULES.items()
                         for x in (F.lit(f"{clf}|{ph}"), F.array(*[F.lit(c) for c in cols]))])
    out = m.select(
        "phase", F.concat(F.lit("dataset_"), F.col("dataset").cast("string")).alias("dataset_name"),
        "dataset", "classifier", F.col("fold1").alias("fold"),
        F.col("accuracy"), F.col("macro_f1").alias("f1"),
        *[F.expr(sql).cast(PARAM_TYPES[c]).alias(c) for c, sql in PARAM_SQL.items()],
        F.lit(len(LI_FEATURES)).alias("n_features_before"),
        F.size(sel[F.concat_ws("|", "classifier", "phase")]).alias("n_features_after"),
        sel[F.concat_ws("|", "classifier", "phase")].alias("selected_features"))
    return out
