"""Registered queries, part 3: fitted models (F, G, H1 with a forest, I1/I2, A11).

Model scores depend on solver and random sequence, so these queries have no
SQL oracle; tests check invariants instead (see tests/test_models.py).
"""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest
from ..operators import metrics, prep, select, split
from ..operators.models import classifiers as C
from ..operators.models import mlp, treemodel, trees
from ..session import cut_lineage, materialize, null_safe_join, run_folder
from ..sources.results import model_registry
from ..sources.tables import view
from . import final, tune

# F9 defaults of the final-test factory (fixed values of the reference)
FINAL_SPECS = [C.spec("DT", max_depth=None, min_samples_split=2, criterion="gini"),
               C.spec("RF", n_estimators=100, max_depth=None, min_samples_split=2),
               C.spec("SVM_LINEAR", kernel="linear", C=1.0, gamma="N/A")]


def _emb_split(spark, sf):
    """Training part (folds 1-9) and test part (fold 0) of the embeddings view."""
    v = view(spark, sf, "emb")
    f = cut_lineage(split.stratified_folds(v.df))   # fits plan against a plain scan
    return f.filter("fold != 0").drop("fold"), f.filter("fold = 0").drop("fold"), list(v.features)


def fitted_preprocessing(train: DataFrame, feats: list[str]) -> SQLTransformer:
    """D1+D2 fitted on ``train`` and frozen as SQL (persistable in a PipelineModel)."""
    stats = {r["feature"]: (r["mean"], r["scale"]) for r in prep.moments(train, feats).collect()}
    exprs = []
    for c in feats:
        m, s = stats[c]
        if m is None:
            exprs.append(f"CAST(0.0 AS DOUBLE) AS `{c}`")
        else:
            exprs.append(f"(coalesce(nanvl(`{c}`, CAST(NULL AS DOUBLE)), {float(m)!r}) - {float(m)!r}) / {float(s)!r} AS `{c}`")
    return SQLTransformer(statement="SELECT * EXCEPT (" + ", ".join(f"`{c}`" for c in feats) + "), "
                          + ", ".join(exprs) + " FROM __THIS__")


def fit_pipeline(train: DataFrame, feats: list[str], s: C.Spec, labels: DataFrame,
                 balanced: bool = False) -> PipelineModel:
    """Impute -> scale -> assemble -> estimator, as one Spark ML PipelineModel."""
    n_classes = labels.count()
    tr = null_safe_join(train, labels, ["label"]).withColumn("label_idx", F.col("label_idx").cast("double"))
    if balanced:
        tr = prep.class_weights(tr, "label")
    n_train = train.count()
    # rows in key order in a number of partitions that depends on their count alone
    tr = tr.repartition(max(1, -(-n_train // tune.FIT_ROWS)), "row_key").sortWithinPartitions("row_key")
    est = C.build(s, n_train, n_classes, weighted=balanced)
    pipe = Pipeline(stages=[fitted_preprocessing(train, feats),
                            VectorAssembler(inputCols=feats, outputCol="features"), est])
    return pipe.fit(tr)


def fit_tree(train: DataFrame, feats: list[str], s: C.Spec, labels: DataFrame) -> treemodel.TreeModel:
    """Impute -> scale -> tree or forest, grown by Spark tasks."""
    return treemodel.fit_tree(train, feats, s, null_safe_join(train, labels, ["label"]), labels.count())


def _labelled_predictions(model: PipelineModel, test: DataFrame, labels: DataFrame) -> DataFrame:
    lab = labels.select(F.col("label_idx").cast("double").alias("prediction"), F.col("label").alias("_pl"))
    return model.transform(test).join(lab, "prediction").drop("prediction") \
        .withColumnRenamed("_pl", "prediction")


def tuned_params(spark, sf, phase: str) -> dict:
    """The parameter table (J5 of the rule folds, written and scanned as CSV)."""
    from ..sources.results import read_param_table
    from . import catalog_reports, rules
    path = run_folder(spark, "parameters")
    t = catalog_reports.q_param_summary(spark, sf)
    t.select(F.col("classifier").alias("Classifier"), F.col("phase").alias("Phase"),
             F.col("best_hyperparameters").alias("Best Hyperparameters")).write.option("header", True).csv(path)
    return final.params_of(read_param_table(spark, path, phase or rules.PHASE_BEFORE))


def _emb_final(spark, sf, keep=None) -> final.FinalData:
    v = view(spark, sf, "emb")
    return final.prepare_final(v.df.withColumn("dataset", F.lit(1)), list(v.features), "dataset", keep)


def q_final_test_phase1(spark, sf):
    """The five families with the tuned parameters on the embeddings view."""
    from .rules import PHASE_BEFORE
    return final.final_test(_emb_final(spark, sf), tuned_params(spark, sf, PHASE_BEFORE), "phase1")


def q_final_test_datasets(spark, sf):
    """Every dataset of the lineitem view, five families with the tuned parameters."""
    from . import rules
    base = rules.rule_view(spark, sf, with_folds=False)
    data = final.prepare_final(base, rules.LI_FEATURES, "dataset")
    return final.final_test(data, tuned_params(spark, sf, rules.PHASE_BEFORE), "phase1")


def q_final_test_sizes(spark, sf):
    """What a final test of every dataset is made on: rows of both
    parts, columns and classes (of the training part)."""
    from . import rules
    data = final.prepare_final(rules.rule_view(spark, sf, with_folds=False), rules.LI_FEATURES, "dataset")
    rows = data.base.groupBy(F.col("ctx").alias("dataset")).agg(
        F.count(F.when(F.col("fold") != 0, 1)).alias("train_rows"), F.count(F.when(F.col("fold") == 0, 1)).alias("test_rows"))
    k = data.labels.groupBy(F.col("ctx").alias("dataset")).agg(F.count("*").alias("num_classes"))
    return rows.join(k, "dataset").withColumn("num_features", F.lit(len(data.features)))


# the reference's selector: 100 trees, class-balanced, default depth / split
SELECTION_TREES = 100


def importance_of(rows: DataFrame, feats: list[str], ctxs: list[int], k: int, n_repeats: int, seed: int) -> DataFrame:
    """H1 of every context: a class-balanced forest each, grown in the same jobs
    on rows of (ctx, row_key, label_idx, x), and its permutation importance on
    these rows."""
    rows = materialize(rows)
    jobs = [trees.TreeJob(c, c, "gini", SELECTION_TREES, True, True, balanced=True, seed=seed) for c in ctxs]
    nodes = trees.grow_forests(rows.withColumn("y", F.col("label_idx").cast("int")), jobs, k)
    return forest.forest_importance(rows, trees.write_trees(nodes, {c: c for c in ctxs}), feats, n_repeats, seed)


def forest_selection(train: DataFrame, feats: list[str], n_repeats: int = 10, seed: int = 42):
    """H1-H4 with the reference's selector: a class-balanced 100-tree forest on
    imputed + scaled training rows, permutation importance on the same rows."""
    labels = materialize(prep.label_domain(train))
    scaled = fitted_preprocessing(train, feats).transform(null_safe_join(train, labels, ["label"]))
    rows = scaled.select(F.lit(0).alias("ctx"), "row_key", F.col("label_idx").cast("double").alias("label_idx"),
                         F.array(*[F.col(f) for f in feats]).alias("x"))
    imp = materialize(importance_of(rows, feats, [0], labels.count(), n_repeats, seed).drop("ctx"))
    return imp, select.select_features(imp)


def q_rf_permutation_selection(spark, sf):
    train, _, feats = _emb_split(spark, sf)
    imp, sel = forest_selection(train, feats)
    chosen = sel.select(F.explode("selected_features").alias("feature")).withColumn("selected", F.lit(True))
    return (imp.join(chosen, "feature", "left").fillna(False, ["selected"])
            .select("feature", "feature_idx", F.round("importance", 6).alias("importance"), "selected"))


def q_final_test_phase2(spark, sf):
    """Selection on the training part, then G8 on the kept columns."""
    from .rules import PHASE_AFTER
    data = _emb_final(spark, sf)
    train = data.base.filter("fold <> 0").select("row_key", "label", *[F.col("x")[i].alias(f) for i, f in enumerate(data.features)])
    _, sel = forest_selection(train, data.features)
    data.keep = {1: list(sel.first()["selected_features"])}
    return final.final_test(data, tuned_params(spark, sf, PHASE_AFTER), "phase2")


def q_dt_cv(spark, sf):
    """G5 for the decision tree: 24-set grid, hold-out tuning inside each fold."""
    v = view(spark, sf, "emb")
    cv = tune.prepare_cv(v.df, list(v.features))
    return tune.tree_nested_cv(cv, C.expand("DT", C.DT_GRID))


def q_rf_cv(spark, sf):
    """G5 for the random forest: 12-set grid, hold-out tuning inside each fold."""
    v = view(spark, sf, "emb")
    cv = tune.prepare_cv(v.df, list(v.features))
    return tune.tree_nested_cv(cv, C.expand("RF", C.RF_GRID))


def q_linear_svm_cv(spark, sf):
    """The linear sets of the SVM search, tuned inside each fold."""
    v = view(spark, sf, "emb")
    cv = tune.prepare_cv(v.df, list(v.features))
    return tune.svm_nested_cv(cv, [s for s in C.svm_grid(cv.n_classes) if s.p["kernel"] == "linear"])


def q_hinge_balanced_cv(spark, sf):
    """the hinge-loss SVM with balanced binary weights, tuned over C."""
    v = view(spark, sf, "emb")
    cv = tune.prepare_cv(v.df, list(v.features))
    return tune.svm_nested_cv(cv, [C.spec("SVM_HINGE", kernel="linear", C=c, gamma="N/A") for c in C.SVM_C])


def q_rbf_svm_cv(spark, sf):
    """The RBF sets of the SVM search, tuned inside each fold."""
    v = view(spark, sf, "emb")
    cv = tune.prepare_cv(v.df, list(v.features))
    return tune.svm_nested_cv(cv, [s for s in C.svm_grid(cv.n_classes) if s.p["kernel"] == "rbf"])


def q_svm_cv(spark, sf):
    """The whole search, linear sets first, then RBF, in one pass."""
    v = view(spark, sf, "emb")
    cv = tune.prepare_cv(v.df, list(v.features))
    return tune.svm_nested_cv(cv, C.svm_grid(cv.n_classes))


def q_knn_cv(spark, sf):
    """G5 for k-NN: (k, metric) tuned on the hold-out of each training fold."""
    v = view(spark, sf, "emb")
    return tune.knn_nested_cv(v.df, list(v.features))


def q_knn_inner_kfold(spark, sf):
    """G4 for k-NN: mean macro F1 of every (k, metric) over nine inner folds of
    each training context, and the best set."""
    v = view(spark, sf, "emb")
    scores, _ = tune.knn_search(v.df, list(v.features), inner_folds=9)
    return scores.select("ctx", "metric", "k", F.round("score", 6).alias("score"), "is_best")


def _class_probabilities(spark, sf) -> DataFrame:
    train, test, feats = _emb_split(spark, sf)
    labels = materialize(prep.label_domain(train))
    p = fit_tree(train, feats, FINAL_SPECS[1], labels).probabilities(test, ["row_key", "label"])
    names = labels.select("label_idx", F.col("label").alias("class"))
    return p.join(names, "label_idx").select("row_key", "label", "class", "probability")


def q_predict_proba(spark, sf):
    """Probability of every class for every test row, by the forest."""
    return _class_probabilities(spark, sf)


def q_predict_proba_sums(spark, sf):
    """Per test row, the number of classes, and that the probabilities lie
    in [0, 1] and sum to 1."""
    return _class_probabilities(spark, sf).groupBy("row_key", "label").agg(
        F.count("*").alias("n_classes"), F.bool_and(F.col("probability").between(0, 1)).alias("in_range"),
        F.round(F.sum("probability"), 6).alias("proba_sum"))


def model_dir(root: str, phase: str, dataset: str, classifier: str) -> str:
    """Folder of a model in the registry ``root`` (a folder of the run)."""
    return os.path.join(root, phase, dataset, classifier)


def q_score_saved_model(spark, sf):
    """A11 + B3 + I1/I8: save a fitted pipeline, load it, align the input
    columns to the model's (extra column dropped), score and evaluate."""
    train, test, feats = _emb_split(spark, sf)
    labels = materialize(prep.label_domain(train))
    path = model_dir(run_folder(spark, "models"), "phase1", "emb", "DT")
    fit_tree(train, feats, FINAL_SPECS[0], labels).save(path)
    loaded = treemodel.TreeModel.load(spark, path)
    shuffled = test.select("label", *reversed(feats), F.lit(1.0).alias("unused_extra"), "row_key")
    lab = labels.select(F.col("label_idx").cast("double").alias("prediction"), F.col("label").alias("_pl"))
    pred = loaded.predictions(shuffled, ["row_key", "label"]).join(lab, "prediction").drop("prediction") \
        .withColumnRenamed("_pl", "prediction")
    pred = materialize(pred)
    ev = metrics.accuracy_macro_f1(metrics.confusion(pred)).first()   # one row of 4 numbers
    dist = metrics.prediction_distribution(pred)
    return dist.select("*", *[F.lit(ev[c]).alias(c) for c in ("accuracy", "macro_f1", "n_samples", "n_labels")])


# F9 defaults for the MLP (fixed values of the reference's factory)
MLP_DEFAULT = dict(hidden=(64,), lr=0.001, alpha=0.0001)


def _mlp_frame(df: DataFrame, feats: list[str], stats_from: DataFrame, labels: DataFrame,
               ctx: int = 0, seed: int = 42) -> DataFrame:
    """Scaled feature array + label index + early-stopping flag (10 % by hash)."""
    pre = fitted_preprocessing(stats_from, feats)
    d = pre.transform(df).join(labels, "label")
    d = split.holdout(d, "row_key", test_size=0.10, seed=seed, out="stop")
    return d.select("row_key", "label", F.lit(ctx).alias("ctx"), mlp.features_array(feats).alias("x"),
                    F.col("label_idx").alias("y"), "stop")


def q_mlp_final_test(spark, sf):
    """G8 for the MLP: default parameters, fit on the training part, score the test part."""
    train, test, feats = _emb_split(spark, sf)
    labels = materialize(prep.label_domain(train))
    k = labels.count()
    tr = cut_lineage(_mlp_frame(train, feats, train, labels))
    job = mlp.MLPJob(0, 0, MLP_DEFAULT["hidden"], MLP_DEFAULT["lr"], MLP_DEFAULT["alpha"])
    models = mlp.train_many(tr, [job], len(feats), k)
    te = _mlp_frame(test, feats, train, labels).withColumn("stop", F.lit(False))
    pred = mlp.predict(te, models, {0: 0})
    lab = labels.select(F.col("label_idx").alias("pred_idx"), F.col("label").alias("prediction"))
    pred = pred.join(lab, "pred_idx")
    return metrics.accuracy_macro_f1(metrics.confusion(pred)).withColumn("classifier", F.lit("MLP"))


def q_mlp_cv(spark, sf):
    v = view(spark, sf, "emb")
    return tune.mlp_nested_cv(tune.prepare_cv(v.df, list(v.features)))


def q_svm_final_test(spark, sf):
    """F1-F4 in the final test: linear (squared-hinge stand-in), hinge-loss with
    balanced weights, and RBF through random Fourier features (gamma='scale')."""
    from ..operators.models import rff
    train, test, feats = _emb_split(spark, sf)
    labels = materialize(prep.label_domain(train))
    out = []
    for s in (C.spec("SVM_LINEAR", kernel="linear", C=1.0, gamma="N/A"),
              C.spec("SVM_HINGE", kernel="linear", C=1.0, gamma="N/A")):
        pred = _labelled_predictions(fit_pipeline(train, feats, s, labels), test, labels)
        out.append(metrics.accuracy_macro_f1(metrics.confusion(pred)).withColumn("variant", F.lit(s.classifier)))
    # RBF: the fitted preprocessing, then z(x), then a linear SVM on z
    pre = fitted_preprocessing(train, feats)
    asm = VectorAssembler(inputCols=feats, outputCol="features")
    var_x = sum(1 for r in prep.moments(train, feats).collect() if r["std"] > 0) / len(feats)
    w, b = rff.rff_params(len(feats), rff.resolve_gamma("scale", len(feats), var_x))
    lab = labels.withColumn("label_idx", F.col("label_idx").cast("double"))
    tr = asm.transform(pre.transform(train)).join(lab, "label") \
        .withColumn("features", rff.rff_column(F.col("features"), w, b))
    te = asm.transform(pre.transform(test)).withColumn("features", rff.rff_column(F.col("features"), w, b))
    n_classes = labels.count()
    model = C.build(C.spec("SVM_LINEAR", C=1.0), tr.count(), n_classes).fit(tr)
    lab2 = labels.select(F.col("label_idx").cast("double").alias("prediction"), F.col("label").alias("_pl"))
    pred = model.transform(te).join(lab2, "prediction").drop("prediction") \
        .withColumnRenamed("_pl", "prediction")
    out.append(metrics.accuracy_macro_f1(metrics.confusion(pred)).withColumn("variant", F.lit("SVM_RBF")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def fold_selection(cv: tune.CVData, n_repeats: int = 10, seed: int = 42):
    """H1-H4 once per fold context (G7): a balanced forest per training context
    and the permutation importances of all contexts in the same jobs, then
    above-mean selection.  Returns (ctx -> kept columns, selection DataFrame)."""
    rows = cv.frame("train").select("ctx", "row_key", "label_idx", "x")
    imp = importance_of(rows, cv.features, list(range(cv.n_folds)), cv.n_classes, n_repeats, seed)
    sel = materialize(select.select_features(imp, ["ctx"]))
    kept = {r["ctx"]: list(r["selected_features"]) for r in sel.select("ctx", "selected_features").collect()}
    return kept, sel


def phase2_cv(df: DataFrame, feats: list[str], families: dict, n_folds: int = 10, seed: int = 42,
              n_repeats: int = 10, ledger: str | None = None) -> DataFrame:
    """The selection of each fold is computed once and shared by every
    family; each context is trained and scored on its kept columns only.  One
    typed record per (family, fold).  ``ledger``: see ``all_classifiers_cv``."""
    df = materialize(df.select("row_key", "label", *feats))
    cv = tune.prepare_cv(df, feats, n_folds, seed)
    kept, sel = fold_selection(cv, n_repeats, seed)
    sel_cols = sel.select((F.col("ctx") + 1).alias("fold"), "n_features_before", "n_features_after", "selected_text")
    records = tune.all_classifiers_cv(df, feats, families, n_folds, seed, keep=kept, cv=replace(cv, keep=kept), ledger=ledger)
    return records.join(sel_cols, "fold")


def q_phase2_knn_cv(spark, sf):
    """G7 for k-NN: per-fold selection, then k-NN tuned and tested on the kept columns."""
    v = view(spark, sf, "emb")
    return phase2_cv(v.df, list(v.features), {"KNN": []}).drop("total_time_seconds")


# every family with the reference's grid
FAMILIES = ("DT", "RF", "KNN", "SVM", "MLP")


def q_all_classifiers_cv(spark, sf):
    """Nested CV of the five families over the same folds."""
    v = view(spark, sf, "emb")
    return tune.all_classifiers_cv(v.df, list(v.features), {f: [] for f in FAMILIES}).drop("total_time_seconds")


def q_phase2_all_cv(spark, sf):
    """Per-fold selection, then the five families tuned and tested on the kept columns."""
    v = view(spark, sf, "emb")
    return phase2_cv(v.df, list(v.features), {f: [] for f in FAMILIES}).drop("total_time_seconds")


def q_model_registry_list(spark, sf):
    """A11 list: fit and save the final-test tree and forest, then list the
    registry as (phase, dataset) -> sorted classifiers."""
    train, test, feats = _emb_split(spark, sf)
    labels = materialize(prep.label_domain(train))
    root = run_folder(spark, "models")
    for s in FINAL_SPECS[:2]:
        fit_tree(train, feats, s, labels).save(model_dir(root, "phase1", "emb", s.classifier))
    return model_registry(spark, root).select("phase", "dataset", F.array_join("classifiers", ", ").alias("classifiers"))


QUERIES = {
    "model_registry_list": q_model_registry_list,
    "phase2_knn_cv": q_phase2_knn_cv,
    "all_classifiers_cv": q_all_classifiers_cv,
    "phase2_all_cv": q_phase2_all_cv,
    "rf_cv": q_rf_cv,
    "rbf_svm_cv": q_rbf_svm_cv,
    "final_test_datasets": q_final_test_datasets,
    "final_test_sizes": q_final_test_sizes,
    "linear_svm_cv": q_linear_svm_cv,
    "svm_cv": q_svm_cv,
    "hinge_balanced_cv": q_hinge_balanced_cv,
    "knn_inner_kfold": q_knn_inner_kfold,
    "predict_proba_sums": q_predict_proba_sums,
    "svm_final_test": q_svm_final_test,
    "mlp_cv": q_mlp_cv,
    "mlp_final_test": q_mlp_final_test,
    "final_test_phase1": q_final_test_phase1,
    "final_test_phase2": q_final_test_phase2,
    "rf_permutation_selection": q_rf_permutation_selection,
    "dt_cv": q_dt_cv,
    "knn_cv": q_knn_cv,
    "predict_proba": q_predict_proba,
    "score_saved_model": q_score_saved_model,
}
