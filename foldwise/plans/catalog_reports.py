"""Registered queries, part 2: selection (H), fold records and reports (J),
scalar functions and ordering (S, K, B)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import params as P
from ..operators import metrics, report, select
from ..session import materialize, run_folder
from . import rules

R6 = 6


def _r(c, d=R6):
    # "+ 0.0" turns a rounded -0.0 into 0.0
    return (F.round(F.col(c), d) + F.lit(0.0)).alias(c)


# ------------------------------------------------- permutation importance ---
def _rule_predictor(sql: str):
    return lambda d: d.withColumn("prediction", F.expr(sql))


def _importance(spark, sf, clf="RF", phase=rules.PHASE_BEFORE, prune=True):
    base = rules.rule_view(spark, sf, with_folds=False)
    sql, used = rules.RULES[(clf, phase)]
    return select.permutation_importance(base, rules.LI_FEATURES, _rule_predictor(sql),
                                         used=used if prune else None, group_cols=["dataset"], predict_key=False)


def q_permutation_importance_rule(spark, sf):
    imp = _importance(spark, sf)
    return imp.select("dataset", "feature", "feature_idx", _r("importance"), _r("importance_std"))


def q_select_above_mean(spark, sf):
    s = select.select_features(_importance(spark, sf), ["dataset"])
    return s.select("dataset", "n_features_before", "n_features_after", "selected_text", "used_fallback")


# constant majority-class predictor: every importance is 0, so H3's fallback applies
CONSTANT_RULE = "CASE WHEN TRUE THEN 'N' END"


def q_select_fallback_top_half(spark, sf):
    base = rules.rule_view(spark, sf, with_folds=False)
    imp = select.permutation_importance(base, rules.LI_FEATURES, _rule_predictor(CONSTANT_RULE),
                                        used=None, group_cols=["dataset"], predict_key=False)
    s = select.select_features(imp, ["dataset"])
    return s.select("dataset", "n_features_before", "n_features_after", "selected_text", "used_fallback")


def q_importance_rank(spark, sf):
    r = select.importance_rank(_importance(spark, sf, "MLP", rules.PHASE_BEFORE), ["dataset"])
    return r.select("dataset", "feature", _r("importance"), "rank")


# ---------------------------------------------------------- fold records ---
def _folds(spark, sf) -> DataFrame:
    return rules.rule_folds(spark, sf)


def q_rule_folds(spark, sf):
    f = _folds(spark, sf)
    return f.withColumn("selected_features", F.array_join("selected_features", ", "))


def _summaries(spark, sf, f=None) -> DataFrame:
    f = f if f is not None else _folds(spark, sf)
    return report.fold_summary(f, ["phase", "dataset_name", "dataset", "classifier"])


def q_fold_summary(spark, sf):
    return _summaries(spark, sf).filter(F.col("phase") == rules.PHASE_BEFORE)


def q_phase2_summary(spark, sf):
    f = _folds(spark, sf).filter(F.col("phase") == rules.PHASE_AFTER)
    return report.phase2_summary(f, ["phase", "dataset_name", "classifier"])


def q_combine_summaries(spark, sf):
    """Phase-1 summaries and phase-2 summaries stacked (missing columns null)."""
    f = _folds(spark, sf)
    s1 = report.fold_summary(f.filter(F.col("phase") == rules.PHASE_BEFORE), ["phase", "dataset_name", "classifier"])
    s2 = report.phase2_summary(f.filter(F.col("phase") == rules.PHASE_AFTER), ["phase", "dataset_name", "classifier"])
    return s1.unionByName(s2, allowMissingColumns=True)


def _with_seq(f: DataFrame) -> DataFrame:
    # order in which the reference reads fold records: dataset 1..16, fold 1..10
    return f.withColumn("seq", F.col("dataset") * 100 + F.col("fold"))


def q_modal_params(spark, sf):
    f = _with_seq(_folds(spark, sf))
    cols = sorted({p for lay in report.PARAM_LAYOUT.values() for p, _ in lay})
    m = report.modal_value(f, ["classifier", "phase"], cols, "seq")
    pairs = [(clf, p) for clf, lay in report.PARAM_LAYOUT.items() for p, _ in lay]
    keep = F.array(*[F.lit(f"{c}|{p}") for c, p in pairs])
    return m.filter(F.array_contains(keep, F.concat_ws("|", "classifier", "param")))


def q_param_summary(spark, sf):
    return report.param_summary(_with_seq(_folds(spark, sf)))


def q_results_pivot(spark, sf):
    return report.results_pivot(_summaries(spark, sf), "f1")


def q_phase_comparison(spark, sf):
    return report.phase_comparison(_summaries(spark, sf))


def q_best_classifier(spark, sf):
    return report.best_classifier(_summaries(spark, sf))


def q_feature_reduction(spark, sf):
    return report.feature_reduction(_folds(spark, sf))


def q_std_comparison(spark, sf):
    return report.std_comparison(_summaries(spark, sf))


def rule_final_test(spark, sf) -> DataFrame:
    """Final-test records: each rule scored on the held-out fold-0 rows of its dataset."""
    p = rules.rule_predictions(spark, sf).filter(F.col("fold") == 0)
    g = ["phase", "dataset", "classifier"]
    m = metrics.accuracy_macro_f1(metrics.confusion(p, group_cols=g), g)
    return m.select(F.concat(F.lit("dataset_"), F.col("dataset").cast("string")).alias("dataset_name"),
                    "dataset", "phase", "classifier", F.col("accuracy").alias("test_accuracy"),
                    F.col("macro_f1").alias("test_f1_macro"), F.col("n_samples").alias("test_rows"),
                    F.col("n_labels").alias("num_classes"))


def q_test_f1_pivot(spark, sf):
    return report.test_f1_pivot(rule_final_test(spark, sf))


def q_test_f1_by_group(spark, sf):
    return report.test_f1_pivot(rule_final_test(spark, sf), by_group=True)


def q_dataset_classifier_matrix(spark, sf):
    return report.dataset_classifier_matrix(rule_final_test(spark, sf), rules.PHASE_BEFORE)


def q_merge_dedupe_results(spark, sf):
    """Each of the ten folds is a run that wrote a result file; run n holds
    the datasets divisible by n, and the runs of even number wrote their rows
    twice -> exact copies go, the last record per key wins, sorted."""
    p = rules.rule_predictions(spark, sf)
    g = ["phase", "dataset", "classifier", "fold"]
    # one aggregation for all runs (a small table, written once: both branches read it)
    per_fold = materialize(metrics.accuracy_macro_f1(metrics.confusion(p, group_cols=g), g))
    run = F.col("fold") + 1
    rows = per_fold.where(F.col("dataset") % run == 0).select(
        F.concat(F.lit("dataset_"), F.col("dataset").cast("string")).alias("dataset_name"),
        "phase", "classifier", F.col("macro_f1").alias("test_f1_macro"),
        F.concat(F.lit("run"), run.cast("string"), F.lit(".csv")).alias("source_file"),
        (run * 100000 + F.col("dataset") * 100 + report.classifier_key(F.col("classifier")) * 10
         + F.when(F.col("phase") == rules.PHASE_BEFORE, 0).otherwise(1)).alias("seq"), run.alias("run"))
    stacked = rows.unionByName(rows.where("run % 2 = 0")).drop("run")
    out = report.merge_dedupe(stacked, ["dataset_name", "phase", "classifier"], "seq", "source_file")
    return out.select("dataset_name", "phase", "classifier", "test_f1_macro", "source_file",
                      "dataset_sort", "classifier_sort")


def q_global_mean_std(spark, sf):
    return report.global_mean_std(_folds(spark, sf))


def q_fold_lookup(spark, sf):
    return report.fold_lookup(_folds(spark, sf), rules.PHASE_BEFORE)


# --------------------------------------------------- scalar functions (S) ---
def q_parse_params(spark, sf):
    """S1/S2 on the J5 parameter texts: one row per (classifier, phase, parameter)."""
    t = q_param_summary(spark, sf).withColumn(
        "clf", P.normalize_classifier(F.col("classifier"), strict=True))
    e = t.select("clf", "phase", F.posexplode(P.param_pairs(F.col("best_hyperparameters"))).alias("pos", "kv"))
    raw = F.col("kv.raw")
    return e.select(F.col("clf").alias("classifier"), "phase", "pos",
                    P.renamed_key(F.col("kv.key"), F.col("clf")).alias("param"),
                    raw.alias("raw"), P.scalar_kind(raw).alias("kind"),
                    P.scalar_number(raw).alias("number"),
                    F.array_join(P.scalar_ints(raw), ",").alias("ints"))


def q_normalize_names(spark, sf):
    """S3 both forms on the classifier names of the fold records, in several spellings."""
    names = _folds(spark, sf).select("classifier").distinct()
    spell = names.select(F.explode(F.array(F.col("classifier"), F.lower("classifier"),
                                           F.concat(F.lit(" "), F.lower("classifier"), F.lit(" ")))).alias("name"))
    return spell.distinct().select("name", P.normalize_classifier(F.col("name"), strict=True).alias("canonical"),
                                   P.normalize_classifier(F.col("name"), strict=False).alias("report_name"))


def q_natural_sort(spark, sf):
    """K2/K3 + S4 on the result keys."""
    f = _folds(spark, sf).select("dataset_name", "classifier").distinct()
    return f.select("dataset_name", "classifier",
                    P.dataset_number(F.col("dataset_name")).alias("dataset_num"),
                    report.natural_key(F.col("dataset_name")).alias("dataset_sort"),
                    report.classifier_key(F.col("classifier")).alias("classifier_sort"),
                    report.dataset_group(P.dataset_number(F.col("dataset_name"))).alias("dataset_group"))


def q_format_split_pm(spark, sf):
    """The J6 cells split back into mean and std text."""
    piv = q_results_pivot(spark, sf)
    long = piv.select("dataset_name", "phase", F.explode(F.array(*[
        F.struct(F.lit(c).alias("classifier"), F.col(c).alias("cell")) for c in report.CLASSIFIER_ORDER])).alias("e"))
    m, s = P.split_pm(F.col("e.cell"))
    return long.select("dataset_name", "phase", "e.classifier", "e.cell", m.alias("mean_text"), s.alias("std_text"))


def q_params_json(spark, sf):
    """Prefixed parameter names of a fold record -> sorted-key JSON."""
    f = _folds(spark, sf).filter(F.col("classifier") == "DT")
    values = {"max_depth": F.col("best_max_depth").cast("int"), "min_samples_split": F.col("best_min_split"),
              "criterion": F.col("best_criterion")}
    names = F.transform(F.array(*[F.lit(f"dt__{k}") for k in values]), P.strip_prefix)
    return f.select("phase", "dataset_name", "fold", P.params_json(values).alias("params_json"),
                    P.join_list(names).alias("param_names"))


DATASET_SPEC = "3-6"
CLASSIFIER_SPEC = "svm, rf, bogus"


def q_select_datasets(spark, sf):
    """Dataset range and classifier list applied to the fold
    records (partition-style filters), counted per dataset and classifier."""
    clfs = [c.upper() for c in P.classifier_names(CLASSIFIER_SPEC)]
    f = _folds(spark, sf)
    f = f.filter(P.selects_dataset(DATASET_SPEC, F.col("dataset")) & F.col("classifier").isin(clfs))
    return f.groupBy("dataset", "classifier").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.max(F.col("dataset_name").rlike(r"^dataset_[1-8]$").cast("int")).alias("in_first_group"))


def q_results_roundtrip(spark, sf):
    """A7 -> A4/A5: fold records written as a partitioned results table, read
    back with partition filters (phase 1, datasets 1-8) and validated."""
    from ..sources import results as RS
    path = run_folder(spark, "results", "rule_folds")
    RS.write_results(_folds(spark, sf).drop("selected_features"), path)
    back = RS.read_results(spark, path, required=["accuracy", "f1"], phase=rules.PHASE_BEFORE,
                           dataset=list(range(1, 9)))
    v = RS.validated_results(back, "Before FS/DR")
    return v.groupBy("dataset_name", "dataset_group", "classifier_name").agg(
        report._mean4("f1").alias("f1_mean"), report._std4("f1").alias("f1_std"),
        F.count(F.lit(1)).alias("n_folds"))


def q_sorted_folds(spark, sf):
    """K1: fold records in order, with their parameters."""
    f = report.sort_folds(report.fold_parameters(_folds(spark, sf)))
    return f.select("phase", "dataset_name", "classifier", "fold", "fold_rank", "accuracy", "f1", "parameters")


def q_schema_diff(spark, sf):
    """A model trained on the lineitem view's columns against the lineitem table."""
    from ..sources import results as RS
    from ..sources.tables import table, view
    v = view(spark, sf, "li")
    raw = table(spark, sf, "lineitem")
    renamed = raw.select(*[F.col(c).alias(c.removeprefix("l_")) for c in raw.columns])
    return RS.schema_diff(v.df.select(*v.features, *v.extra), renamed)


def q_align_features(spark, sf):
    """The lineitem table with its columns renamed, moved and extra ones
    added, brought to the model's columns and order."""
    from ..sources import results as RS
    from ..sources.tables import view
    v = view(spark, sf, "li")
    moved = v.df.select("label", *reversed(v.features), F.lit(1).alias("unused"), "row_key")
    return RS.align(moved, list(v.features), keep=["row_key"])


QUERIES = {
    "sorted_folds": q_sorted_folds,
    "schema_diff": q_schema_diff,
    "align_features": q_align_features,
    "results_roundtrip": q_results_roundtrip,
    "permutation_importance_rule": q_permutation_importance_rule,
    "select_above_mean": q_select_above_mean,
    "select_fallback_top_half": q_select_fallback_top_half,
    "importance_rank": q_importance_rank,
    "rule_folds": q_rule_folds,
    "fold_summary": q_fold_summary,
    "phase2_summary": q_phase2_summary,
    "combine_summaries": q_combine_summaries,
    "modal_params": q_modal_params,
    "param_summary": q_param_summary,
    "results_pivot": q_results_pivot,
    "phase_comparison": q_phase_comparison,
    "best_classifier": q_best_classifier,
    "feature_reduction": q_feature_reduction,
    "std_comparison": q_std_comparison,
    "test_f1_pivot": q_test_f1_pivot,
    "test_f1_by_group": q_test_f1_by_group,
    "dataset_classifier_matrix": q_dataset_classifier_matrix,
    "merge_dedupe_results": q_merge_dedupe_results,
    "global_mean_std": q_global_mean_std,
    "fold_lookup": q_fold_lookup,
    "parse_params": q_parse_params,
    "normalize_names": q_normalize_names,
    "natural_sort": q_natural_sort,
    "format_split_pm": q_format_split_pm,
    "params_json": q_params_json,
    "select_datasets": q_select_datasets,
}
