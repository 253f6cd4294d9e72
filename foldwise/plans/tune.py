"""Tuning and evaluation drivers.

Nested CV of one classifier family (G5/G6):

1. E1 folds and, for every fold context, an E2 hold-out (90/10) of its training
   rows.  Each row is written once, as a Parquet table partitioned by fold,
   with its raw feature array and a bit per context in which it is a
   validation row.
2. Moments of the outer contexts and of the inner (90 %) parts, so that no
   validation or test row influences its own scaling (D1/D2): p numbers per
   context.  A fit reads the folds of its context (the others are pruned) and
   applies its moments, and the columns its selection keeps, in the scan's
   projection.  Rows reach the estimator in key order in a number of
   partitions that depends on their count alone, so a fitted model does not
   depend on the cluster.
3. The driver fits each (context, parameter set) with a pool of Spark jobs,
   scores all validation predictions in one aggregation, picks the best set
   per context (first in grid order wins ties), refits it on the whole
   training context and scores the test rows, again in one aggregation.

The driver holds only the grid, the moments, the fitted models and k x k counts.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import knn as knn_op
from ..operators import metrics, prep, split
from ..operators.models import classifiers as C
from ..operators.models import mlp, rff, svm, trees
from ..session import materialize, null_safe_join, once, run_folder

FIT_ROWS = 100_000             # rows per partition of a fit's input
# the kept columns of an array x, imputed and scaled
SCALED = """transform(cols, (c, i) -> CASE WHEN means[i] IS NULL THEN 0D
            ELSE (coalesce(x[c], means[i]) - means[i]) / scales[i] END)"""
TIE_DIGITS = 9                 # scores are compared after rounding, see H2


@dataclass
class CVData:
    base: DataFrame       # row_key, label, label_idx, x (raw array), val (bits), fold; partitioned by fold
    labels: DataFrame     # label, label_idx
    n_classes: int
    features: list
    n_folds: int
    n_train: dict         # ctx -> rows of the training context
    n_sub: dict           # ctx -> rows of the 90 % part
    outer: dict           # ctx -> [(mean or None, scale, std)] per feature
    inner: dict
    keep: dict | None = None   # ctx -> kept columns (G7)

    def columns(self, ctx: int) -> list[int]:
        """Numbers of the columns that the context keeps."""
        return [i for i, f in enumerate(self.features) if self.keep is None or f in self.keep[ctx]]

    def scaled(self, ctx: int, inner: bool) -> Column:
        """Array of the kept columns, imputed and scaled for the context."""
        stats = (self.inner if inner else self.outer)[ctx]
        out = []
        for i in self.columns(ctx):
            mean, scale, _ = stats[i]
            out.append(F.lit(0.0) if mean is None else
                       (F.coalesce(F.col("x")[i], F.lit(mean)) - F.lit(mean)) / F.lit(scale))
        return F.array(*out).cast("array<double>")

    def variance(self, ctx: int, inner: bool) -> float:
        """Mean variance of the kept scaled columns (for gamma='scale')."""
        stats, cols = (self.inner if inner else self.outer)[ctx], self.columns(ctx)
        return sum(stats[i][2] > 0 for i in cols) / max(1, len(cols))

    def rows(self, ctx: int, part: str) -> DataFrame:
        """``part``: sub / val (90 / 10 % of the training rows), train, test."""
        d = self.base.filter(F.col("fold") == ctx if part == "test" else F.col("fold") != ctx)
        bit = F.col("val").bitwiseAND(F.lit(1 << ctx)) != 0
        if part in ("sub", "val"):
            d = d.filter(bit if part == "val" else ~bit)
        x = self.scaled(ctx, part in ("sub", "val"))
        d = d.select(F.lit(ctx).alias("ctx"), "row_key", "label", "label_idx", x.alias("x"))
        if part in ("sub", "train"):
            n = (self.n_sub if part == "sub" else self.n_train)[ctx]
            d = d.repartition(max(1, -(-n // FIT_ROWS)), "row_key").sortWithinPartitions("row_key")
        return d

    def frame(self, part: str) -> DataFrame:
        """``rows`` of all contexts in one plan: each row joins the moments of the
        contexts that it belongs to (one short row per context)."""
        spark = self.base.sparkSession
        inner = part in ("sub", "val")
        moments = []
        for ctx in range(self.n_folds):
            stats, cols = (self.inner if inner else self.outer)[ctx], self.columns(ctx)
            moments.append((ctx, cols, [stats[i][0] for i in cols], [stats[i][1] for i in cols]))
        of = spark.createDataFrame(moments, "ctx int, cols array<int>, means array<double>, scales array<double>")
        d = self.base.withColumn("fold", F.col("fold").cast("int"))
        if part == "test":
            d = d.withColumn("ctx", F.col("fold"))
        else:
            d = d.withColumn("ctx", F.explode(F.sequence(F.lit(0), F.lit(self.n_folds - 1)))).where("ctx <> fold")
            bit = F.expr("val & shiftleft(1L, ctx) <> 0")
            d = d.where(bit) if part == "val" else d.where(~bit) if part == "sub" else d
        return d.join(of, "ctx").select("ctx", "row_key", "label", "label_idx", F.expr(SCALED).alias("x"))

    def vectors(self, ctx: int, part: str) -> DataFrame:
        return self.rows(ctx, part).select("ctx", "row_key", "label", "label_idx", array_to_vector("x").alias("features"))


def _stats(mom: DataFrame, n_features: int) -> tuple[dict, dict]:
    """Moments and row counts per context (contexts x features numbers)."""
    out, rows = {}, {}
    for r in mom.select("ctx", "feature_idx", "n", "n_rows", "mean", "scale", "std").collect():
        out.setdefault(r["ctx"], [None] * n_features)[r["feature_idx"]] = (
            r["mean"] if r["n"] else None, r["scale"], r["std"])
        rows[r["ctx"]] = r["n_rows"]
    return out, rows


def prepare_cv(df: DataFrame, features: list[str], n_folds: int = 10, seed: int = 42,
               key: str = "row_key", label: str = "label", keep: dict | None = None) -> CVData:
    """``keep`` (ctx -> kept columns, from a per-fold selection) restricts each
    context to its columns."""
    feats = list(features)
    spark = df.sparkSession
    base = split.stratified_folds(df.select(key, label, *feats), key, label, n_folds, seed)
    labels = prep.label_domain(base, label=label)
    base = null_safe_join(base, labels, [label]).select(
        F.col(key).alias("row_key"), F.col(label).alias("label"), F.col("label_idx").cast("double").alias("label_idx"),
        F.array(*[prep.clean(c) for c in feats]).alias("x"), "fold")
    folded = materialize(base)
    val = split.holdout(split.fold_contexts(folded.select("row_key", "fold"), n_folds), group_cols=["ctx"], seed=seed)
    val = val.filter("is_val").groupBy("row_key").agg(F.expr("bit_or(shiftleft(1L, ctx))").alias("val"))
    path = run_folder(spark, "cv")
    folded.join(val, "row_key", "left").withColumn("val", F.coalesce("val", F.lit(0).cast("long"))) \
        .write.partitionBy("fold").parquet(path)
    base = spark.read.parquet(path)
    wide = base.select("fold", "val", *[F.col("x")[i].alias(c) for i, c in enumerate(feats)])
    outer, n_train = _stats(prep.fold_moments(wide, feats, n_folds), len(feats))
    sub = split.fold_contexts(wide, n_folds).filter("(val & shiftleft(1L, ctx)) = 0")
    inner, n_sub = _stats(prep.with_scale(prep.column_moments(sub, feats, ["ctx"])), len(feats))
    labels = materialize(labels)
    return CVData(base, labels, labels.count(), feats, n_folds, n_train, n_sub, outer, inner, keep)


def _fit_predict(s: C.Spec, train: DataFrame, score: DataFrame, n_train: int, n_classes: int,
                 var_x: float, p: int, save: str | None = None) -> DataFrame:
    """Fit one spec on ``train`` and return ``score`` with a ``prediction`` index;
    ``save`` is a folder for the fitted model."""
    if s.classifier == "SVM_RBF":
        g = rff.resolve_gamma(s.p["gamma"], p, var_x)
        w, b = rff.rff_params(p, g, s.p.get("n_components", rff.N_COMPONENTS))
        train = train.withColumn("features", rff.rff_column(F.col("features"), w, b))
        score = score.withColumn("features", rff.rff_column(F.col("features"), w, b))
        est = C.build(C.spec("SVM_LINEAR", C=s.p["C"]), n_train, n_classes)
    else:
        est = C.build(s, n_train, n_classes)
    model = est.fit(train)
    if save:
        model.write().overwrite().save(save)
    return model.transform(score).select(*[c for c in score.columns if c != "features"], "prediction")


def _to_labels(pred: DataFrame, labels: DataFrame) -> DataFrame:
    lab = labels.select(F.col("label_idx").cast("double").alias("prediction"), F.col("label").alias("pred_label"))
    return pred.join(lab, "prediction").drop("prediction").withColumnRenamed("pred_label", "prediction")


def _pick(scores: DataFrame, group: str, order) -> DataFrame:
    """Marks the best row per group: highest score after rounding, then grid order."""
    w = Window.partitionBy(group).orderBy(F.desc(F.round("score", TIE_DIGITS)), order)
    return scores.withColumn("is_best", F.row_number().over(w) == 1)


def holdout_search(cv: CVData, specs: list[C.Spec], parallel: int = 8) -> DataFrame:
    """Validation macro-F1 of every (ctx, set); best set per ctx.

    Returns (ctx, spec_idx, score, is_best)."""
    jobs = [(ctx, i, s) for ctx in range(cv.n_folds) for i, s in enumerate(specs)]

    def run(job):
        ctx, i, s = job
        pred = _fit_predict(s, cv.vectors(ctx, "sub"), cv.vectors(ctx, "val"), cv.n_sub[ctx], cv.n_classes,
                            cv.variance(ctx, True), len(cv.columns(ctx)))
        return pred.select("ctx", "label", "prediction").withColumn("spec_idx", F.lit(i))

    with ThreadPoolExecutor(max_workers=parallel) as ex:
        preds = list(ex.map(run, jobs))
    allp = _to_labels(reduce(DataFrame.unionByName, preds), cv.labels)
    g = ["ctx", "spec_idx"]
    scores = metrics.accuracy_macro_f1(metrics.confusion(allp, group_cols=g), g, digits=None) \
        .select("ctx", "spec_idx", F.col("macro_f1").alias("score"))
    return _pick(scores, "ctx", F.asc("spec_idx"))


# The Best columns of the fold record (G11) per family and parameter
BEST_COLUMNS = {
    "SVM": {"kernel": ("best_kernel", "string"), "C": ("best_c", "double"), "gamma": ("best_gamma", "string")},
    "KNN": {"n_neighbors": ("best_k", "int"), "metric": ("best_metric", "string")},
    "DT": {"max_depth": ("best_max_depth", "int"), "min_samples_split": ("best_min_split", "int"),
           "criterion": ("best_criterion", "string")},
    "RF": {"n_estimators": ("best_n_estimators", "int"), "max_depth": ("best_max_depth", "int"),
           "min_samples_split": ("best_min_samples_split", "int")},
    "MLP": {"hidden_layer_sizes": ("best_hidden_layers", "string"), "learning_rate_init": ("best_learning_rate", "double"),
            "alpha": ("best_alpha", "double")},
}


def family_of(classifier: str) -> str:
    return classifier.upper().split("_")[0]


def _best_params(spark, best: dict) -> DataFrame:
    """(ctx, parameters as JSON, typed Best columns) of the chosen sets."""
    family = family_of(next(iter(best.values())).classifier)
    columns = BEST_COLUMNS[family]
    casts = {"string": str, "int": int, "double": float}
    rows = []
    for ctx, s in best.items():
        own = {k: list(v) if isinstance(v, tuple) else v for k, v in s.p.items()}
        values = [None if s.p.get(k) is None else casts[t](s.p[k]) for k, (_, t) in columns.items()]
        rows.append((ctx, json.dumps(own, sort_keys=True), *values))
    return spark.createDataFrame(rows, "ctx int, parameters string, " + ", ".join(f"{c} {t}" for c, t in columns.values()))


def _records(m: DataFrame, params: DataFrame) -> DataFrame:
    own = [c for c in params.columns if c != "ctx"]
    return m.join(params, "ctx").select((F.col("ctx") + 1).alias("fold"), "accuracy", F.col("macro_f1").alias("f1"), *own)


def nested_cv(cv: CVData, specs: list[C.Spec], parallel: int = 8) -> DataFrame:
    """Per fold, tune on the hold-out, refit the best set on the training
    context, score the test rows.  Returns typed fold records (G11)."""
    best = {r["ctx"]: specs[r["spec_idx"]] for r in
            holdout_search(cv, specs, parallel).filter("is_best").collect()}

    def run(ctx):
        pred = _fit_predict(best[ctx], cv.vectors(ctx, "train"), cv.vectors(ctx, "test"), cv.n_train[ctx], cv.n_classes,
                            cv.variance(ctx, False), len(cv.columns(ctx)))
        return pred.select("ctx", "label", "prediction")

    with ThreadPoolExecutor(max_workers=parallel) as ex:
        preds = list(ex.map(run, range(cv.n_folds)))
    allp = _to_labels(reduce(DataFrame.unionByName, preds), cv.labels)
    m = metrics.accuracy_macro_f1(metrics.confusion(allp, group_cols=["ctx"]), ["ctx"])
    return _records(m, _best_params(cv.base.sparkSession, best))


# ----------------------------------------------------------------- trees ---
def _tree_jobs(cv: CVData, wanted: dict[int, list[C.Spec]], seed: int) -> tuple[list, dict]:
    """Forests to grow for the sets of each context, and the sets read from them:
    one per context and criterion, with as many trees as the largest set asks for."""
    jobs, sets = [], {}
    for ctx, specs in wanted.items():
        grown: dict = {}
        for number, s in specs:
            kind = (s.classifier.upper(), s.p.get("criterion", "gini"))
            grown.setdefault(kind, []).append(trees.TreeSet(
                number, int(s.p.get("n_estimators", 100)) if kind[0] == "RF" else 1, s.p.get("max_depth"), int(s.p.get("min_samples_split") or 2)))
        for (name, criterion), own in sorted(grown.items()):
            job = trees.TreeJob(len(jobs), ctx, criterion, max(t.n_trees for t in own), name == "RF", name == "RF", seed=seed)
            sets[job.model] = own
            jobs.append(job)
    return jobs, sets


def _tree_predictions(cv: CVData, wanted: dict, fit: str, score: str, seed: int) -> DataFrame:
    """(ctx, label, spec_idx, prediction) of the sets ``wanted`` of each context."""
    def frame(part):
        return cv.frame(part).withColumn("y", F.col("label_idx").cast("int"))
    jobs, sets = _tree_jobs(cv, wanted, seed)
    nodes = trees.grow_forests(frame(fit), jobs, cv.n_classes)
    of = cv.base.sparkSession.createDataFrame([(j.model, j.ctx) for j in jobs], "model int, ctx int")
    votes = trees.tree_votes(frame(score), nodes.join(of, "model"), sets, cv.n_classes, ["label"])
    lab = cv.labels.select(F.col("label_idx").alias("pred_idx"), F.col("label").alias("prediction"))
    return trees.predicted(votes).join(lab, "pred_idx").select("ctx", "label", F.col("number").alias("spec_idx"), "prediction")


def tree_nested_cv(cv: CVData, specs: list[C.Spec], seed: int = 42) -> DataFrame:
    """G5 for trees and forests: all contexts grow in the same jobs, and the sets
    of the grid are read from one grown forest per context and criterion."""
    wanted = {ctx: list(enumerate(specs)) for ctx in range(cv.n_folds)}
    g = ["ctx", "spec_idx"]
    pred = _tree_predictions(cv, wanted, "sub", "val", seed)
    scores = metrics.accuracy_macro_f1(metrics.confusion(pred, group_cols=g), g, digits=None).withColumnRenamed("macro_f1", "score")
    best = {r["ctx"]: specs[r["spec_idx"]] for r in _pick(scores, "ctx", F.asc("spec_idx")).filter("is_best").collect()}
    pred = _tree_predictions(cv, {ctx: [(0, s)] for ctx, s in best.items()}, "train", "test", seed)
    m = metrics.accuracy_macro_f1(metrics.confusion(pred, group_cols=["ctx"]), ["ctx"])
    return _records(m, _best_params(cv.base.sparkSession, best))


# ------------------------------------------------------------------- SVM ---
def svm_jobs(wanted: dict[int, list], columns, variance) -> tuple[list, list, dict]:
    """(squared-hinge jobs, hinge jobs, (ctx, spec number) -> model).  Sets that
    come to the same problem (``scale`` and ``auto`` on standardised columns)
    share a model.  ``columns`` and ``variance`` are functions of the context."""
    made: dict = {}
    model_of, newton, dual = {}, [], []
    for ctx, specs in wanted.items():
        for number, s in specs:
            name, gamma = s.classifier.upper(), None
            if name == "SVM_RBF":
                gamma = rff.resolve_gamma(s.p["gamma"], columns(ctx), variance(ctx))
            elif name not in ("SVM_LINEAR", "SVM_HINGE"):
                raise ValueError(f"no solver for {s.classifier!r}")
            key = (ctx, name, float(s.p["C"]), gamma)
            if key not in made:
                job = svm.SVMJob(len(made), ctx, float(s.p["C"]), gamma, balanced=name == "SVM_HINGE")
                made[key] = job
                (newton if name == "SVM_LINEAR" else dual).append(job)
            model_of[ctx, number] = made[key].model
    return newton, dual, model_of


def svm_predictions(fit: DataFrame, score: DataFrame, wanted: dict, columns, variance, labels: DataFrame, k: int,
                    seed: int = 42) -> tuple[DataFrame, dict]:
    """(ctx, label, spec_idx, prediction) of the sets ``wanted`` of each context, and
    the certificate (gradient norm or duality gap) of each (ctx, spec number).
    ``fit`` and ``score`` hold ctx, row_key, label, y and the scaled columns x."""
    newton, dual, model_of = svm_jobs(wanted, columns, variance)
    weights, certificate = {}, {}
    fit = materialize(fit)
    for jobs, solve in ((newton, svm.fit_newton), (dual, svm.fit_dual)):
        if jobs:
            w, c = solve(fit, jobs, k)
            weights |= w
            certificate |= c
    present: dict = {}
    for r in fit.select("ctx", "y").distinct().collect():                 # contexts x classes
        present.setdefault(r["ctx"], []).append(r["y"])
    pred = svm.predict(score, newton + dual, weights, present, k, ["label"], seed)
    names = fit.sparkSession.createDataFrame([(ctx, m, n) for (ctx, n), m in model_of.items()], "ctx int, model int, spec_idx int")
    lab = labels.select(F.col("label_idx").cast("int").alias("pred_idx"), F.col("label").alias("prediction"))
    out = pred.join(names, ["ctx", "model"]).join(lab, "pred_idx").select("ctx", "label", "spec_idx", "prediction")
    return out, {key: certificate[m] for key, m in model_of.items()}


def svm_nested_cv(cv: CVData, specs: list[C.Spec], seed: int = 42) -> DataFrame:
    """G3 + G5: the sets of all contexts are solved together (linear sets first in
    grid order, so they win ties), the best is refitted on the training context.
    ``certificate`` is how far the refitted model is from its optimum."""
    def frame(part):
        return cv.frame(part).withColumn("y", F.col("label_idx").cast("int"))

    def predictions(wanted, fit, score):
        return svm_predictions(frame(fit), frame(score), wanted, lambda c: len(cv.columns(c)),
                               lambda c: cv.variance(c, fit == "sub"), cv.labels, cv.n_classes, seed)
    g = ["ctx", "spec_idx"]
    pred, _ = predictions({ctx: list(enumerate(specs)) for ctx in range(cv.n_folds)}, "sub", "val")
    scores = metrics.accuracy_macro_f1(metrics.confusion(pred, group_cols=g), g, digits=None).withColumnRenamed("macro_f1", "score")
    best = {r["ctx"]: specs[r["spec_idx"]] for r in _pick(scores, "ctx", F.asc("spec_idx")).filter("is_best").collect()}
    pred, certificate = predictions({ctx: [(0, s)] for ctx, s in best.items()}, "train", "test")
    m = metrics.accuracy_macro_f1(metrics.confusion(pred, group_cols=["ctx"]), ["ctx"])
    spark = cv.base.sparkSession
    reached = spark.createDataFrame([(ctx + 1, c) for (ctx, _), c in certificate.items()], "fold int, certificate double")
    return _records(m, _best_params(spark, best)).join(reached, "fold")


# ------------------------------------------------------------------- MLP ---
def _mlp_rows(cv: CVData, part: str, seed: int) -> DataFrame:
    """Rows of all contexts for the trainer; 10 % of the training rows are
    marked for early stopping."""
    d = reduce(DataFrame.unionByName, [cv.rows(ctx, part) for ctx in range(cv.n_folds)])
    d = d.withColumn("y", F.col("label_idx").cast("int")).drop("label_idx")
    if part in ("sub", "train"):
        return split.holdout(d, group_cols=["ctx"], seed=seed + 1, out="stop")
    return d.withColumn("stop", F.lit(False))


def mlp_nested_cv(cv: CVData, specs: list[C.Spec] | None = None, seed: int = 42, max_epochs: int = 500) -> DataFrame:
    """G5 for the MLP: all (fold, set) models of the hold-out search train in
    one trainer run, the refits in a second one."""
    specs = C.expand("MLP", C.MLP_GRID) if specs is None else specs
    k, n = cv.n_classes, len(specs)
    lab = cv.labels.select(F.col("label_idx").alias("pred_idx"), F.col("label").alias("prediction"))

    def job(number, ctx, s):
        return mlp.MLPJob(number, ctx, s.p["hidden_layer_sizes"], s.p["learning_rate_init"], s.p["alpha"])
    p = {ctx: len(cv.columns(ctx)) for ctx in range(cv.n_folds)}
    jobs = [job(ctx * n + i, ctx, s) for ctx in range(cv.n_folds) for i, s in enumerate(specs)]
    models = mlp.train_many(_mlp_rows(cv, "sub", seed), jobs, p, k, max_epochs=max_epochs, seed=seed)
    val = _mlp_rows(cv, "val", seed).withColumn("spec_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    val = val.withColumnRenamed("ctx", "fold_ctx").withColumn("ctx", F.col("fold_ctx") * n + F.col("spec_idx"))
    vp = mlp.predict(val, models, {j.model_id: j.model_id for j in jobs}).join(lab, "pred_idx")
    g = ["fold_ctx", "spec_idx"]
    scores = metrics.accuracy_macro_f1(metrics.confusion(vp, group_cols=g), g, digits=None) \
        .withColumnRenamed("macro_f1", "score")
    best = {r["fold_ctx"]: specs[r["spec_idx"]] for r in
            _pick(scores, "fold_ctx", F.asc("spec_idx")).filter("is_best").collect()}
    refit = [job(ctx, ctx, s) for ctx, s in best.items()]
    final = mlp.train_many(_mlp_rows(cv, "train", seed), refit, p, k, max_epochs=max_epochs, seed=seed)
    tp = mlp.predict(_mlp_rows(cv, "test", seed), final, {j.ctx: j.model_id for j in refit}).join(lab, "pred_idx")
    m = metrics.accuracy_macro_f1(metrics.confusion(tp, group_cols=["ctx"]), ["ctx"])
    return _records(m, _best_params(cv.base.sparkSession, best))


# ------------------------------------------------------------------ k-NN ---
def _mask(df: DataFrame, feats: list[str], keep: dict | None) -> DataFrame:
    """Per-context column selection: a column not kept in the row's context
    becomes constant 0, which adds 0 to every distance: exactly dropping it."""
    if not keep:
        return df
    sel = F.create_map(*[x for c, cols in keep.items() for x in (F.lit(c), F.array(*[F.lit(f) for f in cols]))])
    kept = sel[F.col("ctx")]
    return df.select(*[c for c in df.columns if c not in feats],
                     *[F.when(F.array_contains(kept, f), F.col(f)).otherwise(F.lit(0.0)).alias(f) for f in feats])


def _knn_scores(rows: DataFrame, feats: list[str], n_folds: int, query_folds: list[int] | None,
                ks: list[int], names: list[str]) -> DataFrame:
    """Votes of every (metric, k) for rows of (ctx, fold), a table: one search per
    metric, in the same blocks."""
    votes = []
    blocks = knn_op.write_blocks(rows, feats, n_folds, query_folds=query_folds, group_col="ctx", written=True)
    for m in names:
        c = knn_op.block_candidates(rows.sparkSession, blocks, max(ks), m, "ctx")
        votes.append(knn_op.knn_vote(c, ks, ["ctx"]).withColumn("metric", F.lit(m)))
    return reduce(DataFrame.unionByName, votes)


def _knn_order(names: list[str]):
    return F.array_position(F.array(*[F.lit(x) for x in names]), F.col("metric")) * 100 + F.col("k")


def _knn_test(base: DataFrame, feats: list[str], best: dict, keep: dict | None) -> DataFrame:
    """Test rows of fold f against all rows of the other folds, with the (metric,
    k) chosen for f; one pass per chosen metric."""
    preds = []
    for m in sorted({mm for mm, _ in best.values()}):
        ctxs = [c for c, (mm, _) in best.items() if mm == m]
        part = _mask(base.withColumn("ctx", F.explode(F.array(*[F.lit(c) for c in ctxs])))
                     .withColumn("fold", F.when(F.col("fold") == F.col("ctx"), 0).otherwise(1)), feats, keep)
        cands = knn_op.knn_candidates(part, feats, max(best[c][1] for c in ctxs), m, n_folds=2, query_folds=[0],
                                      group_col="ctx")
        kmap = F.create_map(*[x for c in ctxs for x in (F.lit(c), F.lit(best[c][1]))])
        votes = knn_op.knn_vote(cands, sorted({best[c][1] for c in ctxs}), ["ctx"]).filter(F.col("k") == kmap[F.col("ctx")])
        preds.append(votes)
    m = metrics.accuracy_macro_f1(metrics.confusion(reduce(DataFrame.unionByName, preds), group_cols=["ctx"]), ["ctx"])
    chosen = {c: C.spec("KNN", n_neighbors=k, metric=name) for c, (name, k) in best.items()}
    return _records(m, _best_params(base.sparkSession, chosen))


def knn_search(df: DataFrame, features: list[str], n_folds: int = 10, seed: int = 42, keep: dict | None = None,
               inner_folds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of every (ctx, metric, k) and the folded rows.  The training rows
    of each context are split by a 90/10 hold-out (G2) or, with
    ``inner_folds``, by a plain K-fold whose scores are averaged (G4).  All
    contexts run as one grouped search per metric."""
    feats = list(features)
    base = materialize(split.stratified_folds(df.select("row_key", "label", *feats), n_folds=n_folds, seed=seed))
    rows = split.fold_contexts(base, n_folds)
    if inner_folds is None:
        rows = split.holdout(rows, group_cols=["ctx"], seed=seed)
        rows = rows.withColumn("fold", F.when(F.col("is_val"), 0).otherwise(1)).drop("is_val")
    else:
        rows = rows.withColumn("_h", split.hash_key("row_key", seed, "ctx"))
        rows = split.rank_within(rows, ["ctx"], "_h", "row_key", out="_rk").withColumn(
            "fold", ((F.col("_rk") - 1) % inner_folds).cast("int")).drop("_h", "_rk")
    rows = materialize(_mask(rows, feats, keep))
    ks, names = C.KNN_GRID["n_neighbors"], C.KNN_GRID["metric"]
    votes = _knn_scores(rows, feats, inner_folds or 2, None if inner_folds else [0], ks, names)
    g = ["ctx", "metric", "k", "fold"]
    scores = metrics.accuracy_macro_f1(metrics.confusion(votes, group_cols=g), g, digits=None)
    scores = scores.groupBy("ctx", "metric", "k").agg(F.avg("macro_f1").alias("score"))
    return _pick(scores, "ctx", _knn_order(names)), base


def knn_nested_cv(df: DataFrame, features: list[str], n_folds: int = 10, seed: int = 42,
                  keep: dict | None = None, inner_folds: int | None = None) -> DataFrame:
    """G5 for k-NN: per fold, (k, metric) chosen on the training context, then
    the test rows scored against the whole context."""
    scores, base = knn_search(df, features, n_folds, seed, keep, inner_folds)
    best = {r["ctx"]: (r["metric"], r["k"]) for r in scores.filter("is_best").collect()}
    return _knn_test(base, list(features), best, keep)


# ------------------------------------------------------------ all families ---
def family_cv(name: str, specs: list, cv: CVData, n_folds: int, seed: int, parallel: int = 8) -> DataFrame:
    """Nested CV of one family other than k-NN over the shared folds; an unknown
    name is an error."""
    family = family_of(name)
    if family == "MLP":
        return mlp_nested_cv(cv, specs or None, seed)
    if family not in BEST_COLUMNS:
        raise ValueError(f"unknown classifier {name!r}")
    specs = specs or C.default_grid(family, cv.n_classes)
    if family in ("DT", "RF"):
        return tree_nested_cv(cv, specs, seed)
    return svm_nested_cv(cv, specs, seed) if family == "SVM" else nested_cv(cv, specs, parallel)


def all_classifiers_cv(df: DataFrame, features: list[str], families: dict, n_folds: int = 10, seed: int = 42,
                       parallel: int = 8, keep: dict | None = None, cv: CVData | None = None,
                       ledger: str | None = None) -> DataFrame:
    """G6 + G11 + G12: several classifier families over the SAME folds and hold-out
    splits, stacked into one typed fold record: (classifier, fold, accuracy,
    f1, parameters, Best columns of that family, total_time_seconds of the
    family).  ``families`` maps a family name to its parameter sets (``Spec``
    lists; empty: the family's grid).  ``cv``: frames prepared before.

    ``ledger`` is a folder of finished work, one table per family: a run that is
    given the folder of a killed one does only what is missing there."""
    spark = df.sparkSession
    ledger = ledger or run_folder(spark, "ledger")
    # the k-NN search prepares its own frames
    if cv is None and not all(family_of(name) == "KNN" for name in families):
        cv = prepare_cv(df, features, n_folds, seed, keep=keep)

    def records(name, specs):
        began = time.monotonic()
        r = materialize(knn_nested_cv(df, features, n_folds, seed, keep=keep) if family_of(name) == "KNN"
                        else family_cv(name, specs, cv, n_folds, seed, parallel))
        return r.withColumns({"classifier": F.lit(name.upper()), "total_time_seconds": F.lit(round(time.monotonic() - began, 2))})
    parts = [once(spark, ledger, name.upper(), lambda n=name, s=specs: records(n, s)) for name, specs in families.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
