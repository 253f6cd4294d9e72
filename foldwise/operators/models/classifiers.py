"""Classifier builders (F1, F2, F4, F6, F7, F9) on Spark ML.

Inputs are already imputed and scaled (``prep``) and assembled into a
``features`` vector; labels are a dense double ``label_idx``.  Documented
deviations from the scikit-learn estimators of the reference:

* Spark trees cap ``maxDepth`` at 30, so "unlimited" depth is 30.  There is
  no min-samples-to-split; ``minInstancesPerNode = max(1, m // 2)`` (exact
  for m = 2).  Splits are on at most ``maxBins`` quantile bins.
* ``LinearSVC`` is binary with the hinge loss (not squared hinge); multi-
  class runs one-vs-rest.  sklearn's C maps to ``regParam = 1 / (C * n)``.
* Class weights ("balanced") go through ``weightCol``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, OneVsRest, OneVsRestModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

SEED = 42
# The solvers' iteration limits
LINEAR_ITERATIONS, HINGE_ITERATIONS = 2000, 1000
MAX_SPARK_DEPTH = 30
# quantile bins per column: the statistics of a level are nodes x columns x bins x classes;
# more bins come closer to splits on exact values
MAX_BINS = 64
# reference rule: above this many classes the SVM search uses the cheaper
# hinge-loss solver with balanced weights and skips the RBF kernel
SGD_CLASS_LIMIT = 10


@dataclass(frozen=True)
class Spec:
    """One classifier + parameter set."""
    classifier: str
    params: tuple  # sorted (name, value) pairs

    @property
    def p(self) -> dict:
        return dict(self.params)


def spec(classifier: str, **params) -> Spec:
    return Spec(classifier, tuple(sorted(params.items())))


def _depth(d):
    if d is not None and int(d) > MAX_SPARK_DEPTH:
        raise ValueError(f"max_depth {d} is above the engine's limit of {MAX_SPARK_DEPTH}")
    return MAX_SPARK_DEPTH if d is None else int(d)


def _min_inst(m):
    return max(1, int(m) // 2) if m is not None else 1


def build(s: Spec, n_train: int, n_classes: int, weighted: bool = False):
    """estimator for a spec, reading ``features``/``label_idx`` (and ``weight``)."""
    p = s.p
    clf = s.classifier.upper()
    wkw = {"weightCol": "weight"} if weighted else {}
    if clf == "DT":
        return DecisionTreeClassifier(featuresCol="features", labelCol="label_idx", seed=SEED,
                                      maxDepth=_depth(p.get("max_depth")),
                                      minInstancesPerNode=_min_inst(p.get("min_samples_split", 2)),
                                      impurity=p.get("criterion", "gini"), maxBins=MAX_BINS, **wkw)
    if clf == "RF":
        return RandomForestClassifier(featuresCol="features", labelCol="label_idx", seed=SEED,
                                      numTrees=int(p.get("n_estimators", 100)),
                                      maxDepth=_depth(p.get("max_depth")),
                                      minInstancesPerNode=_min_inst(p.get("min_samples_split", 2)),
                                      featureSubsetStrategy="sqrt", maxBins=MAX_BINS, **wkw)
    if clf in ("SVM", "SVM_LINEAR", "SVM_HINGE"):
        if p.get("kernel", "linear") != "linear":
            raise ValueError(f"{s.classifier} has no kernel {p['kernel']!r}")
        c = float(p.get("C", 1.0))
        hinge = clf == "SVM_HINGE" or (clf == "SVM" and n_classes > SGD_CLASS_LIMIT)
        svc = LinearSVC(featuresCol="features", labelCol="label_idx", regParam=1.0 / (c * max(n_train, 1)),
                        maxIter=HINGE_ITERATIONS if hinge else LINEAR_ITERATIONS, tol=1e-3)
        if hinge:
            return BalancedOneVsRest(svc)
        # the k binary problems are independent: fit them as concurrent Spark jobs
        return OneVsRest(classifier=svc.setWeightCol("weight") if weighted else svc, featuresCol="features",
                         labelCol="label_idx", parallelism=max(1, min(n_classes, 8)), **wkw)
    raise ValueError(f"unknown classifier {s.classifier!r}")


class BalancedOneVsRest(Estimator):
    """one-vs-rest whose k binary problems have their own weights: rows of
    the problem's class weigh n / (k * n_class), all others 1."""

    def __init__(self, svc: LinearSVC):
        super().__init__()
        self.svc = svc

    def _fit(self, dataset):
        counts = {int(r["label_idx"]): r["count"] for r in dataset.groupBy("label_idx").count().collect()}   # k rows
        n, k = sum(counts.values()), len(counts)

        def one(c):
            own = F.col("label_idx") == float(c)
            rows = dataset.withColumns({"weight": F.when(own, n / (k * counts[c])).otherwise(1.0),
                                        "label_idx": own.cast("double")})
            return self.svc.copy().setWeightCol("weight").fit(rows)
        present = sorted(counts)
        with ThreadPoolExecutor(max_workers=max(1, min(k, 8))) as pool:
            models = list(pool.map(one, present))
        out = OneVsRestModel(models=models).setFeaturesCol("features").setPredictionCol("prediction")
        if present == list(range(k)):
            return out
        # classes without training rows never win: predictions are numbers of the present ones
        names = ", ".join(f"{c}D" for c in present)
        return PipelineModel(stages=[out, SQLTransformer(
            statement=f"SELECT * EXCEPT (prediction), get(array({names}), cast(prediction AS int)) AS prediction FROM __THIS__")])


# ------------------------------------------------------------- G1 grids ---
# The reference's parameter grids.
DT_GRID = {"max_depth": [3, 5, 10, None], "min_samples_split": [2, 5, 10], "criterion": ["gini", "entropy"]}
RF_GRID = {"n_estimators": [100, 200], "max_depth": [5, 10, None], "min_samples_split": [2, 5]}
KNN_GRID = {"n_neighbors": [3, 5, 7, 9, 11], "metric": ["euclidean", "manhattan"]}
MLP_GRID = {"hidden_layer_sizes": [(64,), (128,), (64, 64)], "learning_rate_init": [0.001, 0.01],
            "alpha": [0.0001, 0.001]}
SVM_C = [0.1, 1, 10]
SVM_GAMMA = ["scale", "auto"]


def expand(classifier: str, grid: dict) -> list[Spec]:
    """G1: cross product of the value lists, in grid order (first key slowest)."""
    from itertools import product
    keys = list(grid)
    return [spec(classifier, **dict(zip(keys, vals))) for vals in product(*[grid[k] for k in keys])]


def svm_grid(n_classes: int) -> list[Spec]:
    """Linear sets first (hinge + balanced above 10 classes), then RBF
    sets unless there are more than 10 classes."""
    lin = "SVM_HINGE" if n_classes > SGD_CLASS_LIMIT else "SVM_LINEAR"
    out = [spec(lin, kernel="linear", C=c, gamma="N/A") for c in SVM_C]
    if n_classes <= SGD_CLASS_LIMIT:
        out += [spec("SVM_RBF", kernel="rbf", C=c, gamma=g) for c in SVM_C for g in SVM_GAMMA]
    return out


def default_grid(family: str, n_classes: int) -> list[Spec]:
    """The reference's grid of a family that is fitted by Spark ML."""
    if family == "DT":
        return expand("DT", DT_GRID)
    if family == "RF":
        return expand("RF", RF_GRID)
    if family == "SVM":
        return svm_grid(n_classes)
    raise ValueError(f"no grid for {family!r}")
