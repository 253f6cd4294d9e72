"""Fitted models: better than the majority class on separable data (scores are
not exact: they depend on solver and random sequence)."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import metrics, prep
from foldwise.operators.models import classifiers as C
from foldwise.operators.models import mlp
from foldwise.plans import catalog_models as CM


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(3)
    n = 300
    lab = rng.integers(0, 3, size=n)
    x = rng.normal(size=(n, 4)) * 0.3
    x[:, 0] += lab * 2.0
    x[:, 1] -= lab
    rows = [(int(i), int(lab[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_key long, label int, a double, b double, c double, d double")
    return df.filter("row_key % 5 != 0"), df.filter("row_key % 5 = 0"), ["a", "b", "c", "d"]


@pytest.mark.parametrize("s", CM.FINAL_SPECS + [C.spec("SVM_HINGE", kernel="linear", C=1.0, gamma="N/A")],
                         ids=lambda s: s.classifier)
def test_spark_ml_classifiers_learn(spark, separable, s):
    train, test, feats = separable
    labels = prep.label_domain(train, test)
    model = CM.fit_pipeline(train, feats, s, labels)
    pred = CM._labelled_predictions(model, test, labels)
    acc = metrics.accuracy_macro_f1(metrics.confusion(pred)).first()["accuracy"]
    assert acc > 0.8


def test_mlp_trainer_learns(spark, separable):
    train, test, feats = separable
    labels = prep.label_domain(train, test)
    tr = CM._mlp_frame(train, feats, train, labels)
    models = mlp.train_many(tr, [mlp.MLPJob(0, 0, (16,), 0.01, 1e-4)], len(feats), 3, max_epochs=100)
    te = CM._mlp_frame(test, feats, train, labels).withColumn("stop", F.lit(False))
    pred = mlp.predict(te, models, {0: 0}).withColumn("prediction", F.col("pred_idx"))
    acc = metrics.accuracy_macro_f1(metrics.confusion(pred.withColumn("label", F.col("y")))).first()["accuracy"]
    assert acc > 0.8


def test_forest_selection_keeps_informative_columns(spark, separable):
    train, _, feats = separable
    imp, sel = CM.forest_selection(train, feats, n_repeats=3)
    kept = sel.first()["selected_features"]
    assert "a" in kept and len(kept) >= 1
    assert {r["feature"] for r in imp.collect()} == set(feats)


def test_all_classifiers_share_folds_and_stack_typed_records(spark, separable):
    from foldwise.plans import tune
    train, test, feats = separable
    df = train.unionByName(test)
    fams = {"DT": [C.spec("DT", max_depth=3, min_samples_split=2, criterion="gini"),
                   C.spec("DT", max_depth=None, min_samples_split=2, criterion="entropy")],
            "KNN": []}
    r = tune.all_classifiers_cv(df, feats, fams, n_folds=3)
    rows = r.collect()
    assert {x["classifier"] for x in rows} == {"DT", "KNN"} and len(rows) == 6
    assert all(x["accuracy"] > 0.8 for x in rows)
    dt = [x for x in rows if x["classifier"] == "DT"]
    assert all(x["best_criterion"] in ("gini", "entropy") and x["best_k"] is None for x in dt)
    assert all(json.loads(x["parameters"])["min_samples_split"] == 2 for x in dt)
    with pytest.raises(ValueError):
        tune.all_classifiers_cv(df, feats, {"BOOST": []}, n_folds=3)


def test_phase2_all_five_families_share_the_selection(spark, separable):
    train, test, feats = separable
    df = train.unionByName(test)
    fams = {"KNN": [], "DT": [C.spec("DT", max_depth=3, min_samples_split=2, criterion="gini")],
            "RF": [C.spec("RF", n_estimators=5, max_depth=4, min_samples_split=2)],
            "SVM": [C.spec("SVM_RBF", kernel="rbf", C=1, gamma="scale")],
            "MLP": [C.spec("MLP", hidden_layer_sizes=(16,), learning_rate_init=0.01, alpha=1e-4)]}
    r = CM.phase2_cv(df, feats, fams, n_folds=2, n_repeats=2).collect()
    assert {x["classifier"] for x in r} == set(fams) and len(r) == 10
    by_fold = {}
    for x in r:
        by_fold.setdefault(x["fold"], set()).add(x["selected_text"])
    assert all(len(v) == 1 for v in by_fold.values())          # one selection per fold, shared
    assert all("a" in x["selected_text"].split(", ") and x["accuracy"] > 0.5 for x in r)


def test_dropped_columns_do_not_reach_a_forest(spark):
    """One informative column among 40: on the kept column alone the forest is
    right; a frame with zeroed columns would mislead its column sampling."""
    from foldwise.plans import tune
    rng = np.random.default_rng(1)
    feats = [f"c{i}" for i in range(40)]
    rows = [(i, i % 2, float(i % 2 + rng.normal() * 0.05), *map(float, rng.normal(size=39))) for i in range(200)]
    df = spark.createDataFrame(rows, "row_key long, label int, " + ", ".join(f"{c} double" for c in feats))
    keep = {0: ["c0"], 1: ["c0"]}
    cv = tune.prepare_cv(df, feats, n_folds=2, keep=keep)
    assert len(cv.rows(0, "train").first()["x"]) == 1 and cv.variance(0, False) == 1.0
    r = tune.nested_cv(cv, [C.spec("RF", n_estimators=10, max_depth=5, min_samples_split=2)]).collect()
    assert all(x["accuracy"] > 0.99 for x in r)
    plan = cv.rows(0, "train")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan
    assert cv.base.count() == 200


def test_forest_arrays_score_as_spark_does(spark, separable):
    from pyspark.ml.functions import vector_to_array
    from foldwise.operators import forest
    train, test, feats = separable
    labels = prep.label_domain(train)
    model = CM.fit_pipeline(train, feats, C.spec("RF", n_estimators=12, max_depth=None, min_samples_split=2), labels)
    f = forest.read_forest(model.stages[-1], spark, 3)
    rows = model.transform(test).select(vector_to_array("features").alias("x"), vector_to_array("probability").alias("p")).collect()
    x = np.array([r.x for r in rows])
    assert np.allclose(f.scores(x) / 12, np.array([r.p for r in rows]))
    batch = forest.Walked(f, x)
    for c in batch.pairs:                       # a changed column, against scoring the changed rows
        other = x.copy()
        other[:, c] = np.roll(x[:, c], 7)
        assert np.allclose(batch.changed(c, other[:, c]), f.scores(other))


def test_importance_walks_once_for_all_repeats(monkeypatch):
    """Other values of a column: scores are those of the changed rows, also with impure leaves
    and missing values, and ways that do not meet the column again are not walked anew."""
    from foldwise.operators import forest
    from foldwise.operators.models import trees
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, (400, 6)).astype(float), rng.integers(0, 3, 400)
    x[::50, 2] = np.nan
    for many in (4, 1):                                    # many copies of a row: impure leaves
        own = np.repeat(x[::many], many, axis=0)
        job = trees.TreeJob(0, 0, "gini", 5, True, True)
        h = rng.integers(-2 ** 62, 2 ** 62, 400)
        grown = trees.grow(own, y, {t: trees.drawn_weights(h, job, t) for t in range(5)}, np.ones(3), job, 3)
        f = forest.forest_of(trees.read_trees(grown))
        batch = forest.Walked(f, own)
        assert np.allclose(batch.whole, f.scores(own)) and (batch.pure is None) == (many == 4)
        walked, walk = [], forest.Forest.walk
        monkeypatch.setattr(forest.Forest, "walk", lambda self, x, rows, *a, **kw: walked.append(len(rows)) or walk(self, x, rows, *a, **kw))
        for c in batch.pairs:
            for shift in (1, 77):
                other = own.copy()
                other[:, c] = np.roll(own[:, c], shift)
                assert np.allclose(batch.changed(c, other[:, c]), batch.whole + batch.change(c, other[:, c]))
                seen = sum(walked)
                got = batch.changed(c, other[:, c])
                assert sum(walked) - seen < len(np.unique(batch.pair[batch.pairs[c]]))
                assert np.allclose(got, forest.Walked(f, other).whole)
        monkeypatch.undo()



def test_mlp_does_not_depend_on_partitions(spark, separable):
    train, test, feats = separable
    labels = prep.label_domain(train)
    frame = CM._mlp_frame(train, feats, train, labels).cache()
    jobs = [mlp.MLPJob(0, 0, (8,), 0.01, 1e-4), mlp.MLPJob(1, 0, (4, 4), 0.01, 1e-3)]
    got = [mlp.train_many(frame.repartition(n), jobs, 4, 3, max_epochs=10, slot_rows=10_000) for n in (1, 4, 16)]
    for other in got[1:]:
        for m in (0, 1):
            assert all(np.array_equal(a, b) for a, b in zip(got[0][m], other[m]))


def test_balanced_hinge_weights_only_its_own_class(spark):
    """90 rows of class 0, 10 of class 1: each binary problem weighs its
    class by n / (k * n_class) and the rest by 1."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.classification import LinearSVC
    df = spark.createDataFrame([(float(i % 10 == 0), float(i % 10 == 0) + 0.01 * i) for i in range(100)], "label_idx double, a double")
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    seen = []

    class Spy(LinearSVC):
        def copy(self, extra=None):
            return self

        def setWeightCol(self, value):
            return self

        def fit(self, dataset, params=None):
            seen.append({(r.label_idx, round(r.weight, 4)) for r in dataset.select("label_idx", "weight").distinct().collect()})
            return LinearSVC(labelCol="label_idx", maxIter=5).fit(dataset)
    C.BalancedOneVsRest(Spy()).fit(df)
    assert sorted(map(sorted, seen)) == sorted([[(0.0, 1.0), (1.0, round(100 / 180, 4))], [(0.0, 1.0), (1.0, 5.0)]])


def test_final_test_records(spark, separable):
    from foldwise.plans import final
    train, test, feats = separable
    df = train.unionByName(test)
    two = df.withColumn("dataset", F.lit(1)).unionByName(
        df.withColumn("dataset", F.lit(2)).withColumn("row_key", F.col("row_key") + 1000).where("label < 2"))
    data = final.prepare_final(two, feats, "dataset")
    params = {"RF": {"n_estimators": 5, "max_depth": 4, "min_samples_split": None},
              "MLP": {"hidden_layer_sizes": (16,), "learning_rate_init": 0.01, "alpha": 1e-4}, "KNN": {"n_neighbors": 3, "metric": "manhattan"}}
    rows = final.final_test(data, params, "phase1").collect()
    assert {(r.dataset, r.classifier) for r in rows} == {(d, c) for d in (1, 2) for c in ("DT", "RF", "SVM", "KNN", "MLP")}
    assert all(r.test_accuracy > 0.8 and r.time_seconds > 0 for r in rows)
    assert {(r.dataset, r.num_classes, r.train_rows + r.test_rows) for r in rows} == {
        (1, 3, two.where("dataset = 1").count()), (2, 2, two.where("dataset = 2").count())}
    rf = next(r for r in rows if r.classifier == "RF")
    assert json.loads(rf.hyperparameters) == {"max_depth": 4, "min_samples_split": 2, "n_estimators": 5}
    conf = spark.read.parquet(rf.confusion_matrix_file)
    assert conf.where("ctx = 1 AND classifier = 'RF'").agg(F.sum("n")).first()[0] == rf.test_rows


def test_factory_errors():
    from foldwise.plans import final
    for clf, params in (("BOOST", {}), ("SVM", {"kernel": "poly"}), ("KNN", {"metric": "cosine"}), ("DT", {"depth": 3})):
        with pytest.raises(ValueError):
            final.make_spec(clf, params, 3)
    assert final.make_spec("SVM", {"kernel": "linear"}, 11).classifier == "SVM_HINGE"
    assert final.make_spec("svm", {"kernel": "rbf"}, 11).classifier == "SVM_RBF"
    with pytest.raises(ValueError):
        C.build(C.spec("SVM_LINEAR", kernel="poly", C=1.0), 10, 2)
    with pytest.raises(ValueError):
        C.build(C.spec("DT", max_depth=31), 10, 2)


def test_final_test_datasets_uses_the_tuned_parameters(spark, monkeypatch):
    """Every family, the forest too, gets the table's values."""
    tuned = {"RF": {"n_estimators": 200, "max_depth": 10, "min_samples_split": 5}, "DT": {"max_depth": 3}}
    monkeypatch.setattr(CM, "tuned_params", lambda *a: {k: dict(v) for k, v in tuned.items()})
    monkeypatch.setattr(CM.final, "prepare_final", lambda *a: None)
    monkeypatch.setattr(CM.final, "final_test", lambda data, params, phase: params)
    assert CM.q_final_test_datasets(spark, "/root/testdata/sf0.001") == tuned


def test_trees_split_on_64_bins(spark):
    """A step at 33/64 of a column is found exactly."""
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(float(i % 64), float(i % 64 >= 33)) for i in range(640)], "a double, label_idx double")
    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    model = C.build(C.spec("DT", max_depth=1, min_samples_split=2, criterion="gini"), 640, 2).fit(rows)
    assert model.transform(rows).where("prediction <> label_idx").count() == 0
    assert C.build(C.spec("RF"), 640, 2).getMaxBins() >= 64


def test_nested_cvs_of_all_families_are_registered(monkeypatch):
    """G6 and G7 run the five families, each with its whole grid."""
    import __spark_entry__
    from types import SimpleNamespace
    registered = __spark_entry__.queries()
    assert {"rf_cv", "rbf_svm_cv", "all_classifiers_cv", "phase2_all_cv"} <= set(registered)
    asked = []

    class Records:
        def drop(self, *names):
            return self
    monkeypatch.setattr(CM, "view", lambda *a: SimpleNamespace(df=None, features=["a"]))
    for module, name in ((CM.tune, "all_classifiers_cv"), (CM, "phase2_cv")):
        monkeypatch.setattr(module, name, lambda df, feats, families: asked.append(families) or Records())
    registered["all_classifiers_cv"](None, "")
    registered["phase2_all_cv"](None, "")
    assert asked == [{f: [] for f in ("DT", "RF", "KNN", "SVM", "MLP")}] * 2


def test_scoring_errors(spark, separable):
    from foldwise.streaming.score import class_probabilities, score_batch
    train, test, feats = separable
    labels = prep.label_domain(train)
    svm = CM.fit_pipeline(train, feats, C.spec("SVM_LINEAR", kernel="linear", C=1.0, gamma="N/A"), labels)
    tree = CM.fit_pipeline(train, feats, C.spec("DT", max_depth=3, min_samples_split=2, criterion="gini"), labels)
    assert score_batch(tree, test).columns == ["row_key", "label", "prediction"]
    assert class_probabilities(tree, test, ["row_key"]).count() == 3 * test.count()
    for call in (lambda: score_batch(tree, test.where("false")), lambda: class_probabilities(tree, test.where("false"), ["row_key"]),
                 lambda: class_probabilities(svm, test, ["row_key"]), lambda: score_batch(tree, test.drop("a"))):
        with pytest.raises(ValueError):
            call()


def test_mlp_trainer_starts_no_second_python_worker(spark):
    """a round sums its records in stages of their own; a Python row function
    behind the trainer would run a second worker beside every training task."""
    from foldwise.operators.models import mlp
    rows = [(i, 0, [float(i % 2), float(i % 3)], i % 2, i % 10 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "row_key long, ctx int, x array<double>, y int, stop boolean")
    jobs = [mlp.MLPJob(0, 0, (4,), 0.01, 0.0001), mlp.MLPJob(1, 0, (4,), 0.01, 0.001)]
    from unittest import mock
    from pyspark.sql import DataFrame
    with mock.patch.object(DataFrame, "rdd", property(lambda self: pytest.fail("Python rows"))):
        one = mlp.train_many(df, jobs, 2, 2, max_epochs=10, slot_rows=20)
    # several slots of a context in one task are told apart, whatever the batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        two = mlp.train_many(df, jobs, 2, 2, max_epochs=10, slot_rows=20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(one) == sorted(two) == [0, 1]
    for m in one:
        for a, b in zip(one[m], two[m]):
            assert np.allclose(a, b, rtol=0, atol=1e-12)
