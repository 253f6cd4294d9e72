"""D1-D4 against hand-computed values (scikit-learn contract)."""
import pytest
from pyspark.sql import functions as F

from foldwise.operators import prep


def test_nan_mix_impute_and_population_std(spark):
    df = spark.createDataFrame([(1.0, float("nan"), None), (2.0, 3.0, None), (6.0, None, None)],
                               "a double, b double, c double")
    m = {r["feature"]: r for r in prep.moments(df, ["a", "b", "c"]).collect()}
    assert m["a"]["mean"] == pytest.approx(3.0)
    assert m["a"]["std"] == pytest.approx(2.1602, abs=1e-4)      # population, not sample (2.6458)
    assert m["b"]["mean"] == pytest.approx(3.0) and m["b"]["std"] == 0.0 and m["b"]["scale"] == 1.0
    assert m["c"]["n"] == 0                                         # all-null column: no training values
    out = prep.impute_mean(df, ["b"]).collect()
    assert [r["b"] for r in out] == [3.0, 3.0, 3.0]


def test_zero_variance_column_is_only_centred(spark):
    train = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    test = spark.createDataFrame([(5.0,)], "x double")
    mom = prep.moments(train.selectExpr("x", "0 AS g"), ["x"], ["g"])
    v = prep.apply_moments(test.selectExpr("x", "0 AS g"), mom, ["x"], ["g"]).first()["x"]
    assert v == 4.0


def test_fold_moments_equal_direct_moments(spark):
    rows = [(i, i % 3, float(i * i % 7) if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "row_key long, fold int, x double")
    fm = {r["ctx"]: r for r in prep.fold_moments(df, ["x"], n_folds=3).collect()}
    for ctx in range(3):
        tr = df.filter(F.col("fold") != ctx)
        d = prep.moments(tr, ["x"]).first()
        assert fm[ctx]["mean"] == pytest.approx(d["mean"])
        assert fm[ctx]["std"] == pytest.approx(d["std"])


def test_balanced_class_weights(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(8)], "row_key long, label string")
    w = {r["label"]: r["weight"] for r in prep.class_weights(df).select("label", "weight").distinct().collect()}
    assert w["a"] == pytest.approx(8 / (2 * 6)) and w["b"] == pytest.approx(8 / (2 * 2))


def test_cv_frames_scaled_without_leakage(spark):
    """Training rows of every context are standardised (mean 0, population std 1)
    with moments of that context only; validation and test rows are scaled
    with the same numbers but never enter them."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from foldwise.plans import tune
    rng = np.random.default_rng(11)
    rows = [(i, int(i % 3), float(rng.normal(5, 2)), float(rng.normal(-1, 0.5))) for i in range(90)]
    df = spark.createDataFrame(rows, "row_key long, label int, a double, b double")
    cv = tune.prepare_cv(df, ["a", "b"], n_folds=3)
    def matrix(ctx, part):
        return np.array([r["x"] for r in cv.vectors(ctx, part).select(vector_to_array("features").alias("x")).collect()])
    for ctx in range(3):
        for part, n in (("train", cv.n_train[ctx]), ("sub", cv.n_sub[ctx])):
            m = matrix(ctx, part)
            assert len(m) == n and np.allclose(m.mean(0), 0, atol=1e-9) and np.allclose(m.std(0), 1, atol=1e-9)
        assert cv.n_sub[ctx] + len(matrix(ctx, "val")) == cv.n_train[ctx]
    # the scaled test rows are not standardised themselves (their moments were not used)
    means = [matrix(ctx, "test").mean(0) for ctx in range(3)]
    assert not all(np.allclose(mm, 0, atol=1e-9) for mm in means)
