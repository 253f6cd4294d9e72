"""E1-E4 invariants: folds partition the rows, sizes differ by at most one,
hold-out size = ceil(0.1 n), results do not depend on partitioning."""
import math

import numpy as np

from pyspark.sql import functions as F

from conftest import SF_SMALL
from foldwise.operators import split
from foldwise.sources.tables import view


def test_stratified_fold_contract(spark):
    v = view(spark, SF_SMALL, "li")
    f = split.stratified_folds(v.df)
    assert f.count() == v.df.count()
    per = f.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in per)
    tot = f.groupBy("fold").count().agg((F.max("count") - F.min("count")).alias("s")).first()["s"]
    assert tot <= 1
    assert f.select("row_key").distinct().count() == f.count()


def test_tiny_class_spreads_over_folds(spark):
    rows = [(i, "a" if i < 4 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "row_key long, label string")
    f = split.stratified_folds(df).filter("label = 'a'").groupBy("fold").count().collect()
    assert len(f) == 4 and all(r["count"] == 1 for r in f)


def test_partitioning_does_not_change_folds(spark):
    v = view(spark, SF_SMALL, "emb")
    ref = {r["row_key"]: r["fold"] for r in split.stratified_folds(v.df.repartition(1)).collect()}
    for n in (4, 16):
        got = {r["row_key"]: r["fold"] for r in split.stratified_folds(v.df.repartition(n)).collect()}
        assert got == ref


def test_holdout_size(spark):
    v = view(spark, SF_SMALL, "ord")
    h = split.holdout(v.df.select("row_key"))
    n = h.count()
    assert h.filter("is_val").count() == math.ceil(n * 0.1)


def test_fold_contexts_train_rows(spark):
    v = view(spark, SF_SMALL, "emb")
    f = split.stratified_folds(v.df.select("row_key", "label"))
    c = split.fold_contexts(f)
    assert c.count() == 9 * f.count()
    assert c.filter("ctx = fold").count() == 0


def test_rank_within_equals_global_window_with_hot_class(spark):
    """Bucketed ranks equal row_number() over the whole class, also when one
    class holds most rows (the skew case the buckets exist for)."""
    from pyspark.sql import Window
    rows = [(i, "hot" if i % 10 < 7 else f"c{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_key long, label string").withColumn("_h", split.hash_key("row_key"))
    got = split.rank_within(df, ["label"], "_h", "row_key", out="rk", prefix_len=2)
    want = df.withColumn("rk2", F.row_number().over(Window.partitionBy("label").orderBy("_h", "row_key")))
    joined = got.join(want, "row_key")
    assert joined.filter("rk != rk2").count() == 0 and joined.count() == 3000


def test_permutation_repeats_are_bijections(spark):
    """Every repeat's shift maps positions 1..n onto 1..n exactly once."""
    from foldwise.operators.select import shift_fractions
    for n in (1, 2, 7, 100, 1001):
        for frac in shift_fractions(10, 42):
            shift = 1 + int(np.floor(frac * (n - 1)))
            targets = {((p - 1 + shift) % n) + 1 for p in range(1, n + 1)}
            assert targets == set(range(1, n + 1))


def test_null_labels_keep_their_rows(spark):
    from foldwise.operators import prep
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2], float(i)) for i in range(100)],
                               "row_key long, label string, x double")
    folds = split.stratified_folds(df, n_folds=4)
    assert folds.count() == 100 and folds.where("label IS NULL").groupBy("fold").count().count() == 4
    assert prep.label_index(df).count() == 100 and prep.class_weights(df).count() == 100
    w = {r.label: r.weight for r in prep.class_weights(df).collect()}
    assert w == {None: 100 / 60, "a": 100 / 120, "b": 100 / 120}
    assert split.rank_within(df.withColumn("h", split.hash_key("row_key")), ["label"], "h", "row_key", prefix_len=1) \
        .select("row_key", "rank").subtract(split.rank_within(
            df.withColumn("h", split.hash_key("row_key")), ["label"], "h", "row_key", prefix_len=4).select("row_key", "rank")).count() == 0


def test_bucket_length_changes_the_spread_alone(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(200)], "row_key long, label int")
    for make in (split.stratified_folds, split.plain_folds, split.holdout):
        rows = [{tuple(r) for r in make(df, prefix_len=n).collect()} for n in (1, 3, 5)]
        assert rows[0] == rows[1] == rows[2]


def test_ranks_shuffle_the_rows_once(spark):
    """Window and offsets share one shuffle of the rows, with null groups as groups of their own."""
    from pyspark.sql import functions as F
    df = spark.range(900).select(F.col("id").alias("row_key"), F.expr("IF(id % 3 = 0, NULL, id % 3)").alias("label"),
                                 F.col("id").alias("payload"))
    d = df.withColumn("h", split.hash_key("row_key"))
    by_hash = {}
    for r in d.collect():
        by_hash.setdefault(r["label"], []).append((r["h"], r["row_key"]))
    want = {key: n for rows in by_hash.values() for n, (_, key) in enumerate(sorted(rows), 1)}
    for own in (False, True):
        got = split.rank_within(d, ["label"], "h", "row_key", prefix_len=1, own_hash=own)
        assert {r["row_key"]: r["rank"] for r in got.collect()} == want
        assert got.columns == ["row_key", "label", "payload", *([] if own else ["h"]), "rank"]
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        # rows by bucket; counts by bucket; counts by group for the offsets (and by bucket for the join)
        assert plan.count("Exchange hashpartitioning(_of") <= 3 and "hashpartitioning(coalesce" not in plan


def test_rule_predictions_shuffle_no_features(spark, tmp_path):
    """rows are ranked with their ten predictions, not with their features."""
    from datetime import date
    from foldwise.plans import rules
    rows = [(i, i % 7, i % 5, 1 + i % 7, float(i % 50 + 1), 1000.0 * (i % 90), (i % 11) / 100, (i % 9) / 100, "NAR"[i % 3], "O", date(1995, 1, 1 + i % 28))
            for i in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
                          ).write.parquet(str(tmp_path / "lineitem.parquet"))
    p = rules.rule_predictions(spark, str(tmp_path))
    used = p.select("dataset", "fold", "label", "phase", "classifier", "prediction")
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window ["):]
    inside = window[window.index("\n") + 1:].splitlines()[0]             # what is dealt to the window
    assert "Project" in inside and "_preds" in inside and "extendedprice#" not in inside.split("AS _preds")[-1]
    view = rules.rule_view(spark, str(tmp_path))
    for (classifier, phase), (sql, _) in rules.RULES.items():
        want = sorted(map(tuple, view.selectExpr("row_key", "fold", f"{sql} AS p").collect()))
        got = p.filter((p.classifier == classifier) & (p.phase == phase)).select("row_key", "fold", "prediction")
        assert sorted(map(tuple, got.collect())) == want
