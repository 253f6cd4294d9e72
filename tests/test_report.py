"""J1/J4/J14/S7 against golden values and the hand fixtures."""
from pyspark.sql import functions as F

from foldwise.operators import report

# golden fold records (phase 1, SVM, dataset 1) and the summary stored next to them
GOLDEN_FOLDS = [(1, 0.9875, 0.9874), (2, 0.9885, 0.7394), (3, 0.9823, 0.7328), (4, 0.9843, 0.9788),
                (5, 0.9864, 0.9817), (6, 0.9843, 0.9788), (7, 0.977, 0.9625), (8, 0.976, 0.9749),
                (9, 0.9718, 0.7076), (10, 0.9739, 0.7147)]


def test_fold_summary_matches_golden(spark):
    df = spark.createDataFrame([("dataset_1",) + r for r in GOLDEN_FOLDS],
                               "dataset_name string, fold int, accuracy double, f1 double")
    s = report.fold_summary(df, ["dataset_name"]).first()
    assert (s["accuracy_mean"], s["accuracy_std"], s["f1_mean"], s["f1_std"]) == (0.9812, 0.006, 0.8759, 0.1315)
    assert s["accuracy_text"] == "0.9812 ± 0.0060" and s["f1_text"] == "0.8759 ± 0.1315"


def test_round_ties_half_even(spark):
    df = spark.createDataFrame([(0.12345,), (0.45685,), (0.94835,)], "x double")
    got = [r[0] for r in df.select(F.bround(F.col("x").cast("decimal(12,5)"), 4).cast("double")).collect()]
    assert got == [0.1234, 0.4568, 0.9484]


def test_modal_value_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", None), (3, "b", None), (4, "a", None)],
                               "seq int, v string, w string")
    m = {r["param"]: r["value"] for r in report.modal_value(df.withColumn("g", F.lit(1)), ["g"], ["v", "w"],
                                                            "seq").collect()}
    assert m == {"v": "b", "w": "N/A"}


def test_modal_value_drops_nulls_and_formats(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, None), (4, 0.0001)], "seq int, d double")
    m = report.modal_value(df.withColumn("g", F.lit(1)), ["g"], ["d"], "seq").first()["value"]
    assert m == "10"


def test_merge_dedupe_keeps_last(spark):
    rows = [("dataset_10", "P", "SVM", 0.5, "a.csv", 1), ("dataset_2", "P", "SVM", 0.6, "a.csv", 2),
            ("dataset_2", "P", "SVM", 0.6, "a.csv", 2), ("dataset_2", "P", "SVM", 0.7, "b.csv", 3)]
    df = spark.createDataFrame(rows, "dataset_name string, phase string, classifier string, "
                                     "test_f1_macro double, source_file string, seq int")
    out = report.merge_dedupe(df, ["dataset_name", "phase", "classifier"], "seq", "source_file") \
        .orderBy("dataset_sort", "classifier_sort").collect()
    assert [(r["dataset_name"], r["test_f1_macro"]) for r in out] == [("dataset_2", 0.7), ("dataset_10", 0.5)]
