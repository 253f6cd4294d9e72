"""Table profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import ratio_round


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, columns per type family, total missing values (null or NaN).

    One aggregate scan; the type counts are schema metadata.
    """
    kinds = {"double": 0, "integer": 0, "string": 0, "other": 0}
    for f in df.schema.fields:
        t = f.dataType
        k = ("double" if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)) else
             "integer" if isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) else
             "string" if isinstance(t, T.StringType) else "other")
        kinds[k] += 1
    missing = []
    for f in df.schema.fields:
        c = F.col(f.name)
        bad = c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()
        missing.append(F.sum(bad.cast("long")))
    total_missing = sum(missing[1:], missing[0]) if missing else F.lit(0)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total_missing.alias("n_missing")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"),
        *[F.lit(v).cast("long").alias(f"n_{k}_cols") for k, v in kinds.items()], "n_missing")


def class_count(df: DataFrame, label: str = "label") -> DataFrame:
    """Number of distinct classes."""
    return df.agg(F.countDistinct(label).alias("n_classes"))


def class_distribution(df: DataFrame, label: str = "label", digits: int = 4) -> DataFrame:
    """Count and share per class, plus the dominant class flag
    (largest count; ties -> smallest label)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w_all = Window.partitionBy(F.lit(0))
    w_rank = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), F.asc("label"))
    return (counts.withColumn("share", ratio_round(F.col("n"), F.sum("n").over(w_all), digits))
            .withColumn("is_dominant", F.row_number().over(w_rank) == 1))


def tables_equal_ordered(df: DataFrame, pair_col: str, side_col: str, position_col: str, cols: list[str]) -> DataFrame:
    """C4, order-sensitive: rows of both sides meet at their position; a position
    of one side only, or with a differing value, is a difference (nulls are equal)."""
    row = F.struct(*cols)
    side = F.col(side_col)
    met = df.groupBy(pair_col, position_col).agg(
        F.count(F.when(side == 0, 1)).alias("_na"), F.count(F.when(side == 1, 1)).alias("_nb"),
        F.max(F.when(side == 0, row)).alias("_a"), F.max(F.when(side == 1, row)).alias("_b"))
    same = (F.col("_na") == F.col("_nb")) & F.col("_a").eqNullSafe(F.col("_b"))
    return met.groupBy(pair_col).agg(
        F.sum("_na").alias("n_rows_a"), F.sum("_nb").alias("n_rows_b"),
        F.count(F.when(~same, 1)).alias("n_different")).withColumn("equal", F.col("n_different") == 0)


def tables_equal_pairs(df: DataFrame, pair_col: str, side_col: str, cols: list[str]) -> DataFrame:
    """C4 for many table pairs in one pass: rows tagged (pair, side 0/1).

    One aggregation counts every distinct row per side; the rows only one side
    has (with multiplicity) equal ``exceptAll`` in both directions.
    """
    side = F.col(side_col)
    counts = df.groupBy(pair_col, *cols).agg(F.sum((side == 0).cast("long")).alias("_na"),
                                             F.sum((side == 1).cast("long")).alias("_nb"))
    out = counts.groupBy(pair_col).agg(
        F.sum(F.greatest(F.col("_na") - F.col("_nb"), F.lit(0))).alias("n_only_a"),
        F.sum(F.greatest(F.col("_nb") - F.col("_na"), F.lit(0))).alias("n_only_b"))
    return out.withColumn("equal", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0))
