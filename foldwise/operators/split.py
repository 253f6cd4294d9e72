"""Splits (E1-E4) built on one skew-safe ranking helper.

Every split is a pure function of the row key and the seed, so it does not
depend on partitioning, task order or retries:

* ``hash_key`` = md5('<seed>|<key>'), identical in Spark and DuckDB.
* ``rank_within`` numbers the rows of each group by (hash_key, key).  It never
  puts a whole group into one task: rows are cut into hash-prefix buckets, a
  small table of per-(group, bucket) counts gives each bucket its offset, and
  the row_number runs per (group, bucket), so a class holding a third of all
  rows stays spread out.  ``PREFIX_LEN`` hex digits give 4096 buckets; pass
  ``prefix_len`` so that rows / 16**prefix_len fits a task (5 for 10^11 rows).
  The prefix decides only the spread: ranks are the same for every length.

A null group or label is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import null_safe_join


def hash_key(key: Column | str, seed: int | str = 42, *salt: Column | str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    parts = [F.lit(str(seed))] + [F.col(s) if isinstance(s, str) else s for s in salt] + [k]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


PREFIX_LEN = 3


def rank_within(df: DataFrame, group_cols: list[str], order_hash: str, key: str,
                out: str = "rank", prefix_len: int = PREFIX_LEN,
                class_offset: tuple[list[str], str, str] | None = None, own_hash: bool = False) -> DataFrame:
    """Add ``out`` = 1-based position of each row in its group, ordered by
    (order_hash, key).  Same numbers as ``row_number() over (partition by
    group order by order_hash, key)`` without sending a group to one task:
    the window runs per (group, hash-prefix bucket), and each bucket's offset
    comes from a count table of at most 16**prefix_len rows per group.

    Group and bucket are one struct column, in which null equals null: the window
    and the join with the offsets share the one shuffle of the rows.

    ``class_offset=(outer_cols, class_col, name)`` also adds ``name`` = rows of
    the classes that sort before this row's class within ``outer_cols``,
    derived from the same small count table (no extra scan).

    ``own_hash``: ``order_hash`` is ``hash_key`` of the key within each group, so
    equal hashes are equal keys: it travels as 16 bytes, the key only if the
    caller reads it, and the column is dropped from the result.
    """
    if not group_cols:
        raise ValueError("rank_within needs at least one group column")
    bucket = "_bucket"
    kept = [c for c in df.columns if c != order_hash or not own_hash]
    rest = [F.col(c) for c in df.columns if c not in group_cols and c != order_hash]
    of = F.struct(*group_cols, F.substring(F.col(order_hash), 1, prefix_len).alias(bucket)).alias("_of")
    order = F.unhex(order_hash).alias(order_hash) if own_hash else F.col(order_hash)
    d = df.select(*rest, *([] if order_hash in group_cols else [order]), of)
    counts = df.select(of).groupBy("_of").agg(F.count(F.lit(1)).alias("_n")).select("_of.*", "_n")
    w_in = (Window.partitionBy(*group_cols).orderBy(bucket)
            .rowsBetween(Window.unboundedPreceding, -1))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w_in), F.lit(0)))
    added = []
    if class_offset is not None:
        outer, cls, name = class_offset
        added = [name]
        totals = counts.groupBy(*outer, cls).agg(F.sum("_n").alias("_cn"))
        w_c = (Window.partitionBy(*outer) if outer else Window.partitionBy(F.lit(0))).orderBy(cls) \
            .rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn(name, F.coalesce(F.sum("_cn").over(w_c), F.lit(0))).drop("_cn")
        offs = null_safe_join(offs, totals, [*outer, cls])
    offs = offs.select(F.struct(*group_cols, bucket).alias("_of"), "_off", *added)
    local = Window.partitionBy("_of").orderBy(order_hash, *([] if own_hash else [key]))
    ranked = d.withColumn("_in", F.row_number().over(local)).join(offs, "_of")
    return ranked.select(*[F.col(f"_of.{c}").alias(c) if c in group_cols else F.col(c) for c in kept], *added,
                         (F.col("_in") + F.col("_off")).alias(out))


def stratified_folds(df: DataFrame, key: str = "row_key", label: str = "label",
                     n_folds: int = 10, seed: int = 42, fold_col: str = "fold",
                     group_cols: list[str] | None = None, prefix_len: int = PREFIX_LEN) -> DataFrame:
    """Stratified shuffled K-fold.  fold = (class_offset + rank - 1) mod K.

    Per class the fold sizes differ by at most one, and so do the totals.
    Folds are numbered 0..K-1.  ``group_cols`` (e.g. dataset) split each
    group independently; the class offset restarts in every group.
    """
    g = list(group_cols or [])
    d = df.withColumn("_h", hash_key(key, seed))
    d = rank_within(d, [*g, label], "_h", key, out="_rk", prefix_len=prefix_len,
                    class_offset=(g, label, "_class_off"), own_hash=True)
    return (d.withColumn(fold_col, ((F.col("_class_off") + F.col("_rk") - 1) % n_folds).cast("int"))
            .drop("_rk", "_class_off"))


def plain_folds(df: DataFrame, key: str = "row_key", n_folds: int = 10, seed: int = 42,
                fold_col: str = "fold", prefix_len: int = PREFIX_LEN) -> DataFrame:
    """Unstratified shuffled K-fold, fold = (rank - 1) mod K."""
    d = df.withColumn("_h", hash_key(key, seed)).withColumn("_g", F.lit(0))
    d = rank_within(d, ["_g"], "_h", key, out="_rk", prefix_len=prefix_len, own_hash=True)
    return d.withColumn(fold_col, ((F.col("_rk") - 1) % n_folds).cast("int")).drop("_rk", "_g")


def holdout(df: DataFrame, key: str = "row_key", group_cols: list[str] | None = None,
            test_size: float = 0.10, seed: int = 42, out: str = "is_val", prefix_len: int = PREFIX_LEN) -> DataFrame:
    """One unstratified shuffled hold-out split per group.

    The first ceil(test_size * n) rows of each group in hash order are the
    validation part (the size rule of a 90/10 shuffle split).
    """
    group_cols = list(group_cols or [])
    salt = group_cols
    d = df.withColumn("_h", hash_key(key, seed, *salt))
    if not group_cols:
        d = d.withColumn("_g", F.lit(0))
        group_cols = ["_g"]
    d = rank_within(d, group_cols, "_h", key, out="_rk", prefix_len=prefix_len, own_hash=True)
    n = d.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_gn"))
    d = null_safe_join(d, n, group_cols)
    d = d.withColumn(out, F.col("_rk") <= F.ceil(F.col("_gn") * F.lit(test_size)))
    return d.drop("_rk", "_gn", *(["_g"] if "_g" in d.columns else []))


def fold_contexts(df: DataFrame, n_folds: int = 10, fold_col: str = "fold",
                  ctx_col: str = "ctx") -> DataFrame:
    """E4 in one pass: each row once per fold context where it is a training row."""
    return (df.withColumn(ctx_col, F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
            .filter(F.col(ctx_col) != F.col(fold_col)))


def train_test(df: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Training and test view of one fold."""
    return df.filter(F.col(fold_col) != fold), df.filter(F.col(fold_col) == fold)
