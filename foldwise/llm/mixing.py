"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken ``target / source_size`` times; the
whole part is sure, the fraction is a probability.  Pivotal rounding pairs two
fractional documents and moves words from one to the other, at random but
without changing their expected sum, until one of them is 0 or 1; the other
goes on.  So the taken words of a source differ from its target by less than
one document, while each document keeps its probability.

The pairs form a reduction tree: documents are dealt by a hash to leaves of
about ``LEAF_ROWS`` rows per source (a large source has many leaves), a task
streams its leaves, large documents first, and holds one fractional document at a time,
and the at most one that is left of each leaf goes up to the next level, where
``FAN_IN`` leaves meet.  Random numbers come from hashes of the documents, so
reruns and other partitionings give the same mix.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share ``share`` times all words; a target above ``cap`` times its source's
size stops there and the excess is shared again by weight.  The level of the
shares is found from sums over the sources; no source list goes to the driver.

Defined results: null or blank texts have size 0, take 0 words and are never
paired; a source without words has target 0; a null source is one source; a
null doc_id and repeated rows are documents like others; an empty table gives
no row; columns of the documents that clash with result names are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm import textarrays as ta
from foldwise.llm.frames import annotate, bound_batches, stored

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
LEAF_ROWS = 4_000
FAN_IN = 32
TINY = 1e-9


def sizes(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with size, the number of words."""
    def make():
        def compute(batch):
            data, bounds = ta.column_bytes(batch.column(0))
            out = [np.diff(ta.word_spans(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], ta.NON_SPACE)[2])
                   for lo, hi in ta.slices(bounds)]
            return [np.concatenate(out) if out else np.empty(0, np.int64)]
        return compute
    return annotate(docs, {"text": f"`{text}`"}, [("size", "bigint")], make, keep)


def targets(sized: DataFrame, source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, n_docs, target) per source."""
    sources = stored(sized.groupBy(F.col(source).alias("source")).agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "sources")
    # ranks by a distributed sort; only the sources' names are indexed
    spark = sized.sparkSession
    ranked = spark.createDataFrame(
        sources.select("source").orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(
            lambda x: (x[0][0], x[1])), "source string, rank bigint")
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.col("rank") % len(weights)]
    rows = stored(sources.join(ranked, sources.source.eqNullSafe(ranked.source)).select(
        sources.source, "source_size", "n_docs", weight.alias("weight")), "sources")
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        # sources at their cap for this level, and what they leave to the others
        at_cap = F.col("source_size") * cap <= F.col("weight") * level
        n, used, free = rows.agg(
            F.count(F.when(at_cap, 1)), F.sum(F.when(at_cap, F.col("source_size") * cap)),
            F.sum(F.when(~at_cap, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - (used or 0)) / free
    return rows.select("source", "source_size", "n_docs", F.least(
        (F.col("source_size") * cap).cast("double"), F.col("weight") * level).alias("target"))


def pivot(p: float, w: float, q: float, v: float, u: float) -> tuple[float, float]:
    """One pivotal step for probabilities p, q of documents of w, v words:
    keeps w * p + v * q, makes one of them 0 or 1; u is uniform in [0, 1)."""
    up = min(1.0 - p, q * v / w)              # more of the first
    down = min(p, (1.0 - q) * v / w)          # less of the first
    if u * (up + down) < down:
        p, q = p + up, q - up * w / v
    else:
        p, q = p - down, q + down * w / v
    return tuple(0.0 if x < TINY else 1.0 if x > 1.0 - TINY else x for x in (p, q))


def _level(rows: DataFrame, last: bool) -> DataFrame:
    """Pair the fractional rows of each (source, leaf); ``p`` becomes 0 or 1
    but for one row of a leaf, which is rounded by its own number if ``last``."""
    def run(batches):
        held = None                           # (leaf key, row, p, size) that is still fractional

        def out(pairs):
            whole = pa.Table.from_batches([r for r, _ in pairs]).combine_chunks().to_batches()
            for b in whole:
                at = b.schema.get_field_index("p")
                yield b.set_column(at, "p", pa.array([p for _, p in pairs], pa.float64()))

        def settle(p, u):
            return (1.0 if u < p else 0.0) if last else p

        for batch in batches:
            names = batch.schema.names
            col = {k: batch.column(names.index(k)) for k in ("source", "leaf", "p", "size", "u1", "u2")}
            key = list(zip(col["source"].to_pylist(), col["leaf"].to_pylist()))
            p, size = col["p"].to_pylist(), col["size"].to_pylist()
            u1, u2 = col["u1"].to_pylist(), col["u2"].to_pylist()
            done = list(p)
            closed = []                       # earlier batches' rows that are settled now
            open_at = None
            for i in range(len(p)):
                if held is not None and held[0] != key[i]:
                    value = settle(held[2], held[4])
                    if held[1] is None:
                        done[open_at] = value
                    else:
                        closed.append((held[1], value))
                    held = None
                if not TINY <= p[i] <= 1.0 - TINY:
                    done[i] = round(p[i])
                    continue
                if held is None:
                    held, open_at = (key[i], None, p[i], size[i], u2[i]), i
                    continue
                a, b = pivot(held[2], held[3], p[i], size[i], u1[i])
                if 0.0 < a < 1.0:
                    done[i] = b
                    held = (held[0], held[1], a, held[3], held[4])
                    continue
                if held[1] is None:
                    done[open_at] = a
                else:
                    closed.append((held[1], a))
                held = None
                if 0.0 < b < 1.0:
                    held, open_at = (key[i], None, b, size[i], u2[i]), i
                else:
                    done[i] = b
            if closed:
                yield from out(closed)
            at = names.index("p")
            batch = batch.set_column(at, "p", pa.array(done, pa.float64()))
            if held is not None and held[1] is None:
                one = batch.slice(open_at, 1)
                held = (held[0], one, *held[2:])
                batch = pa.concat_batches([batch.slice(0, open_at), batch.slice(open_at + 1)])
            if batch.num_rows:
                yield batch
        if held is not None:
            yield from out([(held[1], settle(held[2], held[4]))])

    # large documents first: what is left at the end is then a small one
    order = ["source", "leaf", F.desc("size"), "u1", "u2"]
    return rows.repartition("source", "leaf").sortWithinPartitions(*order).mapInArrow(run, rows.schema)


def mix(docs: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text",
        keep: list[str] | None = None, seed: int = 1, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The ``keep`` columns of ``docs`` (default: doc and source) with size,
    source_size, target, copies and taken (copies * size), one row per document."""
    keep = [doc, source] if keep is None else keep
    bound_batches(docs.sparkSession)
    # sizes are counted once for the sums and once with the carried columns:
    # cheaper than a stored copy of the texts
    sized = sizes(docs.withColumns({"_doc": F.col(doc), "_source": F.col(source).cast("string")}), text,
                  [*keep, "_doc", "_source"])
    shares = targets(sized.select("_source", "size"), "_source", weights, share, cap)
    leaves = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / LEAF_ROWS)).cast("int")
    most = shares.agg(F.max("n_docs")).first()[0] or 0
    shares = shares.withColumn("leaves", leaves)
    chance = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(shares, sized["_source"].eqNullSafe(shares["source"])).select(
        F.struct(*[sized[c] for c in keep]).alias("row"), sized["_source"].alias("source"), sized["size"],
        "source_size", "target", F.floor(chance + TINY).cast("long").alias("whole"), chance.alias("chance"), "leaves",
        *[((F.xxhash64(F.lit(seed + k), sized["_doc"].cast("string"), sized["size"]).bitwiseAND(
            F.lit((1 << 53) - 1))) / float(1 << 53)).alias(f"u{k}") for k in (1, 2)])
    fraction = F.greatest(F.lit(0.0), F.col("chance") - F.col("whole"))
    rows = joined.select(
        "row", "source", "size", "source_size", "target", "whole", "u1", "u2",
        F.when(F.col("size") > 0, fraction).otherwise(0.0).alias("p"),
        F.pmod(F.xxhash64(F.lit(seed), "u1", "u2"), F.col("leaves")).cast("int").alias("leaf"))
    levels = 1 + max(1, math.ceil(math.log(max(2, math.ceil(most / LEAF_ROWS)), FAN_IN)))
    done = None
    for k in range(levels):
        last = k == levels - 1
        rows = stored(_level(rows, last), "mix-level")
        # all but the fractional rows are settled; those go up one level
        settled = rows if last else rows.where("p = 0 OR p = 1")
        done = settled if done is None else done.unionByName(settled)
        rows = rows.where("p > 0 AND p < 1").withColumn("leaf", F.expr(f"leaf DIV {FAN_IN}").cast("int"))
    clash = {"size", "source_size", "target", "copies", "taken"}
    copies = F.col("whole") + F.col("p").cast("long")
    return done.select(*[F.col("row").getField(c).alias(c) for c in keep if c not in clash], "size", "source_size",
                       "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def brute_targets(sizes_by_source: dict, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> dict:
    """Targets by repeated resharing, as the definition says (for tests)."""
    order = sorted(sizes_by_source, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    excess, free = share * sum(sizes_by_source.values()), set(order)
    while excess > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += excess * weight[s] / total
        excess = 0.0
        for s in list(free):
            if target[s] >= cap * sizes_by_source[s]:
                excess += target[s] - cap * sizes_by_source[s]
                target[s] = float(cap * sizes_by_source[s])
                free.discard(s)
    return target
