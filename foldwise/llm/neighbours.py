"""Approximate nearest neighbours by learned partitions.

1. Sample: the ``SAMPLE_ROWS`` rows with the smallest hashes (all, if fewer);
   equal vectors of the sample count once.  One task fits on it: the exact
   ``GRAPH`` nearest neighbours of its training part make a graph, which is cut
   into balanced partitions (median splits along the main direction, then sweeps
   that move a vertex to the partition of most of its neighbours while that one
   has room).  A softmax regression learns, for each vertex, the shares of its
   neighbourhood in the partitions.  On the held-out fifth of the sample the
   probability mass is measured that must be visited so that ``TARGET`` of the
   true neighbours lie in visited partitions.
2. Index: every row, in or out of the sample, lies in its most probable
   partition; large partitions are dealt to blocks of about ``BLOCK`` rows.
3. Search: a query visits its most probable partitions until their mass reaches
   the measured one (and until they hold ``k`` rows besides its own).  Blocks of
   queries meet blocks of rows in one group each, which reranks by the exact
   cosine and gives the ``k`` best per query; a window picks the best of these.

Partitions number a power of two, at most ``PARTITIONS`` and about one per
``PER_PARTITION`` sample rows.  So the work is the visited share of all
query-row pairs: small where vectors cluster, over half of them where they lie
in all directions alike, since then no partition rules out another.

Cosines are in double precision on the given components (scaled by a power of
two against overflow, which changes no bit of the result), summed in the order
of numpy's row sum, so equal vectors get equal scores wherever they lie.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do vectors whose length is not the most frequent
one (ties: the smaller); a row is found by others whatever its id, null ids
sort last among ties; repeated rows are rows of their own (as queries and as
neighbours); an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.frames import bound_batches, stored

K = 5
SAMPLE_ROWS = 10_240
PARTITIONS, PER_PARTITION = 64, 128
GRAPH = 10
TARGET = 0.97
BLOCK = 2048
SWEEPS, ROOM, EPOCHS, RATE = 12, 1.1, 40, 0.02
NEAR_TIE = 1e-9


# --------------------------------------------------------------------- fit
def exact(queries: np.ndarray, rows: np.ndarray, k: int, same: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the k rows nearest to each unit vector; ``same`` is a query's own row."""
    out = np.empty((len(queries), min(k, len(rows) - (same is not None))), dtype=np.int64)
    for a in range(0, len(queries), 1024):
        near = queries[a:a + 1024] @ rows.T
        if same is not None:
            near[np.arange(len(near)), same[a:a + 1024]] = -np.inf
        out[a:a + 1024] = np.argsort(-near, axis=1, kind="stable")[:, :out.shape[1]]
    return out


def balanced_partition(rows: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each vertex; each holds at most ``ROOM`` times its share."""
    n = len(rows)
    groups = [np.arange(n)]
    while len(groups) < parts:
        halves = []
        for own in groups:
            centred = rows[own] - rows[own].mean(axis=0)
            main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = own[np.argsort(centred @ main, kind="stable")]
            halves += [order[:len(order) // 2], order[len(order) // 2:]]
        groups = halves
    label = np.empty(n, dtype=np.int64)
    for p, own in enumerate(groups):
        label[own] = p
    room = int(np.ceil(n / parts * ROOM))
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(SWEEPS):
        ties = np.zeros((n, parts))
        np.add.at(ties, (source, label[target]), 1)
        np.add.at(ties, (target, label[source]), 1)
        size = np.bincount(label, minlength=parts)
        gain = ties.max(axis=1) - ties[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[:int((gain > 0).sum())].tolist():
            to = int(ties[i].argmax())
            if size[to] < room:
                size[label[i]] -= 1
                size[to] += 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


def probabilities(unit: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = unit @ weights + bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_router(rows: np.ndarray, shares: np.ndarray, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on shares (Adam, decaying rate)."""
    rng = np.random.default_rng(seed)
    theta = np.zeros((rows.shape[1] + 1, shares.shape[1]))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    x = np.hstack([rows, np.ones((len(rows), 1))])
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 1024):
            own = order[at:at + 1024]
            miss = (probabilities(x[own], theta, 0.0) - shares[own]) / len(own)
            slope = x[own].T @ miss
            step += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope * slope
            theta -= RATE * (1 - epoch / EPOCHS) * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], theta[-1]


def before(prob: np.ndarray) -> np.ndarray:
    """For each partition, the mass of the more probable ones."""
    order = np.argsort(-prob, axis=1, kind="stable")
    ordered = np.take_along_axis(prob, order, 1)
    mass = np.cumsum(ordered, axis=1) - ordered
    out = np.empty_like(mass)
    np.put_along_axis(out, order, mass, 1)
    return out


def fit(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, bias, mass to visit) from the unit vectors of the sample."""
    unit = np.unique(unit, axis=0)
    dims = unit.shape[1] if unit.ndim == 2 else 0
    unit = unit[np.random.default_rng(42).permutation(len(unit))]
    held, train = unit[::5], unit[np.arange(len(unit)) % 5 != 0]
    parts = min(PARTITIONS, 1 << max(0, (len(train) // PER_PARTITION).bit_length() - 1))
    if len(train) <= GRAPH or parts == 1:
        return np.zeros((dims, 1)), np.zeros(1), 1.0
    graph = exact(train, train, GRAPH, np.arange(len(train)))
    label = balanced_partition(train, graph, parts)
    shares = np.zeros((len(train), parts))
    np.add.at(shares, (np.repeat(np.arange(len(train)), GRAPH), label[graph.ravel()]), 1)
    shares[np.arange(len(train)), label] += 2
    shares /= shares.sum(axis=1, keepdims=True)
    weights, bias = fit_router(train, shares)
    place = probabilities(train, weights, bias).argmax(axis=1)
    mass = before(probabilities(held, weights, bias))
    needed = np.take_along_axis(mass, place[exact(held, train, K)], 1).ravel()
    return weights, bias, float(np.quantile(needed, TARGET, method="higher")) + 1e-9


def _fit(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """One task fits on the sample; the driver gets the model alone, at most
    PARTITIONS * (dimensions + 1) numbers."""
    def run(batches):
        rows = [_matrix(b.column(0)) for b in batches if b.num_rows]
        if rows:
            weights, bias, mass = fit(_unit(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([pa.array([weights.ravel().tolist()]), pa.array([bias.tolist()]), pa.array([mass])],
                                             names=["weights", "bias", "mass"])
    found = sample.coalesce(1).mapInArrow(run, "weights array<double>, bias array<double>, mass double").first()
    bias = np.array(found["bias"])
    return np.array(found["weights"]).reshape(-1, len(bias)), bias, found["mass"]


# ------------------------------------------------------------------- index
def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, vec_id, vector array<double>) of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    fine = (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & F.exists(x, lambda v: v != 0)
    d = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("vec_id"), x.alias("vector"))
    d = d.where(F.col("vector").isNotNull() & F.coalesce(fine, F.lit(False)))
    size = d.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    d = d.where(F.size("vector") == (size["n"] if size else 0))
    # a power of two: no bit of a mantissa changes
    scale = F.pow(F.lit(2.0), -F.floor(F.log2(F.array_max(F.transform("vector", F.abs)))))
    return d.withColumn("vector", F.transform("vector", lambda v: v * scale))


def _placed(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """``rows`` with their most probable partition."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                place = probabilities(_unit(_matrix(batch.column(2))), weights, bias).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int32))],
                                                 names=["row", "vec_id", "vector", "part"])
    return rows.mapInArrow(run, "row bigint, vec_id bigint, vector array<double>, part int")


def _routed(queries: DataFrame, weights: np.ndarray, bias: np.ndarray, mass: float, counts: np.ndarray, k: int) -> DataFrame:
    """One row per query and partition that it visits."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            prob = probabilities(_unit(_matrix(batch.column(2))), weights, bias)
            order = np.argsort(-prob, axis=1, kind="stable")
            held = np.empty(order.shape, dtype=np.int64)
            np.put_along_axis(held, order, np.cumsum(counts[order], axis=1) - counts[order], 1)
            at, part = np.nonzero(((before(prob) <= mass) | (held <= k)) & (counts > 0))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(part.astype(np.int32))],
                                             names=["row", "vec_id", "vector", "part"])
    return queries.mapInArrow(run, "row bigint, vec_id bigint, vector array<double>, part int")


FOUND = "query bigint, query_id bigint, row bigint, vec_id bigint, score double"


def _rerank(k: int):
    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        row, ids = group.column("row").to_numpy(), group.column("vec_id").combine_chunks()
        x = _matrix(group.column("vector").combine_chunks())
        norm = np.sqrt((x * x).sum(axis=1))
        here, there = np.flatnonzero(asks), np.flatnonzero(~asks)
        null = np.asarray(ids.is_null())[there]
        order_id = np.where(null, np.iinfo(np.int64).max, ids.fill_null(0).to_numpy()[there])
        found = [], [], []
        if len(there):
            unit = x[there] / norm[there, None]
            for at in range(0, len(here), 256):
                own = here[at:at + 256]
                near = (x[own] / norm[own, None]) @ unit.T
                near[row[own][:, None] == row[there][None, :]] = -np.inf
                least = near.min(axis=1) if near.shape[1] <= k else -np.partition(-near, k - 1, axis=1)[:, k - 1]
                for i, q in enumerate(own.tolist()):
                    some = np.flatnonzero((near[i] >= least[i] - NEAR_TIE) & (near[i] > -np.inf))
                    both = there[some]
                    score = (x[both] * x[q]).sum(axis=1) / (norm[both] * norm[q])
                    best = np.lexsort((row[both], order_id[some], null[some], -score))[:k]
                    found[0].append(np.full(len(best), q))
                    found[1].append(both[best])
                    found[2].append(score[best])
        q, r, score = (np.concatenate(f) if f else np.empty(0) for f in found)
        q, r = pa.array(q.astype(np.int64)), pa.array(r.astype(np.int64))
        rows = pa.array(row)
        return pa.table({"query": rows.take(q), "query_id": ids.take(q), "row": rows.take(r), "vec_id": ids.take(r),
                         "score": pa.array(score.astype(float))})
    return run


def search(rows: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows where ``is_query`` (a condition
    on ``vec_id``) holds, the k nearest other rows found."""
    spark = rows.sparkSession
    bound_batches(spark)
    given = stored(valid(rows, key, vector), "vectors")
    result = "query_id bigint, rank int, vec_id bigint, score double"
    n = given.count()
    if not n:
        return spark.createDataFrame([], result)
    # a thin slice of the hashes first, so that no task sorts more than a few times the sample
    h = F.xxhash64("vec_id", "vector")
    few = given.select("vector", h.alias("h")).where(F.pmod("h", F.lit(1 << 20)) < max(1, -(-(2 << 20) * SAMPLE_ROWS // n)))
    weights, bias, mass = _fit(few.orderBy("h").limit(SAMPLE_ROWS).select("vector"))
    index = stored(_placed(given, weights, bias), "index")
    counts = np.zeros(len(bias), dtype=np.int64)
    for part, c in index.groupBy("part").count().collect():      # PARTITIONS rows at most
        counts[part] = c
    blocks = [max(1, -(-int(c) // BLOCK)) for c in counts]
    queries = stored(index.where(is_query).drop("part"), "queries")
    chunks = max(1, -(-queries.count() // BLOCK))
    dealt = F.xxhash64("row", F.lit(7))
    of = F.array(*[F.lit(b) for b in blocks])[F.col("part")]
    asked = _routed(queries, weights, bias, mass, counts, k).select(
        "row", "vec_id", "vector", "part", F.explode(F.sequence(F.lit(0), of - 1)).alias("block"),
        F.pmod(dealt, F.lit(chunks)).cast("int").alias("chunk"), F.lit(True).alias("asks"))
    told = index.select(
        "row", "vec_id", "vector", "part", F.pmod(dealt, of).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(False).alias("asks"))
    near = asked.unionByName(told).groupBy("part", "block", "chunk").applyInArrow(_rerank(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: list[tuple], k: int = K, every: int = 50) -> list[tuple]:
    """(query_id, rank, vec_id, score) by definition over (vec_id, vector) rows (for tests)."""
    good = [(i, v, np.array(x, dtype=float)) for i, (v, x) in enumerate(rows)
            if x and None not in x and np.isfinite(np.array(x, dtype=float)).all() and any(x)]
    out = []
    for i, v, x in good:
        if v is None or v % every:
            continue
        near = [(-(x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())), w is None, w, j) for j, w, y in good if j != i]
        out += [(v, r + 1, w, -s) for r, (s, _, w, _) in enumerate(sorted(near)[:k])]
    return out
