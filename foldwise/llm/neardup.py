"""Near-duplicate documents with an LSH forest of MinHash signatures.

A document's set holds its distinct five-word shingles (64-bit hashes).  Equal
sets become one node, so exact copies are neither compared nor multiplied.
Each node has a signature of ``TREES * STEP`` minima.  Tree t of the forest is
the list of all nodes sorted by the minima from position ``t * STEP`` on, at
most ``DEPTH`` of them.  Neighbours in a sorted list have the longest common
prefixes: a node's candidates in a tree are the ``NEAR`` nodes before and
after it that share at least ``STEP`` minima.  In a thin region these are all
nodes of the common prefix; in a dense one the sort makes the depth grow up to
``DEPTH`` minima.  Nodes alike in all of these are ordered by a hash of node and
tree, so that every tree offers others; what no tree offers is left to the
whole check of large regions (below).

With 32 trees and a least depth of 4, two texts of similarity 0.75 share a
prefix in some tree with probability 1 - (1 - 0.75**4)**32 = 0.999995.

The lists are sorted with ``repartitionByRange`` on (tree, minima, hash), so a
region may span tasks, whatever its size; the few rows at the edges of each
task are joined once more (``2 * NEAR`` rows per task, a fixed bound).

Candidates are confirmed on the full sets.  Only components matter: a
candidate within one component cannot change the result.  So the lists are
read twice.  The first reading takes next neighbours and confirms each node's
most frequent one.  The second takes the ``NEAR`` neighbours (in regions of more
than ``NEAR + 1`` nodes the next ones only), on the rows that have any, drops
pairs whose sketches (four bits of every minimum) rule out the
similarity by five standard deviations, and confirms each node's closest pair,
then the pairs that still lie in different components.

A region (the nodes of a tree that share ``STEP`` minima) of more than
``NEAR + 1`` nodes has pairs that no window holds.  Where such a region still
has nodes of different components, all its pairs across components are checked
(``beyond_window``): its nodes are dealt to blocks by a salted hash, each pair
of blocks is one group of bounded size, first on the sketches, then, for the
nodes that have a possible partner, by exact intersections of the full sets.
The nodes of the region's largest component are not compared with each other.
So every pair of a shared prefix is decided, whatever the size of the region;
the work is quadratic in the nodes of a region outside its largest component.

Defined results: texts without words (null, empty, blanks) have no shingle,
are linked with nothing and stay their own component; repeated rows are
copies; a null doc_id counts as a copy, but never names a component unless all
ids of it are null, in which case the component is null and its rows are kept;
an empty table gives no row; other columns than the id and the text are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm import textarrays as ta
from foldwise.llm.components import components
from foldwise.llm.filters import holds, make_filter
from foldwise.llm.frames import annotate, bound_batches, stored

SHINGLE = 5
SIMILARITY = 75               # per cent
TREES, STEP, DEPTH = 32, 4, 8
NEAR = 10
# nodes and shingles of a block of a region, about; a group holds two blocks
BLOCK_NODES, BLOCK_SHINGLES = 2048, 1 << 20
_FACTORS = np.random.default_rng(20240607).integers(1, 1 << 63, TREES * STEP, dtype=np.uint64) * ta.U64(2) + ta.U64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the rows of a slice, ascending per row, and
    their row offsets.  A row of fewer words has its whole sequence as one."""
    starts, ends, offsets = ta.word_spans(data, bounds, ta.NON_SPACE)
    words = ta.span_hashes(data, starts, ends, lower=True)
    inside = np.flatnonzero(ta.within_rows(offsets, size))
    grams = ta.window_hashes(words, size)[inside]
    rows = ta.rows_of(offsets)[inside]
    count = np.diff(offsets)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.array([ta.window_hashes(words[offsets[r]:offsets[r + 1]], int(count[r]))[0] for r in short],
                         dtype=ta.U64)
        with np.errstate(over="ignore"):
            whole += count[short].astype(ta.U64)
        at = np.searchsorted(rows, short)
        grams, rows = np.insert(grams, at, whole), np.insert(rows, at, short)
    edge = np.searchsorted(rows, np.arange(len(bounds)))
    parts = [ta.distinct(grams[a:b]) for a, b in zip(edge[:-1], edge[1:])]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else grams), np.concatenate(([0], np.cumsum(sizes)))


def digests(sets: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128-bit identity of each set; None for an empty one."""
    out = []
    with np.errstate(over="ignore"):
        sums = [np.concatenate((np.zeros(1, ta.U64), np.cumsum(ta.mix(sets ^ ta.U64(salt)), dtype=ta.U64)))
                for salt in (0x8CB92BA72F3D8DD7, 0xAAAAAAAAAAAAAAAB)]
        both = [s[offsets[1:]] - s[offsets[:-1]] for s in sums]
    pair = np.stack(both, axis=1).astype(">u8").tobytes()
    for i, n in enumerate(np.diff(offsets)):
        out.append(pair[16 * i:16 * i + 16] if n else None)
    return out


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint32 minima, one row per non-empty set."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.empty((len(full), len(_FACTORS)), dtype=">u4")
    if len(full):
        at = offsets[full]
        with np.errstate(over="ignore"):
            for k, f in enumerate(_FACTORS):
                out[:, k] = np.minimum.reduceat(sets * f, at) >> ta.U64(32)
    return out


def sketches(minima: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, two to a byte: equal minima agree, others in
    one case of 16, so agreements estimate the similarity."""
    low = (minima.astype(np.uint32) & 15).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal four-bit entries of the sketches in the rows of a and b."""
    differ = a ^ b
    return ((differ & 15) == 0).sum(axis=1) + ((differ >> 4) == 0).sum(axis=1)


def least_agreements(similarity: int) -> int:
    """Agreements that a pair of this similarity falls short of with a chance
    under one in a million (five standard deviations)."""
    n, q = len(_FACTORS), similarity / 100 + (1 - similarity / 100) / 16
    return int(n * q - 5 * (n * q * (1 - q)) ** 0.5)


def _identify(docs: DataFrame, text: str, size: int, keep: list[str], extra: tuple[str, ...], only=None) -> DataFrame:
    """``keep`` with n_shingles, node and, as asked for, sig or shingles.  ``only``
    is a broadcast filter on ``place``: other rows count as empty."""
    fields = [("n_shingles", "bigint"), ("node", "binary")]
    fields += [("sig", "binary"), ("sketch", "binary")] * ("sig" in extra) + [("shingles", "array<bigint>")] * ("shingles" in extra)

    def make():
        def compute(batch):
            texts = batch.column(0)
            if only is not None:
                inside = holds(only.value, batch.column(1).to_numpy().view(np.uint64))
                texts = pc.if_else(pa.array(inside), texts, pa.scalar("", texts.type))
            data, bounds = ta.column_bytes(texts)
            count, node, sig, sketch, lists, at = [], [], [], [], [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
            for lo, hi in ta.slices(bounds):
                sets, offsets = shingle_sets(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], size)
                own = digests(sets, offsets)
                count.append(np.diff(offsets))
                node += own
                if "sig" in extra:
                    minima = signatures(sets, offsets)
                    both = zip(minima, sketches(minima))
                    for d in own:
                        row, short = next(both) if d is not None else (None, None)
                        sig.append(None if row is None else row.tobytes())
                        sketch.append(None if short is None else short.tobytes())
                lists.append(sets.view(np.int64))
                at.append(offsets[1:] + at[-1][-1])
            out = [np.concatenate(count) if count else np.empty(0, np.int64), node]
            if "sig" in extra:
                out += [sig, sketch]
            if "shingles" in extra:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(at).astype(np.int32)),
                                                    pa.array(np.concatenate(lists))))
            return out
        return compute

    inputs = {"text": f"`{text}`"} | ({} if only is None else {"place": "place"})
    return annotate(docs, inputs, fields, make, keep)


ROW = "tree short, minima binary, node binary, n int, root binary, sketch binary"
FOUND = ROW + ", other binary, border boolean, score int"


def _trees(nodes: DataFrame) -> DataFrame:
    """One row per node and tree: the minima from the tree's place on."""
    wide = F.concat("sig", F.substring("sig", 1, 4 * (DEPTH - STEP)))
    return nodes.select("node", F.col("n").cast("int").alias("n"), F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.cast("short").alias("tree"),
                           F.substring(wide, t * (4 * STEP) + 1, F.lit(4 * DEPTH)).alias("minima")))).alias("x")
    ).select("x.tree", "x.minima", "node", "n", F.col("node").alias("root"), F.lit(b"").alias("sketch"))


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    data, _ = ta.column_bytes(column)
    return np.ascontiguousarray(data).reshape(-1, width)


def _scan(rows: DataFrame, near: int, similarity: int) -> DataFrame:
    """Read each task's part of the sorted lists.  Gives the candidate pairs
    (node, other): neighbours at most ``near`` places apart that share a least
    prefix, differ in root, and whose sizes and sketches (if given) allow the
    similarity; their score is the agreement of the sketches.  Rows without
    ``other`` are those with a neighbour of their prefix, and the first and
    last ``near`` rows of the task, marked ``border``."""
    least = least_agreements(similarity)

    def run(batches):
        kept, first = None, True
        names = [f.split()[0] for f in FOUND.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            whole = (pa.concat_tables([kept, new]) if kept is not None else new).combine_chunks()
            old = 0 if kept is None else kept.num_rows
            tree, size = whole.column(0).to_numpy(), whole.column(3).to_numpy().astype(np.int64)
            head = _fixed(whole.column(1), 4 * DEPTH)[:, :4 * STEP].copy().view(np.uint64)
            root = _fixed(whole.column(4), 16).copy().view(np.uint64)
            left, right = [], []
            region = np.zeros(len(tree), dtype=bool)
            for d in range(1, near + 1):
                at = np.arange(max(d, old), len(tree))
                at = at[(tree[at] == tree[at - d]) & (head[at] == head[at - d]).all(axis=1)]
                region[at] = region[at - d] = True
                big, small = np.maximum(size[at], size[at - d]), np.minimum(size[at], size[at - d])
                at = at[(small * 100 >= big * similarity) & (root[at] != root[at - d]).any(axis=1)]
                left.append(at - d)
                right.append(at)
            i, j = np.concatenate(left), np.concatenate(right)
            score = np.zeros(len(i), dtype=np.int32)
            if len(i) and len(whole.column(5)[0].as_py()):
                sketch = _fixed(whole.column(5), len(_FACTORS) // 2)
                score = agreements(sketch[i], sketch[j]).astype(np.int32)
                enough = score >= least
                i, j, score = i[enough], j[enough], score[enough]
            node = whole.column(2).combine_chunks()

            def some(at, other, border, score=None):
                rows_ = whole.take(pa.array(at)).combine_chunks()
                return pa.RecordBatch.from_arrays(
                    [*(rows_.column(k).combine_chunks() for k in range(6)), other, pa.array(np.full(len(at), border)),
                     pa.nulls(len(at), pa.int32()) if score is None else pa.array(score)], names=names)
            yield some(i, node.take(pa.array(j)), False, score)
            # a kept row may come twice, as its neighbours do: distinct rows follow
            yield some(np.flatnonzero(region), pa.nulls(int(region.sum()), pa.binary()), False)
            if first:
                n = min(near, whole.num_rows)
                yield some(np.arange(n), pa.nulls(n, pa.binary()), True)
                first = False
            kept = whole.slice(max(0, whole.num_rows - near))
        if kept is not None:
            whole = kept.combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [*(whole.column(k).combine_chunks() for k in range(6)), pa.nulls(whole.num_rows, pa.binary()),
                 pa.array(np.full(whole.num_rows, True)), pa.nulls(whole.num_rows, pa.int32())], names=names)

    return rows.mapInArrow(run, FOUND)


def candidates(rows: DataFrame, near: int, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, votes, score) with a < b that are neighbours in ``votes``
    sorted lists, and the list rows that have any neighbour."""
    # rows alike in all minima come in another order in every tree
    order = ["tree", "minima", F.xxhash64("node", "tree"), "node"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(_scan(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), near, similarity),
                   "neighbours")
    columns = ["tree", "minima", "node", "n", "root", "sketch"]
    # the rows at the tasks' borders: at most 2 * near per task, so one task takes them
    border = found.where("border").select(*columns).distinct().coalesce(1).sortWithinPartitions(*order)
    across = _scan(border, near, similarity).where("other IS NOT NULL")
    pairs = found.where("other IS NOT NULL").unionByName(across)
    pairs = (pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "tree", "score").distinct()
             .groupBy("a", "b").agg(F.count("*").alias("votes"), F.max("score").alias("score")))
    return pairs, found.where("other IS NULL").select(*columns).distinct()


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    # sizes first: the smaller set bounds the intersection
    joined = pairs.join(one, "a").join(two, "b")
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return joined.select("a", "b", both.alias("both"), F.size("x").alias("nx"), F.size("y").alias("ny")).where(
        F.col("both") * 100 >= (F.col("nx") + F.col("ny") - F.col("both")) * similarity
    ).select(F.col("a").alias("u"), F.col("b").alias("v"))


def region_of(rows: DataFrame):
    """Number of a row's region; a collision only adds pairs to check."""
    return F.xxhash64("tree", F.substring("minima", 1, 4 * STEP))


def large_regions(rows: DataFrame, near: int) -> DataFrame:
    """The regions that have more nodes than a window covers."""
    named = rows.groupBy(region_of(rows).alias("region")).agg(F.count("*").alias("c"))
    return named.where(F.col("c") > near + 1).select("region")


def regions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(region, node, n, root) of those that have more than one component."""
    rooted = rows.select(region_of(rows).alias("region"), "node", "n").join(known, "node", "left").select(
        "region", "node", "n", F.coalesce("root", "node").alias("root"))
    return _open(stored(rooted, "regions"))


def _open(rooted: DataFrame) -> DataFrame:
    """The rows of the regions that have more than one component."""
    apart = rooted.groupBy("region").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    return rooted.join(apart.select("region"), "region", "left_semi")


def _dealt(rooted: DataFrame, block_nodes: int, block_shingles: int) -> DataFrame:
    """The rows of ``regions`` once per pair of blocks (i, j) that they belong
    to, with ``own``, their block.  The largest component has blocks of its
    own, after the others, which are not paired with each other."""
    per_root = rooted.groupBy("region", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    per_region = per_root.groupBy("region").agg(
        F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "s", "root")).alias("main"))

    def blocks(nodes: str, shingles: str):
        return F.expr(f"cast(greatest(ceil(({nodes}) / {block_nodes}), ceil(({shingles}) / {block_shingles})) AS int)")
    per_region = per_region.select(
        "region", F.col("main.root").alias("main"), blocks("c", "s").alias("whole"),
        blocks("c - main.c", "s - main.s").alias("others"), blocks("main.c", "main.s").alias("mains"))
    own = F.expr("""CASE WHEN whole = 1 THEN 0 WHEN root = main THEN others + pmod(xxhash64(node, region), mains)
                    ELSE pmod(xxhash64(node, region), others) END""").cast("int")
    partners = F.expr("""CASE WHEN whole = 1 THEN array(0) WHEN root = main THEN sequence(0, others - 1)
                         ELSE sequence(0, others + mains - 1) END""")
    rows = rooted.join(per_region, "region").withColumns({"own": own, "partner": F.explode(partners)})
    return rows.select("region", F.least("own", "partner").cast("int").alias("i"),
                       F.greatest("own", "partner").cast("int").alias("j"), "own", "node", "n", "root")


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of the two blocks of a group, and the numbers of the roots."""
    own, i, j = (group.column(k).to_numpy() for k in ("own", "i", "j"))
    _, root = np.unique(_fixed(group.column("root"), 16).copy().view("V16").ravel(), return_inverse=True)
    return np.flatnonzero(own == i), np.flatnonzero(own == j), root


def _possible(similarity: int):
    """Of a group, the nodes with a partner of another component that sizes and
    sketches allow."""
    least = least_agreements(similarity)

    def run(group: pa.Table) -> pa.Table:
        left, right, root = _sides(group)
        n = group.column("n").to_numpy().astype(np.int64)
        sketch = _fixed(group.column("sketch"), len(_FACTORS) // 2)
        found = np.zeros(len(n), dtype=bool)
        for at in left.tolist():
            big, small = np.maximum(n[at], n[right]), np.minimum(n[at], n[right])
            to = right[(root[right] != root[at]) & (small * 100 >= big * similarity)]
            to = to[agreements(sketch[to], sketch[at]) >= least]
            found[to] = True
            found[at] |= len(to) > 0
        kept = group.select(["region", "node", "n", "root"])
        return kept.take(pa.array(np.flatnonzero(found)))
    return run


CHUNK_SHINGLES = 8192         # columns of the 0/1 matrix that a product takes at a time


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of ``left`` with those of ``right``."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # a shingle of one set is in no intersection with another
    shared = count > 1
    place = np.cumsum(shared) - 1
    inside = shared[code]
    rows, code = rows[inside], place[code[inside]]
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)   # exact up to 2**24 per product
    total = np.zeros(out.shape, dtype=np.int64)
    for lo in range(0, int(shared.sum()), CHUNK_SHINGLES):
        a, b = np.searchsorted(code, [lo, lo + CHUNK_SHINGLES])
        bits = np.zeros((len(sets), CHUNK_SHINGLES), dtype=np.float32)
        bits[rows[a:b], code[a:b] - lo] = 1
        np.matmul(bits[left], bits[right].T, out=out)
        total += out.astype(np.int64)
    return total


def _linked(similarity: int):
    """Of a group, links (u, v) that join the components of all its pairs whose
    full sets reach the similarity: a forest, so at most one row per node."""
    def run(group: pa.Table) -> pa.Table:
        left, right, root = _sides(group)
        lists = group.column("shingles").combine_chunks()
        bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        n = np.array([len(x) for x in sets], dtype=np.int64)
        both = intersections(sets, left, right)
        union = n[left][:, None] + n[right][None, :] - both
        x, y = np.nonzero((both * 100 >= union * similarity) & (root[left][:, None] != root[right][None, :]))
        top = list(range(root.max() + 1 if len(root) else 0))

        def find(k):
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k
        u, v = [], []
        for a, b in zip(left[x].tolist(), right[y].tolist()):
            p, q = find(int(root[a])), find(int(root[b]))
            if p != q:
                top[p] = q
                u.append(a)
                v.append(b)
        node = group.column("node").combine_chunks()
        return pa.table({"u": node.take(pa.array(u, pa.int64())), "v": node.take(pa.array(v, pa.int64()))})
    return run


def beyond_window(rooted: DataFrame, nodes: DataFrame, sets_of, similarity: int,
                  block_nodes: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (u, v) between the components of the ``regions``, from all pairs."""
    dealt = _dealt(rooted, block_nodes, 1 << 60).join(nodes.select("node", "sketch"), "node")
    some = stored(dealt.groupBy("region", "i", "j").applyInArrow(
        _possible(similarity), "region bigint, node binary, n int, root binary").distinct(), "possible")
    some = stored(_dealt(some, block_nodes, block_shingles), "blocks")
    return some.join(sets_of(some.select("node").distinct()), "node").groupBy("region", "i", "j").applyInArrow(
        _linked(similarity), "u binary, v binary")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    similarity: int = SIMILARITY, near: int = NEAR) -> DataFrame:
    """(doc, h, n_shingles, component, kept) per row of ``docs``; h is the hash
    of the text, by which the result joins back to the texts."""
    bound_batches(docs.sparkSession)
    keyed = docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    keyed = keyed.withColumn("place", F.xxhash64("doc", "h"))
    rows = stored(_identify(keyed, "text", size, ["doc", "h", "place"], ("sig",)), "signatures")
    nodes = stored(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc").alias("least"), F.min("place").alias("place"), F.max("n_shingles").alias("n"),
        F.min("sig").alias("sig"), F.min("sketch").alias("sketch")), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The full sets of the nodes, made from one row of each where it lies:
        no text is shuffled, nor do copies of a text meet."""
        places = make_filter(nodes.join(wanted, "node").select("place"), "place")
        own = _identify(keyed, "text", size, [], ("shingles",), docs.sparkSession.sparkContext.broadcast(places))
        return stored(own.where("node IS NOT NULL").join(wanted, "node", "left_semi").groupBy("node").agg(
            F.first("shingles").alias("shingles")), "sets")

    def best_of(pairs: DataFrame, by: str) -> DataFrame:
        """Each node's pair with the most of ``by``."""
        ends = pairs.select(F.explode(F.array(*[
            F.struct(F.col(n).alias("n"), F.col(by).alias("by"), F.col("a"), F.col("b")) for n in ("a", "b")])).alias("x"))
        return stored(ends.select("x.*").groupBy("n").agg(F.max(F.struct("by", "a", "b")).alias("x")).select(
            "x.a", "x.b").distinct(), "best")

    def apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """The pairs with the roots of their nodes, where these differ."""
        ends = [known.select(F.col("node").alias(n), F.col("root").alias(f"r{n}")) for n in ("a", "b")]
        joined = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
        return joined.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb")

    def confirmed(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return confirm(pairs, sets_of(ends), similarity)

    def merged(known: DataFrame, links: DataFrame) -> DataFrame:
        """The roots after these links, which join whole components."""
        links = stored(links.select(F.col("u").alias("a"), F.col("v").alias("b")), "links")
        tops = stored(components(apart(links, known).select(F.col("ra").alias("u"), F.col("rb").alias("v"))), "components")
        up = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
        old = known.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        return stored(old.unionByName(tops.join(known, "node", "left_anti").select("node", "root")), "components")

    # first reading: each node's most frequent next neighbour
    pairs, region = candidates(_trees(nodes), 1, similarity)
    region = stored(region, "region")
    best = best_of(pairs, "votes")
    none = rows.where("false").select("node", F.col("node").alias("root"))
    known = merged(none, confirmed(best))
    # second reading: near neighbours that lie in different components; each
    # node's closest first, so that few remain for the last confirmation.  In
    # large regions only next neighbours: all their pairs are checked below
    rooted = region.drop("root", "sketch").join(nodes.select("node", "sketch"), "node").join(known, "node", "left").select(
        "tree", "minima", "node", "n", F.coalesce("root", "node").alias("root"), "sketch")
    rooted = stored(rooted.withColumn("region", region_of(rooted)), "rooted")
    large = stored(large_regions(rooted, near), "large")
    dense = rooted.join(large, "region", "left_semi").drop("region")
    thin = rooted.join(large, "region", "left_anti").drop("region")
    pairs = candidates(thin, near, similarity)[0].unionByName(candidates(dense, 1, similarity)[0])
    pairs = pairs.groupBy("a", "b").agg(F.max("score").alias("score"))
    pairs = stored(pairs.join(best, ["a", "b"], "left_anti"), "pairs")
    best = best_of(pairs, "score")
    known = merged(known, confirmed(best))
    rest = stored(apart(pairs.join(best, ["a", "b"], "left_anti"), known).select("a", "b"), "pairs")
    known = merged(known, confirmed(rest))
    # the pairs of large regions that no window held
    rooted = stored(regions(dense, known), "regions")
    if not rooted.isEmpty():
        known = merged(known, beyond_window(rooted, nodes, sets_of, similarity))
    # the smallest document of a component, over all copies of its nodes
    named = nodes.select("node", "least").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    labels = named.join(smallest, "root").select("node", "component")
    out = rows.join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component"))
    return out.select("doc", "h", "n_shingles", component.alias("component"),
                      (F.col("doc").eqNullSafe(component)).alias("kept"))


def brute_force(docs: list[tuple[int, str | None]], size: int = SHINGLE, similarity: int = SIMILARITY) -> dict[int, tuple]:
    """doc_id -> (n_shingles, component, kept) by definition (for tests)."""
    sets, where = [], {}
    for _, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for i, s in enumerate(sets):
        shared: dict[int, int] = {}
        for g in s:
            for j in where[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if 100 * both >= similarity * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs)}
