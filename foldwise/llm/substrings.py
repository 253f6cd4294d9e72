"""Removal of repeated substrings by bucket-pointer refinement.

A byte is removed if it lies in a ``width``-byte string that also starts
anywhere else.  Work is divided by content, so that equal strings meet:

1. Every window of ``width`` bytes chooses an anchor: the leftmost smallest
   hash among its ``GRAM``-byte strings.  Equal windows choose the same anchor
   at the same place.  The windows of one anchor are consecutive and form a
   segment; an anchor's bucket is the hash of its gram.  There are about
   2 / (width - GRAM) segments per byte.
2. Buckets are counted.  A segment whose bucket holds no other segment has no
   repeated window; equal segments repeat with all their windows.  Neither
   needs its text again.
3. What is left, one of each kind of segment in buckets of several kinds, is
   sent to its bucket with its text and refined there: positions start in
   buckets of equal ``START``-byte grams and each round sorts the positions of
   a bucket by the bucket identifiers at a later offset, doubling the depth
   and reusing the updated pointers, until ``width`` is reached.  Positions
   alone in their bucket are finished and are not sorted again.
4. A bucket of more than ``HOT_KINDS`` kinds (a passage in very many different
   contexts) is not gathered: its windows are refined to full depth at once
   by counting their 128-bit identities, which Spark aggregates map-side.

Removal is decided on the input; the ranges of each text are merged at last
and cut from its bytes.  Only segments and ranges are shuffled, and the texts
twice by their own row key.

Defined results: null and empty texts have no bytes and nothing is removed;
repeated rows (same doc_id, same text) are copies of each other; a null doc_id
is a value like others; texts shorter than ``width`` are never cut; an empty
table gives no row; columns that clash with result names are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm import textarrays as ta
from foldwise.llm.frames import annotate, bound_batches, stored

WIDTH = 400
GRAM = 64
START = 50
HOT_KINDS = 8_000
SHARD_BYTES = 3 << 20


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, dtype=ta.U64)
    power, inverse = ta._powers()
    sums = np.empty(len(data) + 1, dtype=ta.U64)
    out = np.empty(n, dtype=ta.U64)
    with np.errstate(over="ignore"):
        for at in range(0, n, ta.BLOCK - size):
            stop = min(n, at + ta.BLOCK - size)
            block = ta.CODES[data[at:stop + size - 1]]
            block *= power[:len(block)]
            part = sums[:len(block) + 1]
            part[0] = 0
            np.cumsum(block, out=part[1:])
            np.subtract(part[size:], part[:-size], out=out[at:stop])
            out[at:stop] *= inverse[:stop - at]
    return ta.mix(out)


def sliding_argmin(keys: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost smallest of each ``span`` consecutive keys
    (compared by their upper bits; ties go left)."""
    n = len(keys) - span + 1
    bits = max(1, int(len(keys)).bit_length())
    low = ta.U64((1 << bits) - 1)
    packed = (keys & ~low) | np.arange(len(keys), dtype=ta.U64)
    pad = -len(packed) % span
    grid = np.concatenate((packed, np.full(pad, ~ta.U64(0)))).reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[span - 1:span - 1 + n]) & low).astype(np.int64)


def segments(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor, bucket, kind) of each segment;
    positions count from the start of ``data``."""
    empty = tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, ta.U64),) * 2
    if len(data) < width:
        return empty
    grams = gram_hashes(data, GRAM)
    anchor = sliding_argmin(grams, width - GRAM + 1)
    room = np.repeat(bounds[1:], np.diff(bounds))[:len(anchor)] - np.arange(len(anchor))
    start = np.flatnonzero(room >= width)
    if not len(start):
        return empty
    anchor = anchor[start]
    new = np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(start) != 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(start)])) - 1
    p0, p1, a = start[first], start[last], anchor[first]
    row = np.searchsorted(bounds, p0, "right") - 1
    whole = np.empty(len(p0), dtype=ta.U64)
    # segment ends ascend like their starts
    whole[:] = ta.span_hashes(data, p0, p1 + width)
    with np.errstate(over="ignore"):
        kind = ta.mix(whole + (a - p0).astype(ta.U64) * ta.U64(0x9E3779B97F4A7C15)
                      + (p1 - p0).astype(ta.U64) * ta.U64(0xC2B2AE3D27D4EB4F))
    return row, p0, p1, a, grams[a], kind


def _pieces(data: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset in that row, bytes, bounds) of bounded size; a longer
    row comes in pieces that overlap by width - 1 bytes, so no window is lost
    or seen twice."""
    for lo, hi in ta.slices(bounds):
        part, own = data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo]
        if len(part) <= 2 * ta.SLICE_BYTES:
            yield lo, 0, part, own
            continue
        for row in range(lo, hi):
            text = part[own[row - lo]:own[row - lo + 1]]
            for at in range(0, max(1, len(text) - width + 1), ta.SLICE_BYTES):
                piece = text[at:at + ta.SLICE_BYTES + width - 1]
                yield row, at, piece, np.array([0, len(piece)])


def refine(text: np.ndarray, seg_start: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Mask over the windows of a shard: true if the window's bytes occur at
    another window of the shard.

    ``text`` is the concatenation of the segments' bytes, ``seg_start`` their
    starts, ``windows`` their numbers of window starts (segment i has
    windows[i] + width - 1 bytes).
    """
    n = len(text)
    size = windows + width - 1
    room = np.repeat(seg_start + size, size) - np.arange(n)
    is_window = np.zeros(n, dtype=bool)
    at = np.repeat(seg_start - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(int(windows.sum()))
    is_window[at] = True
    # initial buckets: pointer = place of the bucket's first member in sorted order
    grams = gram_hashes(text, START)
    bucket = np.full(n, -1, dtype=np.int64)
    valid = np.flatnonzero(room[:len(grams)] >= START)
    order = valid[np.argsort(grams[valid])]
    edge = np.concatenate(([True], np.diff(grams[order]) != 0)) if len(order) else np.zeros(0, bool)
    place = np.flatnonzero(edge)
    bucket[order] = np.repeat(place, np.diff(np.concatenate((place, [len(order)]))))
    depth = START
    while True:
        step = min(depth, width - depth)
        target = depth + step
        count = np.bincount(bucket[bucket >= 0], minlength=n + 1)
        wanted = is_window if target == width else room >= target
        active = np.flatnonzero(wanted & (bucket >= 0))
        active = active[count[bucket[active]] > 1]
        key = bucket[active] * (n + 1) + bucket[active + step]
        order = np.argsort(key)
        key, active = key[order], active[order]
        edge = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(edge)
        members = np.diff(np.concatenate((first, [len(key)])))
        if target == width:
            mask = np.zeros(n, dtype=bool)
            mask[active] = np.repeat(members > 1, members)
            return mask[at]
        # update the pointers: the sub-bucket's place within its bucket
        old = bucket[active]
        outer = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1]))) if len(old) else first
        base = np.repeat(outer, np.diff(np.concatenate((outer, [len(old)]))))
        bucket[active] = old + np.repeat(first, members) - base
        bucket[room < target] = -1
        depth = target


def _ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, end = ta.runs(mask)
    return first, end - 1


SEGMENT = "doc bigint, h bigint, p0 bigint, n int, off int, bucket bigint, kind bigint"
PIECE = "doc bigint, h bigint, p0 bigint, n int, off int, bucket bigint, kind bigint, hot boolean, bytes binary"
RANGE = "doc bigint, h bigint, first bigint, last bigint"


def _find_segments(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, bounds = ta.column_bytes(batch.column(2))
            for lo, at, part, own in _pieces(data, bounds, width):
                row, p0, p1, a, bucket, kind = segments(part, own, width)
                if len(row):
                    rows = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows),
                         pa.array(p0 - own[row] + at), pa.array((p1 - p0 + 1).astype(np.int32)),
                         pa.array((a - p0).astype(np.int32)), pa.array(bucket.view(np.int64)),
                         pa.array(kind.view(np.int64))],
                        names=["doc", "h", "p0", "n", "off", "bucket", "kind"])
    return docs.mapInArrow(run, SEGMENT)


def _cut_pieces(rows: DataFrame, width: int) -> DataFrame:
    """One row per wanted segment with its bytes, from texts with wanted lists."""
    def run(batches):
        for batch in batches:
            data, bounds = ta.column_bytes(batch.column(2))
            out = {k: [] for k in ("doc", "h", "p0", "n", "off", "bucket", "kind", "hot", "bytes")}
            held = 0
            for i, wanted in enumerate(batch.column(3).to_pylist()):
                doc, h = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for s in wanted:
                    at = int(bounds[i]) + s["p0"]
                    piece = data[at:at + s["n"] + width - 1].tobytes()
                    for k, v in (("doc", doc), ("h", h), ("bytes", piece),
                                 *((k, s[k]) for k in ("p0", "n", "off", "bucket", "kind", "hot"))):
                        out[k].append(v)
                    held += len(piece)
                    if held > SHARD_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))
                        out, held = {k: [] for k in out}, 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return rows.mapInArrow(run, PIECE)


def _shards(batches) -> Iterator[pa.Table]:
    """Whole buckets in tables of about SHARD_BYTES; input sorted by bucket."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(8).nbytes
        if size > SHARD_BYTES:
            whole = pa.Table.from_batches(held)
            bucket = whole.column(5).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1], "left"))
            if cut:
                yield whole.slice(0, cut)
                whole = whole.slice(cut)
            held, size = whole.combine_chunks().to_batches(), whole.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _refine_buckets(pieces: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for shard in _shards(batches):
            data, bounds = ta.column_bytes(shard.column(8))
            windows = shard.column(3).to_numpy().astype(np.int64)
            hit = refine(data, bounds[:-1], windows, width)
            first, end = ta.runs(hit)
            if not len(first):
                continue
            edge = np.concatenate(([0], np.cumsum(windows)))
            # runs may pass from one segment to the next: cut them there
            a = np.searchsorted(edge, first, "right") - 1
            b = np.searchsorted(edge, end - 1, "right") - 1
            which = np.repeat(a, b - a + 1) + _count_up(b - a + 1)
            lo = np.maximum(np.repeat(first, b - a + 1), edge[which]) - edge[which]
            hi = np.minimum(np.repeat(end, b - a + 1), edge[which + 1]) - edge[which] - 1
            rows = pa.array(which)
            p0 = shard.column(2).to_numpy()[which]
            yield pa.RecordBatch.from_arrays(
                [shard.column(0).combine_chunks().take(rows), shard.column(1).combine_chunks().take(rows),
                 pa.array(p0 + lo), pa.array(p0 + hi)], names=["doc", "h", "first", "last"])
    return pieces.mapInArrow(run, RANGE)


def _count_up(sizes: np.ndarray) -> np.ndarray:
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)


def _hot_windows(pieces: DataFrame, width: int) -> DataFrame:
    """Ranges of repeated windows of hot buckets, by counted identities."""
    def run(batches):
        for batch in batches:
            data, bounds = ta.column_bytes(batch.column(8))
            windows = batch.column(3).to_numpy().astype(np.int64)
            which = np.repeat(np.arange(len(windows)), windows)
            at = _count_up(windows)
            start = bounds[:-1][which] + at
            one = gram_hashes(data, width)[start]
            half = gram_hashes(data, width // 2)
            with np.errstate(over="ignore"):
                two = ta.mix(half[start] * ta.U64(0x9FB21C651E98DF25) + half[start + width - width // 2])
            rows = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows),
                 pa.array(batch.column(2).to_numpy()[which] + at),
                 pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["doc", "h", "p", "w1", "w2"])

    rows = pieces.mapInArrow(run, "doc bigint, h bigint, p bigint, w1 bigint, w2 bigint")
    often = rows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    return rows.join(often, ["w1", "w2"], "left_semi").select(
        "doc", "h", F.col("p").alias("first"), F.col("p").alias("last"))


def repeated_ranges(docs: DataFrame, width: int = WIDTH, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, h, ranges): ranges of window starts whose ``width`` bytes occur
    elsewhere, per distinct (doc_id, text hash); texts without any are absent."""
    bound_batches(docs.sparkSession)
    keyed = docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    found = stored(_find_segments(keyed, width), "segments")
    kinds = stored(found.groupBy("bucket", "kind").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc", "h", "p0", "n", "off")).alias("one")), "kinds")
    buckets = kinds.groupBy("bucket").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(buckets, "bucket").select(
        "one.*", "bucket", "kind", (F.col("kinds") > HOT_KINDS).alias("hot"))
    lists = wanted.groupBy("doc", "h").agg(
        F.collect_list(F.struct("p0", "n", "off", "bucket", "kind", "hot")).alias("wanted"))
    one_text = keyed.join(lists, keyed.doc.eqNullSafe(lists.doc) & (keyed.h == lists.h)).select(
        keyed.doc, keyed.h, "text", "wanted")
    # copies of a row bring the same segment twice: one of each kind is enough,
    # and a second would be taken for a repetition
    pieces = stored(_cut_pieces(one_text, width).dropDuplicates(["bucket", "kind"]), "pieces")
    ranges = _refine_buckets(
        pieces.where("NOT hot").repartition("bucket").sortWithinPartitions("bucket"), width)
    if not pieces.where("hot").isEmpty():
        ranges = ranges.unionByName(_hot_windows(pieces.where("hot"), width))
    copied = found.join(kinds.where("copies > 1").select("bucket", "kind"), ["bucket", "kind"], "left_semi").select(
        "doc", "h", F.col("p0").alias("first"), (F.col("p0") + F.col("n") - 1).alias("last"))
    return ranges.unionByName(copied).groupBy("doc", "h").agg(
        F.collect_list(F.struct("first", "last")).alias("ranges"))


def cut(docs: DataFrame, width: int = WIDTH, doc: str = "doc_id", text: str = "text",
        keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with n_bytes, removed (byte spans),
    kept_sha256 and, if asked for, kept_bytes (what is left, as binary)."""
    ranges = repeated_ranges(docs, width, doc, text)
    rows = docs.withColumns({"_doc": F.col(doc).cast("long"), "_h": F.xxhash64(text)})
    joined = rows.join(ranges, rows["_doc"].eqNullSafe(ranges["doc"]) & (rows["_h"] == ranges["h"]), "left")
    joined = joined.select(*[rows[c] for c in docs.columns], F.col("ranges").alias("_ranges"))
    fields = [("n_bytes", "bigint"), ("removed", "array<struct<start:bigint,end:bigint>>"), ("kept_sha256", "string")]
    if with_text:
        fields.append(("kept_bytes", "binary"))

    def make():
        def compute(batch):
            data, bounds = ta.column_bytes(batch.column(0))
            out = [np.diff(bounds), [], [], []]
            for i, own in enumerate(batch.column(1).to_pylist()):
                raw = data[bounds[i]:bounds[i + 1]]
                spans, rest = [], raw
                if own:
                    starts = np.array([r["first"] for r in own])
                    ends = np.array([r["last"] for r in own]) + width
                    mask = ta.cover(len(raw), starts, ends)
                    a, b = ta.runs(mask)
                    spans = [{"start": int(x), "end": int(y)} for x, y in zip(a, b)]
                    rest = raw[~mask]
                rest = rest.tobytes()
                out[1].append(spans)
                out[2].append(hashlib.sha256(rest).hexdigest())
                out[3].append(rest)
            return out[:len(fields)]
        return compute

    kept = [c for c in (docs.columns if keep is None else keep)]
    return annotate(joined, {"text": f"`{text}`", "ranges": "_ranges"}, fields, make, kept)


def brute_force(texts: list[str | None], width: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by definition (for tests)."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in raw:
        for i in range(len(b) - width + 1):
            seen[b[i:i + width]] = seen.get(b[i:i + width], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans,
                    hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out
