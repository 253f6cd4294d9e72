"""Benchmark decontamination with one FM-index per training shard.

A shard is one bounded Arrow batch of documents.  The words of the shard that
may lie in a benchmark phrase (runs of word triples that occur in the
benchmark; a necessary condition, so nothing is lost) form its text; a suffix
array over the word numbers gives the Burrows-Wheeler transform, stored as a
levelwise wavelet tree.  Phrases are found by backward search through ranks,
their occurrences by walking to sampled suffix positions, and the occurrences
are merged into spans.

The pass is row-wise: no shuffle of documents, nothing gathered.  The phrases
are the stated query set.  A Spark job cuts long items into pieces that overlap
by all but one word of a phrase and writes the pieces as blocks of about
``BLOCK_WINDOWS`` phrases to the shared folder; the driver knows their number
alone.  A task loads one block; each further block is one more row-wise pass
over the written result of the one before, which extends its spans and items.

Defined results: null or empty texts have no words and no hits; benchmark rows
without words have no phrase; a null item_id is never listed among the items,
but its phrases are hit; repeated documents or items are handled row by row;
columns of the documents that clash with result names are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm import textarrays as ta
from foldwise.llm.frames import annotate, bound_batches, remote_fs, shared_path, stored

WINDOW = 13
BLOCK_WINDOWS = 200_000        # phrases of a block, about (25 MB in a task)
SAMPLE_RATE = 8                # every 8th text position is a sampled suffix
GRAM_BITS = 22


class WaveletTree:
    """Levelwise wavelet tree (bits of a level are stably split by value)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.zeros, self.split = [], []
        row = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            self.zeros.append(np.concatenate(([0], np.cumsum(~bit, dtype=np.int64))))
            self.split.append(int(self.zeros[-1][-1]))
            row = np.concatenate((row[~bit], row[bit]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``upto`` (vectorised)."""
        low, high = np.zeros_like(upto), upto
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            zeros, split = self.zeros[k], self.split[k]
            one = symbol >> level & 1 == 1
            z_low, z_high = zeros[low], zeros[high]
            low = np.where(one, split + low - z_low, z_low)
            high = np.where(one, split + high - z_high, z_high)
        return high - low


def suffix_array(symbols: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each separator is a symbol of its own."""
    n, n_sep = len(symbols), int(separator.sum())
    rank = np.where(separator, np.cumsum(separator) - 1, symbols.astype(np.int64) + n_sep)
    width = 1
    while True:
        later = np.full(n, -1, dtype=np.int64)
        later[:n - width] = rank[width:]
        key = rank * (int(rank.max()) + 2) + later + 1
        order = np.argsort(key, kind="stable")
        step = np.empty(n, dtype=np.int64)
        step[0] = 0
        step[1:] = np.diff(key[order]) != 0
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        width *= 2
        if int(rank.max()) == n - 1 or width >= n:
            return order


class FMIndex:
    """FM-index of word-number segments (numbers >= 1), each followed by a separator 0."""

    def __init__(self, symbols: np.ndarray, sigma: int, rate: int = SAMPLE_RATE):
        separator = symbols == 0
        order = suffix_array(symbols, separator)
        bwt = symbols[order - 1]
        self.n = len(symbols)
        self.bwt = bwt
        self.tree = WaveletTree(bwt, sigma)
        counts = np.bincount(symbols, minlength=sigma)
        self.before = np.concatenate(([0], np.cumsum(counts)))[:sigma]
        self.counts = counts
        # sampled positions: every rate-th and every segment start, so that
        # no walk leaves its segment
        start = np.concatenate(([True], separator[:-1]))
        sampled = start | (np.arange(self.n) % rate == 0)
        self.sampled = sampled[order]
        self.position = order

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of equally long patterns (one per row)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.flatnonzero((self.counts[patterns] > 0).all(axis=1))
        high[:] = np.where(np.isin(np.arange(len(patterns)), alive), high, 0)
        for j in range(patterns.shape[1] - 1, -1, -1):
            if not len(alive):
                break
            c = patterns[alive, j]
            low[alive] = self.before[c] + self.tree.rank(c, low[alive])
            high[alive] = self.before[c] + self.tree.rank(c, high[alive])
            alive = alive[high[alive] > low[alive]]
        return low, np.maximum(high, low)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, text position) of every occurrence."""
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        row = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(which))
        steps = np.zeros(len(row), dtype=np.int64)
        open_ = np.flatnonzero(~self.sampled[row]) if len(row) else np.empty(0, np.int64)
        while len(open_):
            at = row[open_]
            c = self.bwt[at]
            row[open_] = self.before[c] + self.tree.rank(c, at)
            steps[open_] += 1
            open_ = open_[~self.sampled[row[open_]]]
        return which, self.position[row] + steps


class Phrases:
    """A block of benchmark phrases: word numbers, item lists, triple filter."""

    def __init__(self, texts: list[tuple[object, str | None]], window: int):
        self.window = window
        data, bounds = ta.column_bytes(pa.array([t for _, t in texts], pa.large_string()))
        starts, ends, offsets = ta.word_spans(data, bounds, ta.ALNUM)
        words = ta.span_hashes(data, starts, ends, lower=True)
        self.vocabulary = np.unique(words)
        ids = np.searchsorted(self.vocabulary, words) + 1
        found: dict[tuple, set] = {}
        for k, (item, _) in enumerate(texts):
            row = ids[offsets[k]:offsets[k + 1]].tolist()
            for i in range(max(1, len(row) - window + 1) if row else 0):
                found.setdefault(tuple(row[i:i + window]), set()).add(item)
        self.items = sorted({str(x) for s in found.values() for x in s if x is not None})
        number = {x: i for i, x in enumerate(self.items)}
        self.groups = []            # (length, patterns, item offsets, item numbers)
        for size in sorted({len(p) for p in found}):
            own = sorted(p for p in found if len(p) == size)
            lists = [sorted(number[str(x)] for x in found[p] if x is not None) for p in own]
            self.groups.append((size, np.array(own, dtype=np.int64),
                                np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64),
                                np.array([i for x in lists for i in x], dtype=np.int64)))
        self.least = min((g[0] for g in self.groups), default=window)
        self.gram = min(3, self.least)
        self.filter = np.zeros(1 << GRAM_BITS, dtype=bool)
        for _, patterns, _, _ in self.groups:
            flat = self.vocabulary[patterns - 1].ravel()
            edges = np.arange(0, len(flat) + 1, patterns.shape[1])
            grams = ta.window_hashes(flat, self.gram)[ta.within_rows(edges, self.gram)]
            self.filter[grams >> ta.U64(64 - GRAM_BITS)] = True

    def __len__(self):
        return sum(len(g[1]) for g in self.groups)

    def candidates(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Positions whose word lies in a run long enough to hold a phrase."""
        mask = np.zeros(len(words), dtype=bool)
        n = len(words) - self.gram + 1
        if n <= 0 or not self.groups:
            return mask
        hit = self.filter[ta.window_hashes(words, self.gram) >> ta.U64(64 - GRAM_BITS)]
        hit &= ta.within_rows(offsets, self.gram)
        row_start = np.zeros(n, dtype=bool)
        row_start[offsets[:-1][offsets[:-1] < n]] = True
        edge = hit.copy()
        edge[1:] &= ~(hit[:-1] & ~row_start[1:])
        first = np.flatnonzero(edge)
        if not len(first):
            return mask
        run = np.cumsum(edge)[hit] - 1
        size = np.bincount(run, minlength=len(first))
        keep = size >= self.least - self.gram + 1
        return ta.cover(len(words), first[keep], first[keep] + size[keep] + self.gram - 1)


def find_phrases(words: np.ndarray, offsets: np.ndarray, phrases: Phrases
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit mask over the words, and (row, item number) pairs, of one shard."""
    hit = np.zeros(len(words), dtype=bool)
    none = np.empty(0, np.int64)
    mask = phrases.candidates(words, offsets)
    if not mask.any():
        return hit, none, none
    at = np.flatnonzero(mask)
    number = np.searchsorted(phrases.vocabulary, words[at])
    number[number == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[number] == words[at]
    at, number = at[known], number[known] + 1
    row = np.searchsorted(offsets, at, "right") - 1
    if not len(at):
        return hit, none, none
    # segments: consecutive positions of one row; a separator after each
    cut = np.concatenate((np.flatnonzero((np.diff(at) != 1) | (np.diff(row) != 0)) + 1, [len(at)]))
    symbols = np.insert(number, cut, 0)
    place = np.insert(at, cut, -1)
    used, dense = np.unique(symbols, return_inverse=True)
    index = FMIndex(dense.astype(np.int64), len(used))
    lookup = np.full(len(phrases.vocabulary) + 1, 0, dtype=np.int64)
    lookup[used] = np.arange(len(used))
    starts, ends, pairs = [], [], []
    for size, patterns, item_at, items in phrases.groups:
        dense_patterns = lookup[patterns]
        possible = np.flatnonzero((dense_patterns > 0).all(axis=1))
        if not len(possible):
            continue
        low, high = index.search(dense_patterns[possible])
        which, position = index.locate(low, high)
        if not len(which):
            continue
        which = possible[which]
        first = place[position]
        starts.append(first)
        ends.append(first + size)
        found = np.unique(np.stack([np.searchsorted(offsets, first, "right") - 1, which]), axis=1)
        count = item_at[found[1] + 1] - item_at[found[1]]
        which_item = np.repeat(item_at[found[1]] - np.concatenate(([0], np.cumsum(count)[:-1])), count) \
            + np.arange(int(count.sum()))
        pairs.append(np.stack([np.repeat(found[0], count), items[which_item]]))
    if not starts:
        return hit, none, none
    hit = ta.cover(len(words), np.concatenate(starts), np.concatenate(ends))
    rows, items = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return hit, rows, items


FIELDS = [("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<string>"),
          ("spans", "array<struct<first_word:bigint,end_word:bigint,first_byte:bigint,end_byte:bigint>>")]


def _one_block(docs: DataFrame, text: str, path: str, window: int, carried: bool) -> DataFrame:
    def make():
        phrases = load_block(path, window)

        def compute(batch: pa.RecordBatch) -> list:
            data, bounds = ta.column_bytes(batch.column(0))
            words, offsets, sides = [], [0], []
            for lo, hi in ta.slices(bounds):
                part = data[bounds[lo]:bounds[hi]]
                starts, ends, own = ta.word_spans(part, bounds[lo:hi + 1] - bounds[lo], ta.ALNUM)
                words.append(ta.span_hashes(part, starts, ends, lower=True))
                sides.append((starts + bounds[lo], ends + bounds[lo]))
                offsets.extend((own[1:] + offsets[-1]).tolist())
            flat = np.concatenate(words) if words else np.empty(0, ta.U64)
            offsets = np.array(offsets, dtype=np.int64)
            starts = np.concatenate([s for s, _ in sides]) if sides else np.empty(0, np.int64)
            ends = np.concatenate([e for _, e in sides]) if sides else np.empty(0, np.int64)
            hit, rows, items = find_phrases(flat, offsets, phrases)
            n = batch.num_rows
            found: list[set] = [set() for _ in range(n)]
            for r, i in zip(rows.tolist(), items.tolist()):
                found[r].add(phrases.items[i])
            if carried:
                for r, (earlier, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    found[r].update(earlier)
                    for s in spans:
                        hit[offsets[r] + s["first_word"]:offsets[r] + s["end_word"]] = True
            spans: list[list] = [[] for _ in range(n)]
            marked = np.flatnonzero(hit)
            if len(marked):
                row = np.searchsorted(offsets, marked, "right") - 1
                new = np.concatenate(([True], (np.diff(marked) != 1) | (np.diff(row) != 0)))
                first = np.flatnonzero(new)
                end = np.concatenate((first[1:], [len(marked)])) - 1
                for a, b, r in zip(marked[first].tolist(), marked[end].tolist(), row[first].tolist()):
                    spans[r].append({"first_word": a - int(offsets[r]), "end_word": b + 1 - int(offsets[r]),
                                     "first_byte": int(starts[a] - bounds[r]), "end_byte": int(ends[b] - bounds[r])})
            return [np.diff(offsets), ta.per_row(hit, offsets), [sorted(s) for s in found], spans]
        return compute

    inputs = {"text": f"`{text}`"} | ({"items": "items", "spans": "spans"} if carried else {})
    return annotate(docs, inputs, FIELDS, make)


def phrase_blocks(benchmark: DataFrame, window: int, item: str, text: str) -> list[str]:
    """Folders of the blocks of benchmark pieces (item, text)."""
    spark = benchmark.sparkSession
    bound_batches(spark)
    step = max(1, BLOCK_WINDOWS // 4)                       # phrases of a piece at most

    def cut(batches):
        for batch in batches:
            data, bounds = ta.column_bytes(batch.column(1))
            items, number, count, texts = [], [], [], []
            for r, item_ in enumerate(batch.column(0).to_pylist()):
                own = data[bounds[r]:bounds[r + 1]]
                starts, ends, _ = ta.word_spans(own, np.array([0, len(own)]), ta.ALNUM)
                phrases = max(1, len(starts) - window + 1) if len(starts) else 0
                for a in range(0, phrases, step):
                    b = min(len(starts), a + step + window - 1)
                    items.append(item_)
                    number.append(a)
                    count.append(min(step, phrases - a))
                    texts.append(own[starts[a]:ends[b - 1]].tobytes().decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(number, pa.int64()), pa.array(count, pa.int64()),
                                              pa.array(texts, pa.string())], names=["item", "piece", "n", "text"])
    pieces = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(
        cut, "item string, piece bigint, n bigint, text string")
    pieces = stored(pieces, "pieces")
    blocks = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // BLOCK_WINDOWS))
    path = shared_path(spark, "phrases")
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "piece", "text"), F.lit(blocks)).cast("int"))
    dealt.repartition(blocks, "block").write.partitionBy("block").parquet(path)
    return [f"{path}/block={k}" for k in range(blocks)]


def load_block(path: str, window: int) -> Phrases:
    """The phrases of a block, read by a task; of a folder that is not there, none."""
    import pyarrow.dataset
    from pyarrow.fs import FileType
    fs, root = remote_fs(path)
    if fs.get_file_info(root).type != FileType.Directory:
        return Phrases([], window)
    table = pyarrow.dataset.dataset(root, filesystem=fs, format="parquet").to_table(["item", "text"])
    return Phrases(list(zip(*(c.to_pylist() for c in table.columns))), window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted strings), spans (word and
    byte ranges of the merged occurrences) and contaminated (n_hit > 0 and
    20 * n_hit >= n_words)."""
    out = docs
    for k, path in enumerate(phrase_blocks(benchmark, window, item, item_text)):
        out = _one_block(stored(out, "hits") if k else out, text, path, window, carried=k > 0)
    return out.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def items_digest(items):
    """Column: lowercase hex SHA-256 of the comma-joined item ids."""
    return F.sha2(F.concat_ws(",", items).cast("binary"), 256)


def brute_force(texts: list[str | None], bench: list[tuple[object, str | None]], window: int = WINDOW) -> list[tuple]:
    """Plain-Python definition of the per-document results (for tests)."""
    import re
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def split(t):
        return word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins: dict[tuple, set] = {}
    for key, t in bench:
        w = split(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i:i + window]), set()).add(key)
    sizes = {len(w) for w in wins}
    out = []
    for t in texts:
        w, hit, items = split(t), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (own := wins.get(tuple(w[i:i + size]))) is not None:
                    hit.update(range(i, i + size))
                    items.update(str(x) for x in own if x is not None)
        out.append((len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out
