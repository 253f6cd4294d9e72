"""Phrase collocations per language, by best-first branch-and-bound growth.

A phrase of 2 to ``LONGEST`` words with ``a`` occurrences (``LEAST`` or more)
scores ``floor(1000 * a * n / (l * r))`` at its weakest cut, where l and r are
the occurrences of the two parts and n those of all words of the language.
Since ``r >= a``, no phrase that starts with the word w can score more than
``floor(1000 * n / f(w))``: the count of a prefix bounds the scores of all its
extensions, and rare first words have the best bounds.

The frontier holds the first words of every language, best bound first.  A
round expands the next part of it: the phrases that start with these words are
counted level by level, an extension only where its prefix has ``LEAST``
occurrences, then scored, and the absorbed ones dropped.  A language is settled
when the best bound left lies below its ``TOP``-th surviving score (equal
bounds are expanded, so ties are whole).  The first round takes the words that
hold ``FIRST_SHARE`` of the language's text; the next takes all whose bound
still reaches the score then found, or all words if there are not ``TOP``
survivors.  Both settle the language.

A candidate is absorbed exactly when a phrase with one word more occurs as
often, that is when all its occurrences have the same word before them, or the
same after them (occurrences of a longer phrase are occurrences of what lies
between, so longer phrases need no look of their own).

How it runs.  The texts are tokenised once into chunks of 64-bit word keys, in
which pieces and words of fewer than ``LEAST`` occurrences are breaks.  Every
count is a map-only pass over these chunks that combines within the task and a
grouped sum.  A pass is told which prefixes to extend by a Bloom filter of at
most 8 MB (``Filter``), made by a Spark aggregation; a false positive only
counts a phrase in vain.  The driver sees filters and the number of open
languages, no phrase.  Keys of phrases are 64-bit hashes of (prefix, word): two
of m phrases fall together with a chance of m**2 / 2**65.

Defined results: a null text is empty, a null lang is ``und`` (as a lang of
that name); repeated rows count again; an empty table gives no row; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm import textarrays as ta
from foldwise.llm.filters import holds, make_filter
from foldwise.llm.frames import bound_batches, stored

LEAST, LONGEST, TOP = 100, 5, 2000
FIRST_SHARE = 0.125
CHUNK = 1 << 16               # words of an encoded chunk, about
HELD = 1 << 20                # distinct keys that a task combines before it gives them on
_ENDS = {*b".,;:!?", *range(0x0A, 0x0E)}
_WORD = ta.byte_class(set(range(256)) - _ENDS - {0x20, 0x09})
_END = ta.byte_class(_ENDS)
_STEP = ta.U64(0xC2B2AE3D27D4EB4F)
SURVIVES = f"NOT always OR size = {LONGEST}"


# ------------------------------------------------------------------ tokens
def _tokens(data: np.ndarray, bounds: np.ndarray, lang: np.ndarray):
    """Keys of the words of a slice, their rows, starts and ends, and whether a
    word is followed by one of the same piece."""
    starts, ends, offsets = ta.word_spans(data, bounds, _WORD)
    rows = ta.rows_of(offsets)
    with np.errstate(over="ignore"):
        keys = ta.mix(ta.span_hashes(data, starts, ends, lower=True) + lang[rows])
    keys[keys == 0] = 1                                     # 0 is a break
    stops = np.concatenate(([0], np.cumsum(_END[data], dtype=np.int64)))
    joined = np.zeros(len(keys), dtype=bool)
    joined[:-1] = (rows[1:] == rows[:-1]) & (stops[starts[1:]] == stops[ends[:-1]])
    return keys, rows, starts, ends, joined


def _slices(batch: pa.RecordBatch):
    """(data, bounds, lang keys) of the slices of a batch of (text, lk)."""
    data, bounds = ta.column_bytes(batch.column(0))
    lang = batch.column(1).to_numpy().view(np.uint64)
    for lo, hi in ta.slices(bounds):
        yield data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], lang[lo:hi]


def _next(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of the phrases (prefix key, next word)."""
    with np.errstate(over="ignore"):
        return ta.mix(keys * _STEP + words)


class Sums:
    """Distinct keys with sums of counts, and minima and maxima of further
    columns, combined within a task.  ``carry`` columns are equal for a key, so
    any value does."""

    def __init__(self, extremes: int = 0):
        self.extremes, self.parts, self.rows = extremes, [], 0

    def add(self, keys, counts, carry=(), low=(), high=()):
        if len(keys):
            self.parts.append((keys, counts, *carry, *low, *high))
            self.shape = (len(carry), len(low))
            self.rows += len(keys)
        if self.rows > 2 * HELD:
            self._combine()

    def _combine(self):
        if not self.parts:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        first = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1])))
        c, x = self.shape
        out = [columns[0][first], np.add.reduceat(columns[1], first), *(v[first] for v in columns[2:2 + c])]
        out += [np.minimum.reduceat(v, first) for v in columns[2 + c:2 + c + x]]
        out += [np.maximum.reduceat(v, first) for v in columns[2 + c + x:]]
        self.parts, self.rows = [tuple(out)], len(first)

    def take(self, all_: bool, names: list[str]):
        """Batches of the combined rows: all, or when they are too many to hold."""
        if all_ or self.rows > HELD:
            self._combine()
            if self.parts and (all_ or self.rows > HELD):
                columns = self.parts[0]
                self.parts, self.rows = [], 0
                for at in range(0, len(columns[0]), 1 << 18):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[at:at + (1 << 18)].view(np.int64)) for c in columns], names=names)


def _count_words(texts: DataFrame) -> DataFrame:
    """(key, lk, n) of every word."""
    def run(batches):
        sums = Sums()
        for batch in batches:
            for data, bounds, lang in _slices(batch):
                keys, rows, *_ = _tokens(data, bounds, lang)
                own, at, count = np.unique(keys, return_index=True, return_counts=True)
                sums.add(own, count.astype(np.int64), carry=(lang[rows[at]],))
            yield from sums.take(False, ["key", "n", "lk"])
        yield from sums.take(True, ["key", "n", "lk"])
    return texts.mapInArrow(run, "key bigint, n bigint, lk bigint").groupBy("key", "lk").agg(F.sum("n").alias("n"))


def _encode(texts: DataFrame, frequent) -> DataFrame:
    """Chunks (lk, words) of word keys; 0 is a break, and rare words are breaks.
    Words between two breaks are left out, for they are in no phrase."""
    def run(batches):
        for batch in batches:
            for data, bounds, lang in _slices(batch):
                keys, rows, _, _, joined = _tokens(data, bounds, lang)
                words = np.where(holds(frequent.value, keys), keys, ta.U64(0))
                cut = np.flatnonzero(~joined) + 1
                words, rows = np.insert(words, cut, 0), np.insert(rows, cut, rows[cut - 1])
                full = words != 0
                near = np.zeros(len(full), dtype=bool)
                near[1:] |= full[:-1]
                near[:-1] |= full[1:]
                full &= near
                keep = full.copy()
                keep[1:] |= full[:-1]                       # one break after each run
                words, kept = np.where(full, words, ta.U64(0))[keep], lang[rows[keep]]
                for lk in np.unique(kept):
                    own = words[kept == lk]
                    for at in range(0, len(own), CHUNK):     # chunks overlap, the overlap is not counted
                        part = own[max(0, at - 1):at + CHUNK + LONGEST].view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.array([lk]).view(np.int64)), pa.array([min(at, 1)], pa.int32()),
                             pa.array([min(CHUNK, len(own) - at)], pa.int32()),
                             pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))],
                            names=["lk", "lead", "size", "words"])
    return texts.mapInArrow(run, "lk bigint, lead int, size int, words array<bigint>")


def _chunks(batch: pa.RecordBatch):
    """(lk, words, lead, size) of the chunks; words are followed by LONGEST breaks.
    Phrases start at ``lead`` to ``lead + size - 1``; before lies the word to the left."""
    words = batch.column(3)
    for i in range(batch.num_rows):
        own = words[i].values.to_numpy().view(np.uint64)
        yield (np.int64(batch.column(0)[i].as_py()), np.concatenate((own, np.zeros(LONGEST + 1, np.uint64))),
               batch.column(1)[i].as_py(), batch.column(2)[i].as_py())


def _count_level(chunks: DataFrame, size: int, prefixes) -> DataFrame:
    """(key, n) of the phrases of ``size`` words whose prefix the filter holds,
    with LEAST occurrences or more."""
    def run(batches):
        sums = Sums()
        for batch in batches:
            for _, words, lead, count in _chunks(batch):
                at = np.arange(lead, lead + count)
                at = at[words[at] != 0]
                keys = words[at]
                for j in range(1, size):
                    if j == size - 1:
                        some = holds(prefixes.value, keys)
                        at, keys = at[some], keys[some]
                    full = words[at + j] != 0
                    at, keys = at[full], keys[full]
                    keys = _next(keys, words[at + j])
                own, n = np.unique(keys, return_counts=True)
                sums.add(own, n.astype(np.int64))
            yield from sums.take(False, ["key", "n"])
        yield from sums.take(True, ["key", "n"])
    return chunks.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


DETAILS = ["key", "n", "lk", *[f"w{j}" for j in range(1, LONGEST + 1)], "l0", "r0", "l1", "r1"]


def _details(chunks: DataFrame, wanted) -> DataFrame:
    """Of the phrases that the filter holds: (key, n, lk, words w1.. with 0 after
    the last, size, and whether one word always stands before or after)."""
    def run(batches):
        sums = Sums()
        for batch in batches:
            for lk, words, lead, count in _chunks(batch):
                at = np.arange(lead, lead + count)
                at = at[words[at] != 0]
                keys = words[at]
                for j in range(1, LONGEST):
                    full = words[at + j] != 0
                    at, keys = at[full], keys[full]
                    keys = _next(keys, words[at + j])
                    some = np.flatnonzero(holds(wanted.value, keys))
                    here, own = at[some], keys[some]
                    left = np.where(here > 0, words[here - 1], ta.U64(0))
                    right = words[here + j + 1]
                    spell = [words[here + i] if i <= j else np.zeros(len(here), np.uint64) for i in range(LONGEST)]
                    sums.add(own, np.ones(len(own), np.int64), carry=(np.full(len(own), lk).view(np.uint64), *spell),
                             low=(left, right), high=(left, right))
            yield from sums.take(False, DETAILS)
        yield from sums.take(True, DETAILS)
    rows = chunks.mapInArrow(run, ", ".join(f"{c} bigint" for c in DETAILS))
    spell = [f"w{j}" for j in range(1, LONGEST + 1)]
    out = rows.groupBy("key", "lk", *spell).agg(
        F.sum("n").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("l0", "l1", "r0", "r1") for n, f in (("min", F.min), ("max", F.max))])

    def always(side: str):
        # the tasks' extremes are of unsigned numbers: equal ones are all that counts
        ends = [F.col(f"{n}_{side}{i}") for n in ("min", "max") for i in (0, 1)]
        return (ends[0] != 0) & (ends[0] == ends[1]) & (ends[0] == ends[2]) & (ends[0] == ends[3])
    words = F.filter(F.array(*spell), lambda w: w != 0)
    return out.select("key", "lk", "n", words.alias("words"), F.size(words).alias("size"), (always("l") | always("r")).alias("always"))


def _part_keys(phrases: DataFrame) -> DataFrame:
    """``phrases`` with the keys ``left`` and ``right`` of the parts of each cut."""
    def run(batches):
        for batch in batches:
            lists = batch.column("words")
            words = lists.values.to_numpy()[lists.offsets[0].as_py():].view(np.uint64)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            index, cut, left, right = [], [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                for k in range(1, b - a):
                    index.append(i)
                    cut.append(k)
                    left.append(key_of(words[a:a + k]))
                    right.append(key_of(words[a + k:b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(index, pa.int64())), pa.array(cut, pa.int32()),
                 pa.array(np.array(left, dtype=np.uint64).view(np.int64)), pa.array(np.array(right, dtype=np.uint64).view(np.int64))],
                names=["key", "cut", "left", "right"])
    return phrases.select("key", "words").mapInArrow(run, "key bigint, cut int, left bigint, right bigint")


def key_of(words: np.ndarray) -> np.uint64:
    key = words[:1].copy()
    for w in words[1:]:
        key = _next(key, np.array([w], dtype=np.uint64))
    return key[0]


def _scored(phrases: DataFrame, counts: DataFrame, languages: DataFrame) -> DataFrame:
    """``phrases`` with l, r and score of the weakest cut (ties: the first)."""
    cuts = _part_keys(phrases).join(counts.select(F.col("key").alias("left"), F.col("n").alias("l")), "left") \
        .join(counts.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    rows = phrases.join(cuts.select("key", "cut", "l", "r"), "key").join(languages, "lk")
    # 38 digits hold every product, and div is exact
    score = F.expr("""(cast(1000 AS decimal(4,0)) * cast(n AS decimal(19,0)) * cast(words_n AS decimal(19,0)))
                      div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))""")
    least = rows.select("key", F.struct(score.alias("score"), "cut", "l", "r").alias("x")).groupBy("key").agg(F.min("x").alias("x"))
    return phrases.join(least, "key").select("key", "lk", "words", "size", "n", "always", "x.score", "x.l", "x.r")


def _spellings(texts: DataFrame, wanted) -> DataFrame:
    """(key, phrase) of the phrases that the filter holds, words joined by spaces."""
    def run(batches):
        seen: set = set()
        for batch in batches:
            for data, bounds, lang in _slices(batch):
                keys, _, starts, ends, joined = _tokens(data, bounds, lang)
                at = np.arange(len(keys))
                keys = keys.copy()
                words = keys.copy()
                found, text = [], []
                for j in range(1, LONGEST):
                    more = joined[at + j - 1] if len(at) else np.zeros(0, bool)
                    at, keys = at[more], keys[more]
                    keys = _next(keys, words[at + j])
                    some = np.flatnonzero(holds(wanted.value, keys))
                    own, first = np.unique(keys[some], return_index=True)
                    for key, i in zip(own.tolist(), at[some[first]].tolist()):
                        if key not in seen:
                            if len(seen) < HELD:              # beyond, a phrase may be given again
                                seen.add(key)
                            found.append(key)
                            text.append(b" ".join(ta.LOWER[data[starts[x]:ends[x]]].tobytes() for x in range(i, i + j + 1)))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(found, dtype=np.uint64).view(np.int64)), pa.array([t.decode("utf-8", "replace") for t in text])],
                        names=["key", "phrase"])
    return texts.mapInArrow(run, "key bigint, phrase string").groupBy("key").agg(F.min("phrase").alias("phrase"))


RESULT = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top``
    surviving phrases by score and a descending, phrase ascending."""
    spark = docs.sparkSession
    bound_batches(spark)
    share = spark.sparkContext.broadcast                    # of filters, at most 8 MB each
    own = F.coalesce(F.col(f"`{lang}`"), F.lit("und"))
    texts = docs.select(F.col(f"`{text}`").alias("text"), F.xxhash64(own).alias("lk"))
    names = docs.select(own.alias("lang"), F.xxhash64(own).alias("lk")).distinct()
    words = stored(_count_words(texts), "words")
    languages = stored(words.groupBy("lk").agg(F.sum("n").alias("words_n")).join(names, "lk"), "languages")
    frequent = stored(words.where(F.col("n") >= LEAST), "frequent")
    chunks = stored(_encode(texts, share(make_filter(frequent))), "chunks")

    def expanded(first: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame] | None:
        """(scored phrases that start with these words, key and n of all phrases known)."""
        levels, grown = [], first
        for size in range(2, LONGEST + 1):
            if grown.isEmpty():
                break
            grown = stored(_count_level(chunks, size, share(make_filter(grown))), "level")
            levels.append(grown)
        if not levels:
            return None
        new = reduce(DataFrame.unionByName, levels).select("key")
        if known is not None:                               # a false positive of an earlier filter
            new = new.join(known, "key", "left_anti")
        phrases = stored(_details(chunks, share(make_filter(new))).join(new, "key"), "phrases")
        now = phrases.select("key", "n")
        known = now if known is None else known.unionByName(now)
        counts = known.unionByName(frequent.select("key", "n"))
        # right parts that start with other words
        ends = _part_keys(phrases).select(F.col("right").alias("key")).distinct()
        asked = stored(ends.join(counts, "key", "left_anti"), "asked")
        if not asked.isEmpty():
            counts = counts.unionByName(_details(chunks, share(make_filter(asked))).join(asked, "key").select("key", "n"))
        return stored(_scored(phrases, counts, languages), "scored"), known

    # the first words with the best bounds, up to a share of the language's text
    octave = F.floor(F.log2("n") * 8).cast("int")
    mass = frequent.groupBy("lk", octave.alias("o")).agg(F.sum("n").alias("m"))
    below = F.sum("m").over(Window.partitionBy("lk").orderBy("o"))
    limits = mass.withColumn("below", below).join(languages, "lk").where(
        F.col("below") <= F.col("words_n") * FIRST_SHARE).groupBy("lk").agg(F.max("o").alias("o"))
    first = stored(frequent.join(limits, "lk").where(octave <= F.col("o")).select("key"), "first")
    done, known, scored = first, None, None
    while True:
        round_ = expanded(first, known)
        if round_ is not None:
            part, known = round_
            scored = part if scored is None else scored.unionByName(part)
        reached = languages.select("lk", "words_n", F.lit(None).cast("bigint").alias("least"))
        if scored is not None:
            place = F.row_number().over(Window.partitionBy("lk").orderBy(F.desc("score")))
            last = scored.where(SURVIVES).withColumn("place", place).where(F.col("place") == top)
            reached = languages.select("lk", "words_n").join(last.select("lk", F.col("score").alias("least")), "lk", "left")
        bound = F.expr("(cast(1000 AS decimal(4,0)) * cast(words_n AS decimal(19,0))) div cast(n AS decimal(19,0))")
        first = stored(frequent.join(done, "key", "left_anti").join(reached, "lk").where(
            F.col("least").isNull() | (bound >= F.col("least"))).select("key"), "first")
        if first.isEmpty():
            break
        done = done.unionByName(first)
    if scored is None:
        return spark.createDataFrame([], RESULT)
    place = F.rank().over(Window.partitionBy("lk").orderBy(F.desc("score"), F.desc("n")))
    best = stored(scored.where(SURVIVES).withColumn("place", place).where(F.col("place") <= top).drop("place"), "best")
    spelled = _spellings(texts, share(make_filter(best)))
    rank = F.row_number().over(Window.partitionBy("lk").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = best.withColumnRenamed("n", "a").join(spelled, "key").join(languages, "lk").withColumn("rank", rank.cast("bigint"))
    return rows.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", F.col("words_n").alias("n"), "score")


def brute_force(docs: list[tuple[str | None, str | None]], least: int = LEAST, top: int = TOP) -> list[tuple]:
    """Rows of the result for (text, lang) pairs, by definition (for tests)."""
    pieces: dict[str, list] = {}
    for text, lang in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        pieces.setdefault("und" if lang is None else lang, []).extend(
            re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low))
    out = []
    for lang, rows in pieces.items():
        f = Counter(tuple(w[i:i + m]) for w in rows for m in range(1, LONGEST + 1) for i in range(len(w) - m + 1))
        n = sum(map(len, rows))
        held = {q: a for q, a in f.items() if len(q) > 1 and a >= least}
        gone = {q[i:i + m] for q, a in held.items() for m in range(2, len(q)) for i in range(len(q) - m + 1)
                if 100 * a >= 100 * f[q[i:i + m]]}
        found = []
        for q, a in held.items():
            if q not in gone:
                score, k = min((1000 * a * n // (f[q[:k]] * f[q[k:]]), k) for k in range(1, len(q)))
                found.append((-score, -a, " ".join(q).encode(), f[q[:k]], f[q[k:]]))
        for i, (score, a, q, l, r) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, q.decode(), -a, l, r, n, -score))
    return out
