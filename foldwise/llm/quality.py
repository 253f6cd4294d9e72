"""Quality rules as a ledger of failure bits.

``ledger`` evaluates every rule once per document, in one row-wise pass, and
stores the measurements and a bit per failed rule.  Policies are versioned
bit masks over the ledger: ``apply_policy`` keeps the rows without a masked
bit, ``ablation`` counts by bitwise aggregation how many documents each rule
of a policy rejects, alone and together.  No text is read twice.

Words are ``[^\\x20\\x09-\\x0D]+``.  Repeated lines and windows are compared by
64-bit hashes within one document.

Defined results: null and empty texts have no words and fail the length rule;
repeated rows are judged row by row; carried columns that clash with
measurement names are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm import textarrays as ta
from foldwise.llm.frames import annotate

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

# (name, SQL condition that FAILS a document); the position is the bit number.
RULES = [
    ("too_short", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_short"] | BIT["repeated_windows"]

# versioned policies: the rules whose failure rejects a document
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["repeated_lines"],
    "v2": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["long_words"] | BIT["short_words"],
}
CURRENT = "v2"

_SYMBOL = ta.byte_class(b"#*$%&|<>")
_LEAD = ta.byte_class([*range(0x80), *range(0xC0, 0x100)])


def _grouped(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (row, key), and for each but the first: equals the one before."""
    with np.errstate(over="ignore"):
        joint = ta.mix(keys + rows.astype(ta.U64) * ta.U64(0x9E3779B97F4A7C15))
    order = np.argsort(joint)
    joint = joint[order]
    return order, joint[1:] == joint[:-1]


def measure(data: np.ndarray, bounds: np.ndarray, window: int = 5) -> list[np.ndarray]:
    """The measurements of each row of a slice, in the order of MEASURES."""
    starts, ends, offsets = ta.word_spans(data, bounds, ta.NON_SPACE)
    words = ta.span_hashes(data, starts, ends)
    lead = _LEAD[data] & ta.NON_SPACE[data]
    # lines: split at \n and at row ends
    newline = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.concatenate((bounds[:-1], newline + 1)))
    line_start = line_start[line_start < len(data)]
    line_end = np.minimum(np.concatenate((line_start[1:], [len(data)])), len(data))
    line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 0x0A)) \
        if len(line_start) else line_end[:0]
    with_word = np.searchsorted(starts, line_end, "left") > np.searchsorted(starts, line_start, "left")
    line_start, line_end = line_start[with_word], line_end[with_word]
    line_row = np.searchsorted(bounds, line_start, "right") - 1
    order, same = _grouped(ta.span_hashes(data, line_start, line_end), line_row)
    dup_row = line_row[order[1:][same]]
    n_rows = len(bounds) - 1
    grams = ta.window_hashes(words, window)
    inside = np.flatnonzero(ta.within_rows(offsets, window))
    rows = ta.rows_of(offsets)
    order, same = _grouped(grams[inside], rows[inside])
    again = inside[np.concatenate((order[1:][same], order[:-1][same]))]
    covered = ta.cover(len(words), again, again + window)
    return [np.diff(offsets), ta.per_row(lead, bounds), ta.per_row(_SYMBOL[data], bounds),
            np.bincount(line_row, minlength=n_rows), np.bincount(dup_row, minlength=n_rows),
            ta.per_row(covered, offsets)]


def ledger(docs: DataFrame, text: str = "text", window: int = 5, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with the measurements and ``fail_bits``."""
    def make():
        def compute(batch: pa.RecordBatch) -> list:
            data, bounds = ta.column_bytes(batch.column(0))
            parts = [measure(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], window)
                     for lo, hi in ta.slices(bounds)]
            return [np.concatenate([p[i] for p in parts] or [np.empty(0, np.int64)]).astype(np.int64)
                    for i in range(len(MEASURES))]
        return compute

    out = annotate(docs, {"text": f"`{text}`"}, [(m, "bigint") for m in MEASURES], make, keep)
    bits = " | ".join(f"IF({rule}, {BIT[name]}L, 0L)" for name, rule in RULES)
    return out.withColumn("fail_bits", F.expr(bits))


def passes(version: str = CURRENT):
    """Column: true if no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    return rows.where(passes(version))


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that only it
    rejects, and that are kept without it (sums over the bits, one pass)."""
    mask = POLICIES[version]
    used = [name for name, _ in RULES if BIT[name] & mask]
    bits = F.col("fail_bits")
    aggs = [F.count("*").alias("total"),
            F.count(F.when(bits.bitwiseAND(F.lit(mask)) == 0, 1)).alias("kept")]
    for name in used:
        aggs += [F.count(F.when(bits.bitwiseAND(F.lit(BIT[name])) != 0, 1)).alias(f"f_{name}"),
                 F.count(F.when(bits.bitwiseAND(F.lit(mask)) == BIT[name], 1)).alias(f"o_{name}")]
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"f_{name}").alias("n_failed"),
                 F.col(f"o_{name}").alias("n_only"), (F.col("kept") + F.col(f"o_{name}")).alias("kept_without"),
                 F.col("kept"), F.col("total")) for name in used])).alias("r")).select("r.*")


def brute_force(text: str | None) -> dict:
    """Plain-Python measurements (for tests)."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
