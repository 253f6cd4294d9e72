"""Secret scan: known forms, and a randomness test battery over other tokens.

Everything runs on Spark's own expressions (no Python in tasks).  One pass
over the texts stores, per document, only lengths: the gaps between the
matches of each pattern (``split``) and the matches (``regexp_extract_all``),
from whose running sums the positions follow, plus the matched long tokens.
All later steps read this ledger and never the text.

Battery: the encoding of a token is inferred from its characters (decimal,
hex, base32, base36 of one case, letters and digits, base64, base64url) and
gives its alphabet.  Under
the hypothesis "drawn uniformly from the alphabet" three tests are made: a
chi-squared test of the symbol counts, a runs test of symbols above and below
the middle of the alphabet, and the serial correlation of neighbours.  The
smallest of the three p-values, times three, is the token's p-value.
Randomness is then rejected with false-discovery control (Benjamini-Hochberg
at level ``FDR``) among the tokens of the same length class, so that very many
short tokens do not decide about long ones.  What is left is reported if it
mixes the classes of its alphabet as a random string would; there is no cut by
length but that of the pattern, and 32 characters for hex, as in its known form.  The p-values
enter the control as counts of logarithmic steps per length class: a table of
bounded size, whatever the corpus.

Defined results: null and empty texts have no span; repeated rows and null
ids are rows like others; positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.frames import stored

# kind -> pattern; the order breaks ties of spans that start together
KINDS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "random": r"[A-Za-z0-9+/_-]{20,}={0,2}",
}
LEAST_VALUE = 8               # characters of an assigned value
ORDER = {kind: i for i, kind in enumerate(KINDS)}
FDR = 0.05
LEAST_TOKEN = 20              # the pattern of ``random`` has no shorter tokens
STEPS, MOST_STEPS = 50, 40_000    # logarithmic steps of a p-value, and their number
# encoding -> (pattern of the whole token, alphabet, least length, classes it must mix)
UPPER, DOWN, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = {
    "decimal": (r"[0-9]+", DIGITS, 0, ()),                  # numbers are not secrets
    "hex": (r"[0-9a-f]+|[0-9A-F]+", DIGITS + "abcdef", 32, ("[0-9]", "[A-Fa-f]")),
    "base32": (r"[A-Z2-7]+", UPPER + "234567", LEAST_TOKEN, ("[2-7]", "[A-Z]")),
    "base36": (r"[a-z0-9]+", DIGITS + DOWN, LEAST_TOKEN, ("[0-9]", "[a-z]")),
    "BASE36": (r"[A-Z0-9]+", DIGITS + UPPER, LEAST_TOKEN, ("[0-9]", "[A-Z]")),
    "alnum": (r"[A-Za-z0-9]+", UPPER + DOWN + DIGITS, LEAST_TOKEN, ("[0-9]", "[A-Z]", "[a-z]")),
    "base64": (r"[A-Za-z0-9+/]+", UPPER + DOWN + DIGITS + "+/", LEAST_TOKEN, ("[0-9]", "[A-Z]", "[a-z]")),
    "base64url": (r"[A-Za-z0-9_-]+", UPPER + DOWN + DIGITS + "-_", LEAST_TOKEN, ("[0-9]", "[A-Z]", "[a-z]")),
}


CHUNK = 128                   # running sums go in chunks, so many matches cost no quadratic work


def scan(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The ledger: a row number, ``keep`` as a struct and, per kind, the gaps
    (before, between and after the matches), the matches' lengths, the lengths
    of assigned values and the long tokens."""
    given = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    columns = [F.monotonically_increasing_id().alias("_id"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")]
    empty = F.array().cast("array<int>")
    for kind, pattern in KINDS.items():
        some = given.rlike(pattern)

        def found(group: int) -> Column:
            return F.regexp_extract_all(given, F.lit(pattern), F.lit(group))
        columns += [F.when(some, F.transform(F.split(given, pattern, -1), F.length)).otherwise(empty).alias(f"gap_{kind}"),
                    F.when(some, F.transform(found(0), F.length)).otherwise(empty).alias(f"len_{kind}")]
        if kind == "assign":
            columns.append(F.when(some, F.transform(found(1), F.length)).otherwise(empty).alias("value_assign"))
        if kind == "random":
            columns.append(F.when(some, found(0)).otherwise(F.array().cast("array<string>")).alias("tokens"))
    return docs.select(*columns)


def _spans_sql(kind: str) -> str:
    """Spans of a kind from its gaps and lengths: each start is the sum of the
    gaps up to the match and of the matches before it."""
    steps = f"zip_with(gap_{kind}, concat(array(0), len_{kind}), (g, n) -> cast(g + n AS bigint))"
    n_blocks = f"cast(1 + (size(gap_{kind}) - 1) DIV {CHUNK} AS int)"
    blocks = f"transform(sequence(0, {n_blocks} - 1), c -> c * {CHUNK} + 1)"
    # (block, sum of the blocks before) pairs; lambdas refer only to their arguments
    cut = f"zip_with({blocks}, array_repeat({steps}, {n_blocks}), (c, s) -> slice(s, c, {CHUNK}))"
    sums = f"transform({cut}, b -> aggregate(b, 0L, (t, x) -> t + x))"
    before = f"aggregate({sums}, array(0L), (t, x) -> concat(t, array(element_at(t, -1) + x)))"
    running = (f"flatten(zip_with({cut}, slice({before}, 1, {n_blocks}), (b, o) -> "
               f"slice(aggregate(b, array(o), (t, x) -> concat(t, array(element_at(t, -1) + x))), 2, size(b))))")
    return (f"IF(size(len_{kind}) = 0, cast(array() AS array<struct<start:bigint,kind:int,end:bigint>>), "
            f"zip_with(slice({running}, 1, size(len_{kind})), len_{kind}, "
            f"(s, n) -> struct(s AS start, {ORDER[kind]} AS kind, s + n AS end)))")


def spans(ledger: DataFrame) -> DataFrame:
    """(_id, base, candidates): sorted spans of the known forms, and spans of
    long tokens outside them, with the token."""
    own = {k: F.expr(_spans_sql(k)).alias(f"own_{k}") for k in KINDS}
    rows = ledger.select("_id", "value_assign", "tokens", *own.values())
    base = f"""array_sort(concat(
        filter(zip_with(own_assign, value_assign, (s, v) -> IF(v >= {LEAST_VALUE}, s, NULL)), s -> s IS NOT NULL),
        own_access, own_hex))"""
    rows = rows.select("_id", F.expr(base).alias("base"), F.expr(
        "zip_with(own_random, tokens, (s, t) -> struct(s.start AS start, s.kind AS kind, s.end AS end, t AS token))"
    ).alias("tokens"))
    return rows.select("_id", "base", F.expr(
        "filter(tokens, t -> NOT exists(base, b -> b.start <= t.start AND b.end >= t.end))").alias("candidates"))


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal (logistic approximation, error < 2e-4)."""
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def battery(tokens: DataFrame) -> DataFrame:
    """Rows with a ``token`` column: adds n, p (of uniform randomness in the
    inferred encoding), length_class and usable; tokens without a testable
    encoding are left out."""
    body = F.regexp_replace("token", "=+$", "")
    encoding = F.lit(None).cast("string")
    for name, (pattern, *_) in reversed(ENCODINGS.items()):
        encoding = F.when(body.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(encoding)
    alphabet, least, mixes = F.lit(""), F.lit(0), F.lit(False)
    for name, (_, symbols, n, classes) in ENCODINGS.items():
        own, mixed = F.col("encoding") == name, F.lit(True)
        for c in classes:
            mixed = mixed & F.col("body").rlike(c)
        alphabet = F.when(own, F.lit(symbols)).otherwise(alphabet)
        least = F.when(own, F.lit(n)).otherwise(least)
        mixes = F.when(own, mixed).otherwise(mixes)
    rows = tokens.withColumns({"body": body, "encoding": encoding}).where("encoding IS NOT NULL")
    rows = rows.withColumns({"alphabet": alphabet, "least": least, "mixes": mixes}).where("least > 0")
    rows = rows.withColumn("body", F.when(F.col("encoding") == "hex", F.lower("body")).otherwise(F.col("body")))
    rows = rows.withColumns({
        "n": F.length("body"), "a": F.length("alphabet"),
        "codes": F.expr("transform(filter(split(body, ''), c -> c <> ''), c -> instr(alphabet, c) - 1)")})
    rows = rows.withColumns({
        "squares": F.expr("""aggregate(transform(sequence(1, a),
            k -> n - length(replace(body, substr(alphabet, k, 1), ''))), 0D, (s, o) -> s + o * o)"""),
        "high": F.expr("transform(codes, c -> IF(2 * (c + 1) > a, 1, 0))"),
        "mean": F.expr("aggregate(codes, 0D, (s, c) -> s + c) / n")})
    rows = rows.withColumns({
        "n1": F.expr("aggregate(high, 0D, (s, x) -> s + x)"),
        "turns": F.expr("""aggregate(zip_with(slice(high, 1, n - 1), slice(high, 2, n - 1),
            (x, y) -> IF(x <> y, 1, 0)), 0D, (s, x) -> s + x)"""),
        "serial": F.expr("""aggregate(zip_with(slice(codes, 1, n - 1), slice(codes, 2, n - 1),
            (x, y) -> (x - mean) * (y - mean)), 0D, (s, x) -> s + x)"""),
        "spread": F.expr("aggregate(codes, 0D, (s, c) -> s + (c - mean) * (c - mean))")})
    n, df = F.col("n").cast("double"), F.col("a") - 1.0
    chi = F.greatest(F.col("squares") * F.col("a") / n - n, F.lit(1e-9))
    # Wilson-Hilferty: the cube root of chi-squared over its mean is near normal
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    pairs = 2 * F.col("n1") * (n - F.col("n1"))
    z_runs = F.when(pairs > n, (F.col("turns") - pairs / n) / F.sqrt(
        pairs * (pairs - n) / (n * n * (n - 1)))).otherwise(F.sqrt(n))
    z_serial = F.when(F.col("spread") > 0, F.col("serial") / F.col("spread") * F.sqrt(n)).otherwise(F.sqrt(n))
    p = 3 * F.least(_tail(z_chi), 2 * _tail(F.abs(z_runs)), 2 * _tail(F.abs(z_serial)))
    return rows.select(*tokens.columns, "encoding", "n", F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0)).alias("p"),
                       F.floor(F.log2(n)).cast("int").alias("length_class"),
                       ((F.col("n") >= F.col("least")) & F.col("mixes")).alias("usable"))


def _step() -> Column:
    return F.least(F.floor(-STEPS * F.log("p")), F.lit(MOST_STEPS)).cast("int")


def rejection_levels(tests: DataFrame, fdr: float = FDR) -> list[tuple[int, int]]:
    """Benjamini-Hochberg per length class: (class, step) such that p-values of
    at least that many steps are rejected.  Counted per class and step, so at
    most 31 * MOST_STEPS rows leave the tasks' partial sums; 31 rows at most
    come to the driver."""
    counts = tests.groupBy("length_class", _step().alias("step")).agg(F.count("*").alias("c"))
    per_class = counts.groupBy("length_class").agg(
        F.sum("c").alias("m"), F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("down"), "c"))).alias("steps"))
    # smallest p first; the p-values of a step are at most exp(-step / STEPS)
    passed = F.expr(f"""aggregate(steps, struct(0L AS k, -1 AS best, m AS m), (s, x) -> struct(
        s.k + x.c AS k,
        IF(exp(x.down / {float(STEPS)}D) <= {fdr}D * (s.k + x.c) / s.m, -x.down, s.best) AS best, s.m AS m)).best""")
    return [(r[0], r[1]) for r in per_class.select("length_class", passed.alias("best")).collect() if r[1] >= 0]


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, fdr: float = FDR) -> DataFrame:
    """The ``keep`` columns (all by default) with ``base``, the spans of the
    known forms, and ``spans``, all spans, as arrays of (start, kind, end) in
    order; kind is the number in KINDS.  Carried columns of these names are
    replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("base", "spans")]
    # the row number is stored with the ledger, so it cannot change afterwards
    ledger = stored(scan(docs, text, keep), "secrets-scan")
    found = stored(spans(ledger), "secrets-spans")
    tests = stored(battery(found.select("_id", F.explode("candidates").alias("c")).select("_id", "c.*")), "secrets-tests")
    rejected = F.lit(False)
    for length_class, best in rejection_levels(tests, fdr):
        rejected = rejected | ((F.col("length_class") == length_class) & (_step() >= best))
    added = tests.where(F.col("usable") & ~rejected).groupBy("_id").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    both = found.select("_id", "base").join(added, "_id", "left").select(
        "_id", "base", F.array_sort(F.when(F.col("added").isNull(), F.col("base")).otherwise(
            F.concat("base", "added"))).alias("spans"))
    return ledger.select("_id", "row").join(both, "_id").select(
        *[F.col("row").getField(c).alias(c) for c in keep], "base", "spans")


def to_text(items: str) -> Column:
    """kind:start:end of a span array column, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({items}, s -> concat_ws(':', get(array({names}), s.kind), s.start, s.end)), ',')")


def redact(found: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``find`` with every span of the text replaced by ``mark``."""
    merged = F.expr("""aggregate(spans, cast(array() AS array<struct<start:bigint,end:bigint>>), (t, s) ->
        IF(size(t) > 0 AND element_at(t, -1).end >= s.start,
           concat(slice(t, 1, size(t) - 1), array(struct(element_at(t, -1).start AS start, greatest(element_at(t, -1).end, s.end) AS end))),
           concat(t, array(struct(s.start AS start, s.end AS end)))))""")
    rows = found.withColumn("_merged", F.when(F.size("spans") > 0, merged))
    pieces = F.expr(f"""concat_ws('{mark}', transform(
        zip_with(concat(array(struct(0L AS start, 0L AS end)), _merged), concat(_merged, array(struct(length(`{text}`) + 0L AS start, 0L AS end))),
                 (x, y) -> struct(x.end AS a, y.start AS b, `{text}` AS t)),
        p -> substring(p.t, cast(p.a + 1 AS int), cast(p.b - p.a AS int))))""")
    return rows.withColumn(text, F.when(F.col("_merged").isNull(), F.col(text)).otherwise(pieces)).drop("_merged")


def brute_base(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the known forms by definition (for tests)."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(KINDS["assign"], text, re.A) if len(m[1]) >= LEAST_VALUE]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32]
    kinds = list(KINDS)
    return [(kinds[k], a, b) for a, k, b in sorted(out)]


def brute_digest(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(text)).encode()).hexdigest()
