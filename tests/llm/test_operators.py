"""Operators of foldwise.llm against brute force, with nulls, empty and long
texts, ties, repeated rows, empty tables and clashing column names."""
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from foldwise.llm import (components, decontaminate, htmltext, mixing, neardup, quality, secrets, substrings, toxicity,
                          urlfilter, warc)

WORDS = [w + s for w in "alpha beta gamma delta kappa sigma omega zeta theta lambda ñandú straße".split()
         for s in ("", "s", "x", "ing", "ed")]
DOCS = "doc_id bigint, text string, lang string, source string, n_words bigint, size string, spans string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def make_docs():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    texts = list(base)
    for t in base[:20]:                                   # near copies: one word replaced
        w = t.split(" ")
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    texts += base[:6] * 3                                 # exact copies
    passage = prose(rng, 70)
    texts += [prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 15) for _ in range(8)]
    texts += ["", " \n\t ", "one", "ONE", "A b\tC d", None, "the same line\n" * 60, "a" * 3000, "##### $$$ %%% || <>" * 9]
    texts.append(prose(rng, 60_000))                      # a long text
    rows = [(i, t, "en", rng.choice(["a", "b", "c", "é", None]), 7, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", None, None, None, None, None), (None, None, None, "a", None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def multiset(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# ------------------------------------------------------------ 1 decontamination
def test_decontaminate(spark, rows, docs, empty):
    texts = [r[1] for r in rows]
    long_words = [t for t in texts if t and len(t.split()) > 40]
    bench = [(1, " ".join(long_words[0].split()[3:30]).upper()), (2, "one"), (3, ""), (4, None),
             (None, " ".join(long_words[1].split()[:20])), (10, " ".join(long_words[2].split()[5:25])),
             (10, " ".join(long_words[2].split()[5:25])), (5, "x, y")]
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    out = decontaminate.decontaminate(docs, b).select(
        "doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), decontaminate.items_digest("items").alias("d"),
        "contaminated")
    want = sorted([(r[0], *x) for r, x in zip(rows, decontaminate.brute_force(texts, bench))], key=repr)
    assert multiset(out, *out.columns) == want
    assert any(x[-1] for x in want)
    assert decontaminate.decontaminate(empty, b).count() == 0
    none = decontaminate.decontaminate(docs, b.where("false"))
    assert none.where("contaminated OR n_hit > 0").count() == 0 and none.count() == len(rows)


def test_decontaminate_in_blocks(spark, docs, monkeypatch):
    texts = [r.text for r in docs.where("length(text) > 200 AND length(text) < 5000").limit(6).collect()]
    b = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")
    one = multiset(decontaminate.decontaminate(docs, b), "doc_id", "n_hit", "items", "contaminated")
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 300)
    assert multiset(decontaminate.decontaminate(docs, b), "doc_id", "n_hit", "items", "contaminated") == one


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(8)
    text = prose(rng, 900)
    d = spark.createDataFrame([(i, " ".join(text.split()[a:a + 14]) + f" end{i}") for i, a in enumerate(range(0, 880, 7))] + [(900, text)],
                              "doc_id bigint, text string")
    b = spark.createDataFrame([(1, text), (2, None), (None, "lone words here")], "item_id bigint, text string")
    one = multiset(decontaminate.decontaminate(d, b), "doc_id", "n_hit", "items", "spans")
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 100)
    assert len(decontaminate.phrase_blocks(b, 13, "item_id", "text")) > 5
    assert multiset(decontaminate.decontaminate(d, b), "doc_id", "n_hit", "items", "spans") == one
    assert all("n_hit=0" not in repr(r) and r[1] >= 14 for r in one)


def test_spans_are_the_hit_words(spark):
    words = [f"w{i}" for i in range(40)]
    d = spark.createDataFrame([(1, "é " + " ".join(words))], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, " ".join(words[10:25])), (8, " ".join(words[20:36]))], "item_id bigint, text string")
    r = decontaminate.decontaminate(d, b).first()
    (s,) = r.spans
    assert (s.first_word, s.end_word, r.n_hit) == (11, 37, 26)
    assert r.text.encode()[s.first_byte:s.end_byte].decode() == " ".join(words[10:36])


# ------------------------------------------------------------------ 2 toxicity
def test_ftrl_learns_and_scores_all(spark, docs, rows, empty):
    rng = random.Random(1)
    data = [(i, prose(rng, 30) + (" vile brute " + prose(rng, 5) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(900)]
    d = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(3, 1, 1), (10 ** 9, 1, 0), (None, 1, 1), (5, 1, None)],
                                   "doc_id bigint, quality int, toxic int")
    weights = toxicity.train(d, labels)
    out = toxicity.score(d, *weights).withColumn("held", toxicity.is_held_out()).collect()
    held = [r for r in out if r.held]
    assert {r.doc_id for r in held} == {i for i, _, _ in data if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == data[r.doc_id][2] for r in held) / len(held) > 0.95
    scored = toxicity.score(docs, *weights)
    assert scored.count() == len(rows) and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert scored.where("predicted <> IF(score >= 0.5, 1, 0)").count() == 0
    assert toxicity.score(empty, *weights).count() == 0
    flat = toxicity.score(docs, *toxicity.train(docs, labels.where("false")))
    assert flat.where("score <> 0.5").count() == 0


def test_scores_replace_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", "old", 7), (1, "a b", "old", 7), (None, None, None, None)],
                              "doc_id bigint, text string, score string, predicted int")
    out = toxicity.score(d, [], [])
    assert out.columns.count("score") == 1 and sorted(out.columns) == ["doc_id", "predicted", "score", "text"]
    assert [tuple(r) for r in out.select("score", "predicted").distinct().collect()] == [(0.5, 1)]


def test_ftrl_fit_matches_plain_python(spark):
    """A whole fit, epochs and order included, and its scores, against the
    published update in plain Python."""
    import math

    import numpy as np
    import pyarrow as pa
    from foldwise.llm import textarrays as ta
    rng = random.Random(4)
    data = [(i, prose(rng, 6) + (" vile" if i % 2 else "")) for i in range(40)]
    d = spark.createDataFrame(data, "doc_id bigint, text string")
    slots, values = toxicity.train(d, spark.createDataFrame([(i, 1, i % 2) for i, _ in data], "doc_id bigint, quality int, toxic int"), l1=0.5)
    order = [r.doc_id for r in d.where(~toxicity.is_held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]

    def slots_of(text):
        raw, bounds = ta.column_bytes(pa.array([text]))
        return toxicity.feature_sets(raw, bounds)[0].tolist()
    sets = {i: slots_of(t) for i, t in data}
    z, n, bias = {}, {}, 1 << toxicity.BITS

    def w(f):
        l1 = 0.0 if f == bias else 0.5
        v = z.get(f, 0.0)
        if abs(v) <= l1:
            return 0.0
        return -(v - math.copysign(l1, v)) / ((toxicity.BETA + math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA + toxicity.L2)
    for epoch in range(toxicity.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(order)).tolist():
            own = [*sets[order[k]], bias]
            now = {f: w(f) for f in own}
            g = 1 / (1 + math.exp(-sum(now.values()))) - order[k] % 2
            for f in own:
                before = n.get(f, 0.0)
                n[f] = before + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - math.sqrt(before)) / toxicity.ALPHA * now[f]
    want = {f: w(f) for f in z if w(f)}
    got = dict(zip(np.asarray(slots).tolist(), np.asarray(values).tolist()))
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], abs=1e-9) for f in want)
    for r in toxicity.score(d, slots, values).collect():
        logit = want.get(bias, 0.0) + sum(want.get(f, 0.0) for f in sets[r.doc_id])
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)


def test_ftrl_matches_the_definition():
    """One coordinate by the published update, in plain Python."""
    m = toxicity.FtrlProximal(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z = n = zb = nb = 0.0
    import math

    def w_of(z, n, l1):
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((1.0 + math.sqrt(n)) / 0.5 + 0.2)
    import numpy as np
    for y in (1, 0, 1, 1, 0, 1):
        w, b = w_of(z, n, 0.1), w_of(zb, nb, 0.0)
        g = 1 / (1 + math.exp(-(w + b))) - y
        z += g - (math.sqrt(n + g * g) - math.sqrt(n)) / 0.5 * w
        zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / 0.5 * b
        n, nb = n + g * g, nb + g * g
        m.update(np.array([17]), y)
    assert m.z[17] == pytest.approx(z) and m.n[17] == pytest.approx(n) and m.z[-1] == pytest.approx(zb)


# ---------------------------------------------------------------------- 3 WARC
def test_warc_round_trip(spark):
    pages = [(i, f"http://h.example/{i}", f"<p>page {i % 7}</p>" * (i + 1 if i % 7 == 3 else 1)) for i in range(40)]
    pages += [(50, None, None), (51, "http://a b\r\nX: y", ""), (None, "u", "<p>page 1</p>"), (52, "http://x", "ü" * 200_000),
              (9, "http://h.example/9", pages[9][2]), (53, "http://x", "a\r\n\r\nb")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, record_type int").repartition(4)
    out = warc.round_trip(df, with_payload=True).collect()
    assert len(out) == len(pages)
    last = {}
    for i, _, h in pages:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = i is not None and i < last[h or ""]
        want.append((i, len(raw), warc.base32_sha1(raw), "revisit" if revisit else "response", last[h or ""] if revisit else None,
                     None if revisit else raw))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
            None if r.payload is None else bytes(r.payload)) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.round_trip(df.where("false")).count() == 0
    kept = warc.round_trip(df, min_revisit_bytes=10 ** 6)
    assert kept.where("record_type = 'revisit'").count() == 0


def test_warc_members_cut_off():
    for data in ([], [b"WARC/1.1\r\n"], [b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab"]):
        with pytest.raises(ValueError):
            warc.read_record(iter(data))


def test_warc_digests_are_verified(tmp_path):
    import io
    raw = warc.record(1, "http://x", b"hello", None, False)
    for bad in (raw.replace(b"hello", b"jello"), raw[:-2]):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            for chunks in warc.members(io.BytesIO(pack.compress(bad) + pack.flush())):
                warc.read_record(chunks)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = pack.compress(raw) + pack.flush()
    with pytest.raises(EOFError):
        for chunks in warc.members(io.BytesIO(whole[:-9])):
            warc.read_record(chunks)
    three = [warc.read_record(c)["page_id"] for c in warc.members(io.BytesIO(whole * 3))]
    assert three == [1, 1, 1]


# ------------------------------------------------------------ 4 near-duplicates
def test_near_duplicates(rows, docs, empty):
    given = [(r[0], r[1]) for r in rows if r[0] is not None]
    want = neardup.brute_force(given)
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    got = {r.doc: (r.n_shingles, r.component, r.kept) for r in out if r.doc is not None}
    assert got == want
    assert len({c for _, c, _ in want.values()}) < len(want)
    assert {(r.component, r.kept) for r in out if r.doc is None} == {(None, True)}
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_dense_group(spark):
    """A large group of near copies is one component; neighbours are few."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(rng, 50)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc: (r.n_shingles, r.component, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == neardup.brute_force(rows)


def star_rows(n_copies, seed=4):
    """An original and copies with two far edits each: 0.756 alike to it, less
    than 0.75 to each other, so every link runs through the original."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(76)]
    places = rng.sample([(a, b) for a in range(4, 67) for b in range(a + 5, 72)], n_copies)
    rows = [(0, " ".join(base))]
    for i, (a, b) in enumerate(places, 1):
        w = list(base)
        w[a], w[b] = f"a{i}", f"b{i}"
        rows.append((i, " ".join(w)))
    return rows


def test_near_duplicates_star_group(spark):
    """An original joins its copies, which no window of neighbours holds."""
    rows = star_rows(1200)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc: (r.n_shingles, r.component, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == neardup.brute_force(rows)
    assert sum(kept for _, _, kept in got.values()) == 1


def test_ties_come_in_another_order_in_every_tree(spark):
    """Nodes with equal minima: each tree gives other neighbours."""
    rows = [(t, b"\1" * 4 * neardup.DEPTH, hashlib.md5(b"%d" % i).digest(), 50, hashlib.md5(b"%d" % i).digest(), b"")
            for i in range(200) for t in range(8)]
    pairs, _ = neardup.candidates(spark.createDataFrame(rows, neardup.ROW), 2)
    n, votes = pairs.count(), {r.votes for r in pairs.collect()}
    assert n > 0.9 * 8 * (199 + 198) and max(votes) < 5      # one order for all: 397 pairs of 8 votes


@pytest.mark.parametrize("block_nodes, block_shingles", [(neardup.BLOCK_NODES, neardup.BLOCK_SHINGLES), (40, 1500)])
def test_pairs_beyond_the_window(spark, block_nodes, block_shingles):
    """Regions dealt to one and to many blocks give the links of all pairs."""
    rng = random.Random(8)
    sets = {}
    for i in range(150):
        own = set(range(100)) - set(rng.sample(range(100), rng.randint(0, 30)))
        sets[i] = own | {1000 * (i + 1) + k for k in range(rng.randint(0, 12))}
    name = {i: i.to_bytes(16, "big") for i in sets}
    root = {i: name[0] if i < 60 else name[i] for i in sets}    # a large component and single nodes
    minima = {i: neardup.signatures(neardup.ta.mix(neardup.np.array(sorted(s), dtype=neardup.ta.U64)),
                                    neardup.np.array([0, len(s)])) for i, s in sets.items()}
    nodes = spark.createDataFrame([(name[i], neardup.sketches(m)[0].tobytes()) for i, m in minima.items()],
                                  "node binary, sketch binary")
    rooted = spark.createDataFrame([(7, name[i], len(s), root[i]) for i, s in sets.items()],
                                   "region bigint, node binary, n int, root binary")
    given = spark.createDataFrame([(name[i], sorted(s)) for i, s in sets.items()], "node binary, shingles array<bigint>")
    links = neardup.beyond_window(rooted, nodes, lambda wanted: given.join(wanted, "node"), 75,
                                  block_nodes, block_shingles).collect()

    def joined(pairs):
        top = dict(zip(name.values(), root.values()))
        for u, v in pairs:
            old, new = top[u], top[v]
            top = {k: new if x == old else x for k, x in top.items()}
        groups = {}
        for k, x in top.items():
            groups.setdefault(x, set()).add(k)
        return set(map(frozenset, groups.values()))
    want = [(name[i], name[j]) for i in sets for j in sets
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert joined([(r.u, r.v) for r in links]) == joined(want)
    assert 1 < len(joined(want)) < len(joined([]))


@pytest.mark.parametrize("part_links", [10 ** 6, 90])
def test_components_against_union_find(spark, part_links):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    out = {r.node: r.root for r in components.components(
        spark.createDataFrame(links, "u bigint, v bigint"), part_links).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert out == {x: find(x) for u, v in links if u != v for x in (u, v)}


# ------------------------------------------------------------- 5 substrings
@pytest.mark.parametrize("width", [100, 400])
def test_substrings(rows, docs, empty, width):
    small = [r for r in rows if len(r[1] or "") < 5000]
    df = docs.where("text IS NULL OR length(text) < 5000")
    out = substrings.cut(df, width)
    want = sorted([(r[0], *x) for r, x in zip(small, substrings.brute_force([r[1] for r in small], width))], key=repr)
    got = out.select("doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (s, r) -> s + r.end - r.start)").alias("n"),
                     F.size("removed").alias("k"), "kept_sha256")
    assert multiset(got, *got.columns) == want
    assert sum(x[2] > 0 for x in want) > 5
    r = out.where("size(removed) > 0").first()
    raw = r.text.encode()
    rest = b"".join(raw[a:b] for a, b in zip([0] + [s.end for s in r.removed], [s.start for s in r.removed] + [len(raw)]))
    assert bytes(r.kept_bytes) == rest and hashlib.sha256(rest).hexdigest() == r.kept_sha256
    assert substrings.cut(empty, width).count() == 0


def test_substrings_hot_buckets_and_long_rows(spark, monkeypatch):
    """The path of hot buckets and pieces of long rows give the same result."""
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 12) + passage + prose(rng, 12)) for i in range(40)] + [(99, prose(rng, 700) + passage)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted((r[0], *x) for r, x in zip(rows, substrings.brute_force([t for _, t in rows], 300)))

    def got():
        out = substrings.cut(df, 300)
        return sorted(tuple(r) for r in out.select("doc_id", "n_bytes", F.expr(
            "aggregate(removed, 0L, (s, r) -> s + r.end - r.start)"), F.size("removed"), "kept_sha256").collect())
    assert got() == want
    monkeypatch.setattr(substrings, "HOT_KINDS", 3)
    assert got() == want
    from foldwise.llm import textarrays
    monkeypatch.setattr(textarrays, "SLICE_BYTES", 700)
    assert got() == want


# ----------------------------------------------------------------- 6 mixing
def test_mix(rows, docs, empty):
    sizes, by_doc = {}, {}
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        sizes[r[3]] = sizes.get(r[3], 0) + n
        by_doc.setdefault(r[0], []).append(n)
    want = mixing.brute_targets(sizes)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["size"] in by_doc[r.doc_id] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        assert r.taken in (0, r["size"], 2 * r["size"])
    again = mixing.mix(docs.repartition(3, "text")).collect()
    key = lambda x: (repr(x.doc_id), x["size"], x.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix(empty).count() == 0


def test_mix_comes_near_its_targets_through_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice("aaabbc")) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(df)
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 60
    assert out.count() == 3000


def test_pivot_keeps_the_expected_words():
    rng = random.Random(0)
    for _ in range(300):
        p, q, w, v = rng.uniform(.01, .99), rng.uniform(.01, .99), rng.randint(1, 50), rng.randint(1, 50)
        a, b = mixing.pivot(p, w, q, v, rng.random())
        assert a * w + b * v == pytest.approx(p * w + q * v, abs=1e-6)
        assert {a, b} & {0.0, 1.0} and 0 <= a <= 1 and 0 <= b <= 1
    mean = sum(mixing.pivot(.3, 5, .6, 9, (i + .5) / 20000)[0] for i in range(20000)) / 20000
    assert mean == pytest.approx(.3, abs=1e-3)


# ---------------------------------------------------------------- 7 quality
def test_quality_ledger(rows, docs, empty):
    out = quality.ledger(docs)
    want = sorted(((r[0], *(quality.brute_force(r[1])[m] for m in quality.MEASURES)) for r in rows), key=repr)
    assert multiset(out, "doc_id", *quality.MEASURES) == want
    rules = {name: F.expr(rule) for name, rule in quality.RULES}
    for name, rule in rules.items():
        assert out.where(rule != (F.col("fail_bits").bitwiseAND(F.lit(quality.BIT[name])) != 0)).count() == 0
    assert quality.ledger(empty).count() == 0
    kept = quality.apply_policy(out, "v2").count()
    for r in quality.ablation(out, "v2").collect():
        without = out.where((F.col("fail_bits").bitwiseAND(F.lit(quality.POLICIES["v2"] & ~quality.BIT[r.rule]))) == 0).count()
        assert (r.kept, r.kept_without, r.total) == (kept, without, len(rows))


# ------------------------------------------------------------------- 8 HTML
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to improve everything for you.</div>
<article><header><h1>The   title &amp; more</h1></header><p>First <b>bold</b> paragraph with&nbsp;enough words to be text.
<br>Second line of it.<p>Unclosed paragraph follows here, it has <a href=x>one link</a> and many more words.</p>
<aside>Related: other stories</aside><p>Short.</p><!-- hidden --></article>
<section id="comments"><h2>Comments</h2><p>I am a reader and this is my long comment about the article above.</p></section>
<form><p>Subscribe to our newsletter by giving your address here please.</p><input name=q></form>
<footer>&copy; Example</footer></body></html>"""


def test_html_main_text():
    assert htmltext.main_text(PAGE) == (
        "The title & more\n\nFirst bold paragraph with enough words to be text. Second line of it.\n\n"
        "Unclosed paragraph follows here, it has one link and many more words.\n\nShort.")
    for page in (None, "", "   ", "<", "<p", "<!--", "<script>x", "</div></p>", "<nav><a href=1>menu</a></nav>"):
        assert htmltext.main_text(page) in ("", "<", "<p")
    many = "<article>" + "".join(f"<p>Paragraph number {i} has quite a few words in it, as text does.</p>" for i in range(3000)) + "</article>"
    assert htmltext.main_text(many).count("\n\n") == 2999
    assert htmltext.main_text("<div>" * 3000 + "<article><p>Deep text in a great many nested elements.</p></article>") != ""


PLAIN = """<body><div><a href=/>Home</a> <a href=/x>About us</a></div>
<div><h1>A plain title</h1><p>The first paragraph of a page without any names has quite a few words in it.</p><p>So be it.</p>
<p>Another paragraph follows here, and it also has more than a dozen words in it.</p></div><div>All rights reserved</div></body>"""


def test_html_without_names_needs_the_edges(monkeypatch):
    want = ["A plain title", "The first paragraph of a page without any names has quite a few words in it.", "So be it.",
            "Another paragraph follows here, and it also has more than a dozen words in it."]
    assert htmltext.main_text(PLAIN).split("\n\n") == want
    monkeypatch.setattr(htmltext, "edges", lambda items: [])
    assert htmltext.main_text(PLAIN).split("\n\n") == want[1::2]


@pytest.mark.parametrize("shape", ["<" + "a" * 1_000_000, '<a "x ' * 170_000, '<a ="x ' * 150_000, "<!" * 500_000,
                                   "<div>" * 200_000, "<b>" * 100_000 + "<hr>x" * 100_000, "<b>" + "<div>" * 50_000 + "</b>" * 100_000])
def test_html_reading_is_linear(shape):
    import time
    began = time.process_time()
    htmltext.main_text(shape)
    assert time.process_time() - began < 15             # quadratic readings take minutes to hours


def test_html_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, None), (None, "u", "", None)],
                               "page_id bigint, url string, html string, text string")
    out = htmltext.extract(df)
    assert sorted(out.columns) == ["html", "n_chars", "page_id", "text", "url"]
    assert multiset(out, "n_chars") == sorted([(len(htmltext.main_text(PAGE)),)] * 2 + [(0,), (0,)], key=repr)
    assert htmltext.extract(df.where("false")).count() == 0


def test_minimum_cut_is_the_best_labelling():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 9)
        score = [rng.uniform(-2, 2) for _ in range(n)]
        links = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if rng.random() < .4]

        def cost(side):
            return (sum(-min(s, 0) if x else max(s, 0) for s, x in zip(score, side))
                    + sum(c for i, j, c in links if side[i] != side[j]))
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(htmltext.minimum_cut(score, links)) == pytest.approx(best)


# -------------------------------------------------------------------- 9 URLs
def test_url_filter(spark):
    urls = ["http://a.org/x", "HTTP://WWW.Example.ORG/es/1?q#f", "http://example.org/en/12", "http://example.org/en/2", "http://org",
            "http://org/", "https://b.com/fr/x", "http://b.com/de/", "http://b.com/den", "http://casino-win.example.net/en/1", None, "",
            "no scheme", "://", "x://y://z/", "http://notorg/", "http://m.free-bets.example.com/fr/1?x", "http://a.spam.net#x/",
            "http://example.org.evil.net/es/", "http://exa\nmple.com/fr/", "http://" + "a." * 500 + "org/" + "p" * 5000, "http://classpills.net/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(0, urls[0], None), (None, urls[1], None)],
                               "page_id bigint, url string, rule string")
    out = urlfilter.filter_urls(df)
    want = dict(zip(range(len(urls)), urlfilter.brute_force(urls)))
    for r in out.collect():
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id], urls[r.page_id]
    assert out.count() == len(urls) + 2
    assert urlfilter.filter_urls(df.where("false")).count() == 0


def test_blocked_domains_from_a_table(spark):
    urls = ["http://a.shop.test/x", "http://shop.test", "http://workshop.test/", "http://casino.test/", "http://x.org/", None]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    listed = spark.createDataFrame([("shop.test",), ("shop.test",), (None,)], "domain string")
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(d, blocked=listed).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow"}
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(d, blocked=listed.where("false")).collect()}
    assert set(got.values()) == {"allow"}


def test_digest_array_confirms_strings(spark, tmp_path, monkeypatch):
    words = [f"entry-{i}" for i in range(500)] + ["", "é"]
    monkeypatch.setattr(urlfilter, "SHARD_ROWS", 60)
    df = spark.createDataFrame([(w,) for w in words + words[:9] + [None]], "w string")
    shards = urlfilter.build(df, "w", str(tmp_path))
    assert len(shards) > 3 and sum(n for _, n, _ in shards) == len(words)
    array = urlfilter.SortedDigestArray(shards)
    assert array.contains(words).all() and not array.contains([w + "?" for w in words]).any()
    assert df.select(F.xxhash64(F.lit("é")).alias("h")).first().h == urlfilter.digest("é")
    # a stored string under another string's key must not match
    import numpy as np
    (tmp_path / "x.digests").write_bytes(urlfilter.pack(np.array([urlfilter.digest("a")] * 2), np.array([0, 1, 2]), b"zb"))
    assert not urlfilter.SortedDigestArray([(str(tmp_path / "x.digests"), 2, 0)]).contains(["a"]).any()


# ------------------------------------------------------------------ 10 secrets
def secret_rows():
    rng = random.Random(11)
    hexed = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    mixed = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48))
    return hexed, mixed, [
        (1, f"x token = \"{hexed}\" y"), (2, f"PassWord: '{hexed[:12]}' and password=short then Token=abcdefgh"),
        (3, "AKIA" + "Q7" * 8 + " AKIASHORT AKIA" + "Z" * 12), (4, f"ü {hexed} é {hexed}x {hexed[:31]}"), (5, f"see {mixed} here"),
        (6, "password=token:abcdefgh12 secret==abcdefghi apikey : x api_key:=abcdefgh"), (7, None), (8, ""),
        (9, "the verylongwordwithoutanydigitsorcapitals and 12345678901234567890123456789012"),
        (10, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa AbAbAbAb1AbAbAbAb1AbAbAbAb1AbAbAbAb1"),
        (11, "token=abcdefgh;" * 700), (1, f"x token = \"{hexed}\" y"), (None, f"secret:{hexed}")]


def test_secrets(spark, rows):
    hexed, mixed, given = secret_rows()
    given = given + [(100 + i, r[1]) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(*g, "old") for g in given], "doc_id bigint, text string, spans string").repartition(3)
    found = secrets.find(df)
    out = found.select("doc_id", "text", secrets.to_text("base").alias("b"), secrets.to_text("spans").alias("s")).collect()
    assert len(out) == len(given)
    for r in out:
        assert r.b == ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.brute_base(r.text)), r.text
        assert set(x for x in r.b.split(",") if x) <= set(r.s.split(","))
    added = {r.doc_id: [x for x in r.s.split(",") if x.startswith("random")] for r in out}
    assert added[5] == [f"random:4:{4 + len(mixed)}"]
    assert added[9] == added[10] == []
    clean = {r.doc_id: r.text for r in secrets.redact(found.where("doc_id < 20 OR doc_id IS NULL")).collect()}
    assert clean[1] == "x [SECRET]\" y" and clean[4] == f"ü [SECRET] é [SECRET]x {hexed[:31]}" and clean[5] == "see [SECRET] here"
    assert clean[7] is None and clean[8] == "" and clean[11] == "[SECRET];" * 700
    assert secrets.find(df.where("false")).count() == 0


def test_random_keys_of_all_lengths_are_found(spark):
    """Keys of 20 to 64 characters, of one case too; words joined are not."""
    rng = random.Random(21)
    down, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [down + digits, down.upper() + digits, down + down.upper() + digits]
    keys = [(k, "".join(rng.choice(a) for _ in range(n))) for k, a in enumerate(alphabets) for n in range(20, 65) for _ in range(4)]
    rows = [(i, k, f"see {key} here") for i, (k, key) in enumerate(keys)] + [(1000, 3, "alphabetagammadeltakappa")]
    found = secrets.find(spark.createDataFrame(rows, "doc_id bigint, kind int, text string")).collect()
    hits = [sum(len(r.spans) > 0 for r in found if r.kind == k) for k in range(4)]
    short = sum(len(r.spans) > 0 for r in found if r.kind < 3 and len(r.text) < 9 + 24)
    print("recall", hits, short)
    assert min(hits[:3]) > 0.9 * 180 and short > 0.9 * 48 and hits[3] == 0


def test_battery_tells_noise_from_structure(spark):
    rng = random.Random(12)
    alpha = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    noise = ["".join(rng.choice(alpha) for _ in range(64)) for _ in range(300)]
    made = ["".join(alpha[(i * 3 + j) % 62] for j in range(64)) for i in range(60)] + ["Ab1" * 20 + "x" * i for i in range(60)]
    df = spark.createDataFrame([(t, 0) for t in noise] + [(t, 1) for t in made], "token string, kind int")
    tests = secrets.battery(df)
    levels = dict(secrets.rejection_levels(tests))
    rows = tests.withColumn("step", secrets._step()).collect()
    rejected = {0: 0, 1: 0}
    for r in rows:
        rejected[r.kind] += r.length_class in levels and r.step >= levels[r.length_class]
    assert rejected[1] == len(made) and rejected[0] <= 15
