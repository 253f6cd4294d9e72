"""Conversation repair, phrase collocations and neighbour search against brute
force, with nulls, empty and long texts, ties, repeated rows, empty tables and
clashing column names."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import collocations, conversations, neighbours

TALK = "conv_id bigint, turn bigint, role string, text string, audit string, cost string, conv int"


def talks(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "ärzte"]
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \t\n", None, "é.", "a.b", "same", "same", "...", "x" * 3000 + "."]
    rows = []
    for conv in range(n):
        turn = rng.randint(-2, 3)
        for i in range(rng.randint(0, 9)):
            role = rng.choice(roles) if rng.random() < 0.4 else roles[1 + i % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"line {rng.randint(0, 5)}."
            rows.append((None if conv == 7 else conv, None if rng.random() < 0.05 else turn, role, text, "a", "b", 1))
            turn += rng.choice([0, 1, 1, 1, 2])
    rows += rows[5:8]
    return rows


def reports(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, seed):
    rows = talks(seed)
    d = spark.createDataFrame(rows, TALK).repartition(3)
    got = reports(conversations.audit(conversations.damaged(d), F.col("dropped")))
    assert got == conversations.brute_force([r[:4] for r in rows])
    got = reports(conversations.audit(d))
    assert got == conversations.brute_force([r[:4] for r in rows], damage=False)


def test_giant_conversation_spills_and_marks_duplicates_before(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", f"t{i}."]), "", "", 0) for i in range(700)]
    rows += talks(4, 12)
    d = spark.createDataFrame(rows, TALK)
    want = conversations.brute_force([r[:4] for r in rows], damage=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    monkeypatch.setattr(conversations, "SPILL_BYTES", 2000)
    monkeypatch.setattr(conversations, "GIANT", 5)
    monkeypatch.setattr(conversations, "bound_batches", lambda s: None)
    assert reports(conversations.audit(d)) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_repair_gives_legal_sequences(spark):
    rows = talks(5)
    d = spark.createDataFrame(rows, TALK)
    out: dict = {}
    for r in conversations.repair(d).orderBy("conv_id", "seq").collect():
        out.setdefault(r.conv_id, []).append(r)
    for lines in out.values():
        initials = "".join(r.role[0] for r in lines)
        assert initials.lstrip("s") == "ua" * (len(initials.lstrip("s")) // 2) and initials.count("s") <= 1
        assert [r.seq for r in lines] == list(range(len(lines)))
        assert all(r.text == "" and r.role in ("user", "assistant") for r in lines if r.edit == "I")


def test_conversations_empty_and_dropped(spark):
    none = spark.createDataFrame([], TALK)
    assert conversations.audit(none).count() == 0 and conversations.repair(none).count() == 0
    one = spark.createDataFrame([(3, 1, "user", "x.", "", "", 0)], TALK)
    r = conversations.audit(one, F.lit(True)).first()
    assert tuple(r)[:8] == (3, 0, 0, 0, 0, 0, 0, "") and r.repaired_sha256.startswith("e3b0c44298fc1c14")


# ------------------------------------------------------------- collocations
DOC = "doc_id bigint, text string, lang string, n bigint, score string, key string"


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["der", "Apfel", "fällt", "weit", "vom", "Stamm", "new", "york", "city", "of", "the"]
    weights = [30, 5, 4, 4, 12, 4, 3, 3, 3, 20, 30]
    out = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 14)):
            parts.append(rng.choice(["new york city", "New York", "the state of the art,", "vom Stamm. der", "ha ha ha ha ha ha ha",
                                     " ".join(rng.choices(words, weights, k=rng.randint(1, 6))), f"rare{rng.randint(0, 900)}"]))
        out.append((i, rng.choice([" ", "\t ", "; ", "\n"]).join(parts), rng.choice(["en", "de", None, "und"]), 1, "s", "k"))
    out += out[:4] + [(900, None, "en", 0, "", ""), (901, "", None, 0, "", ""), (None, "a. b", "xx", 0, "", ""),
                      (902, "new york city " * 4000, "en", 0, "", "")]
    return out


@pytest.mark.parametrize("least,top,share", [(5, 2000, 0.125), (4, 7, 0.02), (4, 7, 1.0), (3, 12, 0.0)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, top, share):
    rows = corpus(least)
    monkeypatch.setattr(collocations, "LEAST", least)
    monkeypatch.setattr(collocations, "FIRST_SHARE", share)
    d = spark.createDataFrame(rows, DOC).repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(d, top=top).collect())
    assert got == sorted(collocations.brute_force([(r[1], r[2]) for r in rows], least, top))
    assert len(got) > top // 2 or top == 2000


def test_collocations_in_short_chunks(spark, monkeypatch):
    rows = corpus(9)
    d = spark.createDataFrame(rows, DOC)
    monkeypatch.setattr(collocations, "LEAST", 4)
    monkeypatch.setattr(collocations, "CHUNK", 7)
    monkeypatch.setattr(collocations, "HELD", 3)
    got = sorted(tuple(r) for r in collocations.collocations(d, top=40).collect())
    assert got == sorted(collocations.brute_force([(r[1], r[2]) for r in rows], 4, 40))


def test_collocations_without_result(spark):
    none = spark.createDataFrame([], DOC)
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b", "en", 1, "", "")], DOC)).count() == 0


# --------------------------------------------------------------- neighbours
VEC = "vec_id bigint, embedding array<float>, label int, part int, row bigint"


def vectors(n: int, seed: int = 1, clusters: int = 12) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, 16))
    x = (centre[rng.integers(0, clusters, n)] + 0.4 * rng.normal(size=(n, 16))).astype(np.float32)
    return [(i, v.tolist(), 0, 1, 2) for i, v in enumerate(x)]


def test_neighbours_recall_and_exact_scores(spark):
    rows = vectors(4000)
    rows += [(5000 + i, rows[50][1], 0, 1, 2) for i in range(300)]          # many copies of one vector
    d = spark.createDataFrame(rows, VEC).repartition(4)
    got = neighbours.search(d, F.expr("vec_id % 50 = 0")).collect()
    want = neighbours.brute_force([r[:2] for r in rows])
    assert len(got) == len(want)
    truth = {(q, w): s for q, _, w, s in want}
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found & set(truth)) / len(truth) >= 0.9
    by_id = {v: np.array(x, dtype=float) for v, x, *_ in rows}
    for r in got[::7]:
        a, b = by_id[r.query_id], by_id[r.vec_id]
        assert r.score == pytest.approx((a @ b) / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
    hot = sorted((r.rank, r.vec_id) for r in got if r.query_id == 50)
    assert hot == [(i + 1, 5000 + i) for i in range(5)]                      # ties to the smaller id


def test_neighbours_small_and_odd_tables(spark):
    rows = [(0, [1.0, 0.0], 0, 0, 0), (1, [1.0, 1.0], 0, 0, 0), (50, [0.0, 2.0], 0, 0, 0), (None, [2.0, 2.0], 0, 0, 0), (100, None, 0, 0, 0),
            (3, [0.0, 0.0], 0, 0, 0), (4, [float("nan"), 1.0], 0, 0, 0), (5, [float("inf"), 1.0], 0, 0, 0), (6, [None, 1.0], 0, 0, 0),
            (7, [1.0, 0.0], 0, 0, 0), (7, [1.0, 0.0], 0, 0, 0), (150, [], 0, 0, 0), (-50, [3e38, 3e38], 0, 0, 0)]
    d = spark.createDataFrame(rows, VEC)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.search(d, F.expr("vec_id % 50 = 0")).collect())
    want = sorted((q, k, w, round(float(s), 9)) for q, k, w, s in neighbours.brute_force([r[:2] for r in rows]))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert neighbours.search(d.where("vec_id IN (0, 1)"), F.expr("vec_id % 50 = 0")).count() == 1     # all candidates, if fewer
    none = spark.createDataFrame([], VEC)
    assert neighbours.search(none, F.expr("vec_id % 50 = 0")).count() == 0


def test_partitions_are_balanced():
    x = np.array([v for _, v, *_ in vectors(2000)])
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    graph = neighbours.exact(unit, unit, neighbours.GRAPH, np.arange(len(unit)))
    label = neighbours.balanced_partition(unit, graph, 16)
    size = np.bincount(label, minlength=16)
    assert size.max() <= np.ceil(len(unit) / 16 * neighbours.ROOM)
    kept = (label[graph] == label[:, None]).mean()
    assert kept > 0.5                                # most edges stay inside, 1/16 by chance
