"""The pipeline's stages against brute force, each on what its predecessor kept."""
import random

import corpus_pipeline as pipeline
from foldwise.llm import decontaminate, neardup, quality, secrets
from test_operators import make_docs, prose


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, t, "en", s, len(t or "")) for i, (d, t, _, s, *_) in enumerate(make_docs()) if len(t or "") < 20_000]
    key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    leak = prose(rng, 30)
    rows += [(500, prose(rng, 40) + f" token = \"{key}\" " + prose(rng, 10), "en", "a", 1), (501, leak + " " + prose(rng, 9), "en", "b", 1),
             (None, prose(rng, 30), "en", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, frame = {r[0]: r[1] for r in rows}, docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        path = f"{tmp_path}/stage{k}"
        stage(spark, frame, str(tmp_path)).write.parquet(path)
        frame = spark.read.parquet(path)
        out = frame.collect()
        if k == 0:
            def fine(t):
                m = quality.brute_force(t)
                return not any(eval(rule, {}, m) for _, rule in quality.RULES)
            kept = {d: t for d, t in kept.items() if fine(t)}
        if k == 1:
            labels = neardup.brute_force([(d, t) for d, t in kept.items() if d is not None])
            kept = {d: t for d, t in kept.items() if d is None or labels[d][2]}
        if k == 2:
            found = decontaminate.brute_force(list(kept.values()), [(1, leak)])
            assert any(f[-1] for f in found)
            kept = {d: t for (d, t), f in zip(kept.items(), found) if not f[-1]}
        if k == 3:
            for r in out:
                spans = secrets.brute_base(kept[r.doc_id])
                assert (r.text == kept[r.doc_id]) == (not spans) and r.n_chars == len(r.text) and key not in r.text
            kept = {r.doc_id: r.text for r in out}
        if k < 4:
            assert frame.columns == docs.columns
            assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(kept.items(), key=repr), name
        else:
            assert all(r.text == kept[r.doc_id] and 1 <= r.copy <= r.copies <= 2 for r in out)
            for s in {r.source for r in out}:
                own = [r for r in out if r.source == s]
                assert abs(sum(r["size"] for r in own) - own[0].target) <= max(r["size"] for r in own)


def test_stages_on_an_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = frame.columns
    for k, (_, stage) in enumerate(pipeline.STAGES):
        path = f"{tmp_path}/stage{k}"
        stage(spark, frame, str(tmp_path)).write.parquet(path)
        frame = spark.read.parquet(path)
        assert frame.count() == 0 and frame.columns[:5] == columns
