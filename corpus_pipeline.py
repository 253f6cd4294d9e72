"""A training-data pipeline: five operators, each on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents it keeps, with the columns of ``docs``; the last returns
the mix.  ``run`` applies them to the documents table.  Each stage's result is
written as Parquet in the shared folder and read again, so a lost executor
costs one stage at most; a stage deletes the intermediate tables of the stage
before it, whose result is written by then, and no others.

Nulls and repeats, stage by stage: a null text fails the quality rules; a null
doc_id is a copy in its group of near-duplicates and stays only where all ids of
the group are null; repeated rows leave one row there.  The later stages take
null ids and sources as values.  On an empty table every stage is empty.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import decontaminate, mixing, neardup, quality, secrets
from foldwise.llm.frames import Intermediates, bound_batches, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules accepts."""
    return quality.apply_policy(quality.ledger(docs)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest doc_id."""
    labels = neardup.near_duplicates(docs)
    # one row per kept (doc_id, text): repeated rows leave one
    kept = labels.where("kept").select("doc", "h").distinct()
    rows = docs.withColumns({"_doc": F.col("doc_id").cast("long"), "_h": F.xxhash64("text")})
    joined = rows.join(kept, rows["_doc"].eqNullSafe(kept["doc"]) & (rows["_h"] == kept["h"]), "left_semi")
    return joined.dropDuplicates(["_doc", "_h"]).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in the text replaced, n_chars renewed."""
    clean = secrets.redact(secrets.find(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, with copy (from 1)."""
    rows = mixing.mix(docs, keep=list(docs.columns))
    return rows.where("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        *docs.columns, "size", "source_size", "target", "copies", "copy")


_LAST = threading.local()               # tables of the stage before, per thread


def _releasing(stage, first: bool = False, last: bool = False):
    """The stage, which deletes the tables of the one before when it begins.  The
    last stage's tables stay: its result may not have been read yet."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before, own = getattr(_LAST, "tables", None), Intermediates()
        if before is not None and not first:
            before.release(spark)
        _LAST.tables = None if last else own
        with own:
            return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [
    ("quality rules", _releasing(quality_rules, first=True)),
    ("near-duplicates", _releasing(near_duplicates)),
    ("benchmark decontamination", _releasing(decontaminated)),
    ("secret scan", _releasing(without_secrets)),
    ("source mix", _releasing(mixed, last=True)),
]

# near-duplicates by MinHash, the battery of the secret scan and the random
# mix are not expressible in SQL; tests/llm holds brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"), intermediate=False)
    return docs
