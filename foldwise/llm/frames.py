"""DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.session import ensure_checkpoint_dir

BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python stages by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared folder of ``spark.checkpoint.dir``."""
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), "llm", f"{kind}-{uuid.uuid4().hex}"])


_OPEN = threading.local()


class Intermediates:
    """The folders of intermediate tables written while it is entered, by this
    thread.  Only its owner deletes them, once the results that are computed from
    them are written; tables of other results are not touched."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self):
        self.before, _OPEN.current = getattr(_OPEN, "current", None), self
        return self

    def __exit__(self, *_):
        _OPEN.current = self.before

    def release(self, spark: SparkSession) -> None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, kind: str, intermediate: bool = True) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    df.write.parquet(path)
    owner = getattr(_OPEN, "current", None)
    if intermediate and owner is not None:
        owner.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remote_fs(uri: str):
    """(file system, path) of a URI as seen by a task: local, S3, GCS, HDFS."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


Annotate = Callable[[pa.RecordBatch], list]


def annotate(df: DataFrame, inputs: dict[str, str], fields: list[tuple[str, str]],
             make: Callable[[], Annotate], keep: list[str] | None = None) -> DataFrame:
    """Add columns computed row by row from Arrow batches (no shuffle).

    ``inputs`` maps the argument names of the computation to expressions of
    ``df``; ``make()`` is called once per task and returns a function of a
    RecordBatch of these arguments that returns one Arrow array (or list) per
    entry of ``fields``.  ``keep`` names the columns of ``df`` to carry (all
    by default); a carried column whose name clashes with a new one is
    replaced by it.
    """
    bound_batches(df.sparkSession)
    new = {name.lower() for name, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    args = list(inputs)
    source = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row") if kept else F.lit(True).alias("_row"),
        *[F.expr(e).alias(f"_{a}") for a, e in inputs.items()])
    out = T.StructType([source.schema["_row"],
                        *[T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]])
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = [to_arrow_type(f.dataType) for f in out.fields[1:]]
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            given = pa.RecordBatch.from_arrays([batch.column(1 + i) for i in range(len(args))], names=args)
            columns = [x if isinstance(x, pa.Array) else pa.array(x, type=t)
                       for x, t in zip(compute(given), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_row", *names])

    done = source.mapInArrow(run, out)
    return done.select(*[F.col("_row").getField(c).alias(c) for c in kept], *names)


def as_local(uri: str) -> str:
    return os.fspath(remote_fs(uri)[1])
