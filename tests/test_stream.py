"""I1 on a streaming DataFrame: same predictions as batch scoring."""
import os
import tempfile

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler

from foldwise.streaming.score import score_stream


def test_stream_scoring_matches_batch(spark):
    rows = [(i, float(i % 2), float(i % 2) * 3.0 + (i % 5) * 0.1, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_key long, label double, a double, b double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                             DecisionTreeClassifier(featuresCol="features", labelCol="label", maxDepth=3)]).fit(df)
    src = tempfile.mkdtemp(prefix="foldwise-stream-", dir="/tmp")
    df.write.mode("overwrite").parquet(os.path.join(src, "in"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(src, "in"))
    q = (score_stream(model, stream).writeStream.format("memory").queryName("scored_stream")
         .outputMode("append").option("checkpointLocation", os.path.join(src, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = {r["row_key"]: r["prediction"] for r in spark.sql("SELECT * FROM scored_stream").collect()}
    want = {r["row_key"]: r["prediction"] for r in model.transform(df).collect()}
    assert got == want and len(got) == 200
