import numpy as np
from pyspark.sql import functions as F

from sedimenta.streaming.scoring import project_stream, running_best, windowed


def stream(spark, df, tmp_path):
    path = str(tmp_path / "in")
    df.repartition(2).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(writer, tmp_path):
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()


def test_projection_and_windows(spark, tmp_path):
    df = spark.range(100).select("id", F.array((F.col("id") % 3).cast("double")).alias("v"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    out = str(tmp_path / "out")
    w = project_stream(stream(spark, df, tmp_path / "a"), "v", np.array([7, 8, 9]), np.array([[0.0], [1.0], [2.0]]), ["id"])
    drain(w.writeStream.format("parquet").option("path", out), tmp_path / "a")
    assert all(r.neuron == 7 + r.id % 3 for r in spark.read.parquet(out).collect())
    res = {}
    e = windowed(stream(spark, df.withColumn("k", F.lit("k")).withColumn("x", F.lit(1.0)), tmp_path / "b"), "ts", "x", ["k"], "10 minutes", "1 day")
    drain(e.writeStream.outputMode("complete").foreachBatch(lambda b, _: res.update({r.beg: r.n for r in b.collect()})), tmp_path / "b")
    assert sorted(res.values()) == [10] * 10


def test_running_best(spark, tmp_path):
    df = spark.createDataFrame([(f"k{k % 2}", k, float(k % 7)) for k in range(40)], "q string, id long, score double")
    last = {}
    s = running_best(stream(spark, df, tmp_path), "q", "score", "id", 2)
    drain(s.writeStream.outputMode("update").foreachBatch(lambda b, _: last.update({(r.q, r["rank"]): (r.score, r.item) for r in b.collect()})), tmp_path)
    for g in (0, 1):
        want = sorted(((float(k % 7), k) for k in range(40) if k % 2 == g), key=lambda x: (-x[0], x[1]))[:2]
        assert [last[(f"k{g}", r)] for r in (1, 2)] == want
