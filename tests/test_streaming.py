"""Streaming and batch folds agree."""

from pyspark.sql import functions as F

from factloom.operators import slots
from factloom.streaming.slot_stream import accepted_once, fold_stream, run_to_table, upsert_batches


def test_stream_fold_equals_batch_fold(spark, small, tmp_path):
    log = slots.write_log(spark.read.parquet(f"{small}/facts.parquet"))
    n = log.count()
    cut = log.agg(F.expr("percentile_disc(0.5) within group (order by seq)")).first()[0]
    src = str(tmp_path / "log")
    log.where(F.col("seq") <= cut).coalesce(1).write.parquet(f"{src}/a")
    log.where(F.col("seq") > cut).coalesce(1).write.parquet(f"{src}/b")
    import os
    import time

    for i, part in enumerate("ab"):  # files in the order of their batches
        for f in os.listdir(f"{src}/{part}"):
            if f.endswith(".parquet"):
                os.utime(f"{src}/{part}/{f}", (time.time() - 100 + i * 10,) * 2)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    got = run_to_table(fold_stream(stream), "decisions", str(tmp_path / "cp"))
    want = slots.fold(log)
    rows = lambda d: {(r["subject_key"], r["predicate_key"], r["scope"], r["seq"]): (r["action"], r["target"]) for r in d.collect()}
    a, b = rows(got), rows(want)
    assert len(a) == n and a == b


def test_replayed_batches_replace_themselves(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(10).withColumn("at", F.lit("2025-01-01").cast("timestamp")).withColumn("payload_hash", (F.col("id") % 4).cast("string")).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = accepted_once(spark.readStream.schema(schema).parquet(src))
    q = upsert_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
