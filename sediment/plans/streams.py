"""Streaming queries run to the end of what is there, returned as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path
from ..streaming import counters, text_streams
from ..streaming.state import rocksdb
from .registry import load, query


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files; the file source wants a folder, so a table of one file is picked out of its folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(load(spark, sf_dir, name).schema).option("pathGlobFilter", "*.parquet" if folder else f"{name}.parquet")
    return reader.parquet(f"{sf_dir}/{name}.parquet" if folder else sf_dir)


def drained(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and reads what it wrote."""
    top = scratch_path(spark, "stream")

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{top}/out/{batch}")

    q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True)
    if mode == "append":
        with rocksdb(spark):
            q.format("parquet").option("path", f"{top}/out").start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{top}/out")
    # in complete mode each batch replaces the one before it: an idempotent sink by batch
    q.foreachBatch(lambda df, _: put(df, 0)).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out/0")


@query("SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS calls, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS call_ms FROM events GROUP BY 1")
def stream_request_counters(spark, sf_dir):
    return drained(spark, counters.request_counters(_stream(spark, sf_dir, "events")), "complete")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_daily_windows(spark, sf_dir):
    """An extension: event-time windows with a watermark."""
    return drained(spark, counters.windowed_counts(_stream(spark, sf_dir, "events")), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, conv_id * 100 + turn AS id FROM conversations) SELECT conv_id, CAST(3 AS BIGINT) AS n, id AS upto FROM t WHERE k % 3 = 0")
def stream_due_summaries(spark, sf_dir):
    c = _stream(spark, sf_dir, "conversations")
    return drained(spark, counters.due_summaries(c.select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("id")), 3, None))


@query("SELECT CAST(conv_id AS VARCHAR) AS request_id, md5(string_agg(text, '' ORDER BY turn)) AS h FROM conversations GROUP BY 1")
def stream_new_text(spark, sf_dir):
    """Each turn as partial pieces (all so far), then whole again: only new text comes out."""
    c = _stream(spark, sf_dir, "conversations")
    piece = lambda k, kind, text: F.struct((F.col("turn") * 4 + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    rows = c.select(F.col("conv_id").cast("string").alias("request_id"), F.explode(F.array(piece(0, "partial", F.substring("text", 1, 5)), piece(1, "partial", F.substring("text", 1, 40)), piece(2, "final", F.col("text")))).alias("r"))
    new = drained(spark, text_streams.new_text(rows.select("request_id", "r.seq", "r.kind", "r.text"), None))
    parts = new.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("d"))
    return parts.select("request_id", F.md5(F.array_join(F.transform("d", lambda x: x["delta"]), "")).alias("h"))

