"""Queries: adjudication through a model hook, streaming forms, embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import hooks
from citeloom.functions import text as t
from citeloom.operators import extract as x
from citeloom.plans.p_core import delivered
from citeloom.session import scratch, table
from citeloom.streaming import streams


def udf03_open_book(spark, d):
    """Claims judged against their evidence by a model hook (offline: word overlap); without evidence a claim is UNCERTAIN with 0."""
    i = delivered(spark, d, "claim_text", "retrieved_evidences")
    e = F.array_join(F.transform("retrieved_evidences.extractive_chunks", lambda c: c["extractive_text"]), "\n")
    has = F.coalesce(F.size("retrieved_evidences.extractive_chunks"), F.lit(0)) > 0
    p = i.select("instance_id", F.when(has & F.col("claim_text").isNotNull(), F.concat("claim_text", F.lit("\nEvidence: "), e)).alias("prompt"))
    g = hooks.generate(p, "instance_id", "prompt", hooks.rule_classifier)
    return g.select("instance_id", x.classification(F.col("answer")).alias("label"), F.coalesce(F.get_json_object("answer", "$.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"))


def ret04_embed_claims(spark, d):
    """Claims embedded by the offline hasher and compared with their contexts."""
    i = delivered(spark, d, "claim_text", "surrounding_context")
    a = hooks.embed(i, "instance_id", "claim_text").withColumnRenamed("embedding", "a")
    b = hooks.embed(i, "instance_id", "surrounding_context").withColumnRenamed("embedding", "b")
    return a.join(b, "instance_id").select("instance_id", F.round(t.cosine(F.col("a"), F.col("b")), 4).alias("cosine"))


def _drain(spark, df, name, mode):
    at = scratch(spark, f"stream-{name}")
    q = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/ckpt").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def stream_event_windows(spark, d):
    """Event counts in windows of an hour by a stream with watermark; the last windows stay open and do not come out."""
    like = table(spark, d, "events")
    e = streams.file_stream(spark, d, like, "events.parquet")
    w = streams.windowed_counts(e, "ts", "event_type", "value", "1 hour")
    return _drain(spark, w.withColumn("total", F.round("total", 4)), "windows", "append")


def stream_first_deliveries(spark, d):
    """Instances without repeated deliveries by a stream: one row for each id."""
    like = table(spark, d, "instances")
    # a glob meets the table as one file and as a folder of files, on any file system
    s = streams.file_stream(spark, f"{d}/instances.parquet*", like).select("instance_id", "created_at")
    # the source replays all history at once, in any order: its span is the lateness to allow, and the bound of the state
    span = like.select(F.ceil((F.unix_timestamp(F.max("created_at").cast("timestamp")) - F.unix_timestamp(F.min("created_at").cast("timestamp"))) / 86400)).first()[0] or 0
    return _drain(spark, streams.first_deliveries(s, "instance_id", "created_at", f"{int(span) + 1} days").select("instance_id"), "deliveries", "append")


QUERIES = {f.__name__: f for f in [udf03_open_book, ret04_embed_claims, stream_event_windows, stream_first_deliveries]}
SQL = {
    "stream_first_deliveries": "SELECT DISTINCT instance_id FROM instances",
    "stream_event_windows": "WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events), w AS (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT window_start, event_type, n, total FROM w, m WHERE window_start + INTERVAL 1 HOUR <= wm",
}
