"""Streams over the tables' files, each run until all is read; what they wrote is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import filters as B
from ..operators.lineage import shared_dir
from ..registry import query
from ..sources import log_tail
from ..streaming import mail
from .matching_queries import _PAIRS, suggestions


def _stream(t, table: str) -> DataFrame:
    """The files of a table as a stream, some at a time."""
    schema = getattr(t, table).schema
    # a table is a file or a folder
    rows = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{t.folder}/{table}.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows  # watermarks need a time zone


def _mails(t) -> DataFrame:
    """The view of mails, over the stream of conversations."""
    key = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    number = F.col("conv_id").cast("string")
    subject = F.when(F.col("turn") == 0, F.concat(F.lit("Topic  "), number)).when(F.col("turn") % 2 == 0, F.concat(F.lit("FW: RE: Topic "), number)).otherwise(F.concat(F.lit("re: RE: Topic "), number))
    hour = F.col("conv_id") * 24 + F.col("turn")
    return _stream(t, "conversations").select(
        key(F.col("turn")).alias("message_id"), F.when(F.col("turn") != 0, key(F.col("turn") - 1)).alias("in_reply_to"), subject.alias("subject"), F.col("role").alias("from_email"), hour.alias("received_hour"),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("task-"), number)).alias("converted_task"), F.timestamp_seconds(946684800 + hour * 3600).alias("received"),
    )


@query("stream_ingest", "SELECT message_id, from_email FROM email")
def _(t):
    """Each mail once, however often the stream is started again: the second run finds nothing new."""
    path = shared_dir(t.spark)
    for _ in range(2):
        mail.run(_mails(t).select("message_id", "from_email"), path)
    return t.spark.read.schema("message_id string, from_email string").parquet(f"{path}/out")


@query("stream_dedupe", "SELECT DISTINCT message_id FROM email")
def _(t):
    path = shared_dir(t.spark)
    mails = _mails(t)
    mail.run(mail.deduplicated(mails.unionByName(mails)).select("message_id"), path)
    return t.spark.read.schema("message_id string").parquet(f"{path}/out")


@query("stream_suggest", f"SELECT a_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, hour, b_id) AS rn FROM {_PAIRS} WHERE score >= 0.7) WHERE rn = 1")
def _(t):
    """Mails that arrive are matched with the stored ones that were converted."""
    path = shared_dir(t.spark)
    kept = t.email

    def suggest(batch: DataFrame, n: int) -> None:
        s = suggestions(kept, arrived=batch).select(F.col("a_message_id").alias("a_id"), F.col("b_message_id").alias("b_id"), "score", F.col("b_received_hour").alias("hour"))
        B.first_of_each(s, ["a_id"], [F.desc("score"), "hour", "b_id"]).select("a_id", "b_id").write.mode("overwrite").parquet(f"{path}/out/batch={n}")

    mail.run(_mails(t), path, suggest)
    return t.spark.read.schema("a_id string, b_id string").parquet(f"{path}/out").select("a_id", "b_id")


@query("stream_notifications", "SELECT email_key, arg_max(notification_type, (CASE notification_type WHEN 'RelatedEmail' THEN 2 WHEN 'NewEmail' THEN 1 ELSE 0 END, notification_type)) AS state FROM notification GROUP BY 1")
def _(t):
    """The last state that the machine gave each mail."""
    path = shared_dir(t.spark)
    kind = F.when(F.col("event_type") == "purchase", "RelatedEmail").when(F.col("event_type") == "view", "NewEmail").otherwise("TaskDue")
    events = _stream(t, "events").select(F.col("user_id").alias("email_key"), kind.alias("notification_type"))
    mail.run(mail.notification_states(events), path, mail.by_batch(path), "update")
    states = t.spark.read.schema("email_key long, state string, batch long").parquet(f"{path}/out")
    return states.groupBy("email_key").agg(F.max_by("state", "batch").alias("state"))


@query("stream_notifications_expiring", "SELECT email_key, max(created) > (SELECT max(created) FROM notification) - INTERVAL 1 HOUR - INTERVAL 7 DAY AS active FROM notification WHERE email_key IS NOT NULL GROUP BY 1")
def _(t):
    """Whether a mail's state is still kept at the end: it goes when nothing came for seven days of event time."""
    path = shared_dir(t.spark)
    kind = F.when(F.col("event_type") == "purchase", "RelatedEmail").when(F.col("event_type") == "view", "NewEmail").otherwise("TaskDue")
    events = _stream(t, "events").select(F.col("user_id").alias("email_key"), kind.alias("notification_type"), "ts")
    with mail.rocks(t.spark):
        mail.run(mail.expiring_states(events), path, mail.by_batch(path), "update")
    states = t.spark.read.schema("email_key long, state string, last long, batch long").parquet(f"{path}/out")
    return states.groupBy("email_key").agg((F.max_by("state", F.struct("batch", F.col("state") == mail.EXPIRED)) != mail.EXPIRED).alias("active"))


@query("log_tail_stream", "SELECT seq, request_id, level, step_name, ms FROM log_event WHERE seq > 100 AND level <> 'INFO'")
def _(t):
    """Log segments tailed by sequence number, five a run; the last run finds nothing new."""
    logs, path = shared_dir(t.spark), shared_dir(t.spark)
    log_tail.write_segments(t.log_event, logs, 12)
    log_tail.register(t.spark)
    for _ in range(4):
        mail.run(t.spark.readStream.format("log_tail").option("path", logs).option("since", 100).option("segments", 5).load(), path)
    return t.spark.read.schema(log_tail.SCHEMA).parquet(f"{path}/out").where("level <> 'INFO'")


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    path = shared_dir(t.spark)
    mail.run(mail.windows(_stream(t, "events"), "1 hour"), path, mail.by_batch(path), "update")
    rows = t.spark.read.schema("start timestamp, event_type string, n long, batch long").parquet(f"{path}/out")
    return rows.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("sliding_windows", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start FROM events, (SELECT 0 AS k UNION ALL SELECT 1)) GROUP BY 1, 2")
def _(t):
    return mail.windows(t.events, "1 hour", "30 minutes")


@query("session_windows", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE >= ts THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s")
def _(t):
    return mail.sessions(t.events, "30 minutes")
