"""Streams: states that end by a timer, and logs tailed by their numbers."""

import json
import os

from pyspark.sql import functions as F

from millwright.sources import log_tail
from millwright.streaming import mail

HOUR, BASE = 3_600_000, 10_000


def test_states_end_when_nothing_comes(spark, tmp_path):
    batches = [
        [(1, "NewEmail", 0), (2, "NewEmail", 0), (3, "TaskDue", 1)],
        [(1, "RelatedEmail", 5), (None, "NewEmail", 6)],
        [(2, "NewEmail", 30)],  # 1 and 3 are past their time now
        [(2, "RelatedEmail", 31), (1, "NewEmail", 32)],
    ]
    seen = []
    with mail.rocks(spark):
        for n, rows in enumerate(batches):
            df = spark.createDataFrame([(k, t, (h + BASE) * HOUR) for k, t, h in rows], "email_key long, notification_type string, ms long").select("email_key", "notification_type", F.timestamp_millis("ms").alias("ts"))
            df.write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
            mail.run(mail.expiring_states(stream, 10 * HOUR), f"file://{tmp_path}/run", lambda b, i: seen.extend((r.email_key, r.state, r["last"] // HOUR - BASE) for r in b.collect()), "update")
    assert [s for s in seen if s[0] == 3] == [(3, "TaskDue", 1), (3, "Expired", 1)]
    one, two = [s[1] for s in seen if s[0] == 1], [s[1] for s in seen if s[0] == 2]
    assert one == ["NewEmail", "RelatedEmail", "Expired", "NewEmail"]
    assert two == ["NewEmail", "RelatedEmail"] and not any(s[0] is None for s in seen)


def test_logs_are_tailed_by_number(spark, tmp_path):
    logs = f"{tmp_path}/logs"
    os.makedirs(logs)

    def segment(first, last, more=()):
        with open(f"{logs}/{first}-{last}.jsonl", "w") as f:
            f.write("\n".join([json.dumps({"seq": s, "request_id": f"r{s % 3}", "level": "INFO", "ms": s / 2}) for s in range(first, last + 1)] + list(more)))

    segment(1, 9, ["no json", '{"level": "x"}', "[1]", ""])
    segment(10, 5009)
    open(f"{logs}/_7.part", "w").close()
    log_tail.register(spark)
    assert spark.read.format("log_tail").option("path", f"file://{logs}").option("since", 4).load().agg(F.count("*"), F.min("seq"), F.max("seq")).first()[:3] == (5005, 5, 5009)

    def run():
        stream = spark.readStream.format("log_tail").option("path", f"file://{logs}").option("since", 4).option("segments", 1).load()
        mail.run(stream, f"file://{tmp_path}/run")
        return sorted(r.seq for r in spark.read.parquet(f"file://{tmp_path}/run/out").collect())

    assert run() == list(range(5, 10))  # a segment at a time
    assert run() == list(range(5, 5010)) == run()
    segment(5010, 5020)
    assert run() == list(range(5, 5021))
    df = spark.createDataFrame([(s, "r", "INFO", None, 1.0) for s in range(1, 301)], log_tail.SCHEMA)
    log_tail.write_segments(df, f"file://{tmp_path}/more", 4)
    parts = log_tail.segments(f"file://{tmp_path}/more")
    assert sum(b - a + 1 for a, b, _ in parts) == 300 and all(x[1] < y[0] for x, y in zip(parts, parts[1:]))
