"""Streaming forms, driven over everything that is stored.

Windows that the watermark has not passed stay open, as they would in a running query, so the
oracle leaves them out too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.plans import demo
from spoor.plans.demo import with_views
from spoor.plans.registry import query
from spoor.plans.trail_queries import _INGEST
from spoor.session import scratch_path
from spoor.streaming import streams as X


def _follow(spark, sf, table="trail", **equal):
    path = demo.table_path(spark, sf, table)
    return X.follow(spark, path, getattr(demo, table)(spark, sf).schema, **equal)


def _run(spark, stream, name):
    out = X.run_to_table(stream, scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-state"))
    times = [f.name for f in out.schema.fields if f.dataType.typeName() == "timestamp"]
    return out.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})


@query("X1", with_views("trail", "SELECT id, chain_id, sequence FROM trail WHERE risk_level = 'high' AND ts BETWEEN '2024-01-05' AND '2024-01-20'"))
def follow(spark, sf):
    stream = _follow(spark, sf, risk_level="high", after="2024-01-05", before="2024-01-20").select("id", "chain_id", "sequence")
    return _run(spark, stream, "follow")


@query("X2", with_views("trail", "SELECT id, count(*) AS copies FROM trail GROUP BY 1"))
def stream_ingest(spark, sf):
    """The newer half comes first; a second checkpoint brings the older half late and a quarter again."""
    path, state = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-state")
    middle, later = demo.trail(spark, sf).agg(F.percentile_approx("event_id", [0.5, 0.75])).first()[0]
    again = F.explode(F.array(F.lit(0), F.lit(1)))
    for run, part in (("first", F.col("event_id") > middle), ("second", F.col("event_id") <= later)):
        twice = _follow(spark, sf).filter(part).select("id", "chain_id", "sequence", "ts").withColumn("delivery", again)
        X.stream_ingest(twice, path, f"{state}-{run}").awaitTermination()
    return spark.read.parquet(path).groupBy("id").agg(F.count(F.lit(1)).alias("copies"))


# Links of every 37th receipt are forged, and every 41st chain place is missing.
_STREAMED = "NOT (event_id % 41 = 7 AND sequence > 1)"
_FORGED = "CASE WHEN event_id % 37 = 5 THEN 'sha256:forged' ELSE previous_receipt_hash END AS previous_receipt_hash"


# A chain's receipts behind a hole are reported once the watermark is an hour past its last one.
_HEAD_ROWS = (
    f"SELECT *, lag(sequence) OVER c AS before, max(ts) OVER (PARTITION BY chain_id) AS last_ts FROM sealed WHERE {_STREAMED} "
    "WINDOW c AS (PARTITION BY chain_id ORDER BY sequence)"
)
_HOLED = f"(SELECT *, min(CASE WHEN sequence > 1 AND before <> sequence - 1 THEN sequence END) OVER (PARTITION BY chain_id) AS hole FROM ({_HEAD_ROWS}) r)"


@query(
    "X3",
    with_views(
        "sealed",
        "SELECT chain_id, sequence, id, CASE WHEN sequence > 1 AND before <> sequence - 1 THEN 'gap' "
        "WHEN event_id % 37 = 5 THEN 'bad_link' ELSE 'ok' END AS verdict, sequence AS head_sequence "
        f"FROM {_HOLED} s WHERE hole IS NULL OR sequence < hole "
        f"OR last_ts + interval 1 hour <= (SELECT max(ts) - interval 10 minute FROM sealed WHERE {_STREAMED})",
    ),
)
def stream_chain_head(spark, sf):
    X.keep_state_in_rocksdb(spark)
    source = _follow(spark, sf, "sealed").filter(_STREAMED).selectExpr(
        "chain_id", "sequence", "id", _FORGED, "receipt_hash", "ts"
    )
    return _run(spark, X.stream_chain_head(source, 3_600_000, late="10 minutes"), "head")


@query(
    "X4",
    with_views(
        "sealed",
        "SELECT chain_id, sequence, receipt_hash, CASE WHEN sequence % 20 = 0 THEN 'cadence' ELSE 'elapsed' END AS reason FROM "
        "(SELECT *, max(sequence) OVER (PARTITION BY chain_id) AS last, max(ts) OVER (PARTITION BY chain_id) AS last_ts FROM sealed) s "
        "WHERE sequence % 20 = 0 OR (sequence = last AND last_ts + interval 1 hour <= (SELECT max(ts) - interval 10 minute FROM sealed))",
    ),
)
def stream_checkpoints(spark, sf):
    X.keep_state_in_rocksdb(spark)
    return _run(spark, X.stream_checkpoints(_follow(spark, sf, "sealed"), 20, 3_600_000, late="10 minutes"), "witness")


_CALLED = "SELECT correlation_id AS call_id, ts, k FROM trail WHERE correlation_id IS NOT NULL"
_ANSWERED = "SELECT call_id, ts + to_minutes(k % 20) AS ts FROM c WHERE k % 3 <> 0"


@query(
    "X5",
    with_views(
        "trail",
        "SELECT call_id, ts AS asked_at FROM c "
        "WHERE NOT EXISTS (FROM a WHERE a.call_id = c.call_id AND a.ts BETWEEN c.ts AND c.ts + interval 10 minute) "
        "AND ts + interval 10 minute < least((SELECT max(ts) FROM c), (SELECT max(ts) FROM a)) - interval 5 minute",
        c=_CALLED,
        a=_ANSWERED,
    ),
)
def stream_unanswered(spark, sf):
    called = _follow(spark, sf).filter("correlation_id IS NOT NULL").selectExpr("correlation_id AS call_id", "ts")
    answers = _follow(spark, sf).filter("correlation_id IS NOT NULL AND k % 3 <> 0").selectExpr(
        "correlation_id AS call_id", "ts + make_dt_interval(0, 0, cast(k % 20 as int), 0) AS ts"
    )
    return _run(spark, X.stream_unanswered(called, answers), "unanswered")


_MARK = "(SELECT max(ts) - interval 10 minute FROM trail)"


@query(
    "X6",
    with_views(
        "trail",
        "SELECT date_trunc('hour', ts) AS bucket, "
        + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in X.OUTCOMES)
        + f" FROM (SELECT ts, {_INGEST} FROM trail) l GROUP BY 1 HAVING date_trunc('hour', ts) + interval 1 hour <= {_MARK}",
    ),
)
def stream_rates(spark, sf):
    return _run(spark, X.stream_rates(_follow(spark, sf).selectExpr("ts", _INGEST)), "rates")


@query(
    "X7",
    with_views(
        "trail",
        "SELECT session_id, agent_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY session_id, agent_id ORDER BY ts, id) AS run FROM "
        "(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id, agent_id ORDER BY ts, id) < interval 2 hour THEN 0 ELSE 1 END AS fresh FROM trail) f) r "
        f"GROUP BY session_id, agent_id, run HAVING max(ts) + interval 2 hour <= {_MARK}",
    ),
)
def stream_sessions(spark, sf):
    return _run(spark, X.stream_sessions(_follow(spark, sf)), "sessions")


@query(
    "X8",
    with_views(
        "trail",
        "SELECT session_id, date_trunc('day', ts) AS bucket, count(*) AS gaps, cast(sum(drop_count) as bigint) AS dropped FROM trail WHERE action_type = 'audit.events_dropped' "
        "GROUP BY 1, 2 HAVING date_trunc('day', ts) + interval 1 day <= (SELECT max(ts) - interval 10 minute FROM trail WHERE action_type = 'audit.events_dropped')",
    ),
)
def stream_drops(spark, sf):
    return _run(spark, X.stream_drops(_follow(spark, sf)), "drops")
