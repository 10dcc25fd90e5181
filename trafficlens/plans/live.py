"""Queries: the stream operators over the event table read as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import change as C
from ..operators import rules as R
from ..sources.access_log import render_line
from ..sources.shared import written
from ..sources.tables_view import requests_view
from ..streaming import live as S
from .change import _DENSE, _FULL, _PARTS, _WIDE, _WITH_DIST, _scores, alert_rules, input_keys, lane_table, shape
from .common import over_requests, query
from .keys import KEYS, key_intervals
from .requests import _CLAIM, _HIT, CLAIMED, TOTALS, rules, totals


def request_stream(spark, d) -> DataFrame:
    """The request view of a stream: events as they come, pages as a fixed table."""
    e = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    r = render_line(requests_view(spark, d, e))
    return r.withColumn("ts", F.col("ts").cast("timestamp"))  # event time in the session's zone


def _result(spark, stream, mode="complete", conf=None):
    out = S.run_to_table(spark, stream, "live_" + uuid.uuid4().hex, mode, conf=conf)
    return out.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes))


_CLAIM_WITHOUT_ERRORS = _CLAIM.replace(f"WHEN {_HIT['errors']} THEN 'errors' ", "")


@query("r1_stream_interval_totals", over_requests("SELECT interval_start, count(*) AS n_lines, CAST(sum(bytes) AS BIGINT) AS bytes, count_if(substr(status, 1, 1) IN ('4', '5')) AS errors FROM r GROUP BY 1"))
def _(spark, d):
    return _result(spark, S.stream_interval_totals(request_stream(spark, d), "1 hour", "1 hour"))


@query("r2_stream_key_counts", over_requests(KEYS + ", st AS (SELECT DISTINCT interval_no, interval_start FROM r) SELECT interval_start, stream, key, hits, bytes FROM ki JOIN st USING (interval_no)"))
def _(spark, d):
    return _result(spark, S.stream_key_counts(S.stream_key_hits(request_stream(spark, d)), "1 hour", "1 hour"))


@query("r4_stream_sessions", over_requests(", g AS (SELECT ip, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY ip ORDER BY ts) + INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS new FROM r), i AS (SELECT ip, ts, sum(new) OVER (PARTITION BY ip ORDER BY ts) AS island FROM g) SELECT ip, min(ts) AS first_seen, max(ts) + INTERVAL 90 MINUTE AS ends, count(*) AS hits FROM i GROUP BY ip, island"))
def _(spark, d):
    return _result(spark, S.stream_sessions(request_stream(spark, d), "90 minutes", "1 hour"))


@query("r5_stream_ip_memory", over_requests(CLAIMED + " SELECT name, ip, start FROM m"))
def _(spark, d):
    return _result(spark, S.stream_ip_memory(R.claim_lines(R.match_rules(request_stream(spark, d), rules(spark)))))


@query("r5_stream_rule_memory", over_requests(CLAIMED + f" SELECT name, 'compete' AS lane, ip, start FROM m UNION ALL SELECT 'mailed', 'observe', ip, min(line_id) FROM r WHERE {_HIT['mailed']} GROUP BY ip UNION ALL SELECT 'orgs', 'observe', ip, min(line_id) FROM r WHERE {_HIT['orgs']} GROUP BY ip"))
def _(spark, d):
    return _result(spark, S.stream_rule_memory(R.claim_lines(R.match_rules(request_stream(spark, d), rules(spark)))), conf=S.ROCKS)


@query("r11_sliding_flux", over_requests(", x AS (SELECT interval_start - to_hours(k) AS span_start FROM r, (SELECT unnest([0, 1, 2, 3]) AS k)) SELECT span_start, span_start + INTERVAL 4 HOUR AS span_end, count(*) AS flux FROM x GROUP BY 1"))
def _(spark, d):
    return _result(spark, S.sliding_flux(request_stream(spark, d), "4 hours", "1 hour", "1 hour"))


@query("r3_stream_key_retention", over_requests(KEYS + " SELECT stream, key, interval_no, island_start, hits, depth, history_total, history_peak, prime_flux FROM ks"))
def _(spark, d):
    keys = key_intervals(spark, d).select("stream", "key", "interval_no", "hits", F.timestamp_seconds((F.col("interval_no") + 1) * 3600).alias("ts"))
    retained = lambda s: S.stream_key_retention(s, {"words": 1, "refs": 1, "ips": 2}, 3600)
    return S.run_in_parts(spark, keys, "interval_no", retained, "retention", conf=S.ROCKS)


@query("r6_stream_alerts", over_requests(CLAIMED + _DENSE + " SELECT lane, direction, threshold, interval_no, value, CASE WHEN active THEN 'triggered' ELSE 'recovered' END AS event FROM tr WHERE active <> was"))
def _(spark, d):
    dense = C.dense_lanes(lane_table(spark, d), totals(spark, d))
    return _result(spark, S.stream_alerts(S.replay(spark, dense, "interval_no"), alert_rules(spark), 3), "append")


_COUNTS = TOTALS + ", sh AS (SELECT * FROM t), pr AS (SELECT *, " + ", ".join(f"lag({c}) OVER (ORDER BY interval_no) AS {c}0" for c in ("n_lines", "bytes", "errors")) + " FROM t)"


@query("r7_stream_change", over_requests(_COUNTS + _scores("", "pr", {k: v for k, v in _PARTS.items() if k in ("lines", "bytes", "errs")}) + " SELECT * FROM cs"))
def _(spark, d):
    return S.stream_change(spark, S.replay(spark, totals(spark, d), "interval_no"), S.shared_folder(spark, "change"))


@query("r7_stream_change_full", over_requests(_FULL + _WIDE + _scores(_WITH_DIST, "pr") + " SELECT * FROM cs"))
def _(spark, d):
    """All eight components; each interval's row carries what its distributions consist of."""
    inputs = input_keys(spark, d).groupBy("interval_no").agg(F.collect_list(F.struct("stream", "key", "hits")).alias("inputs"))
    shapes = shape(spark, d).join(inputs, "interval_no", "left")
    return S.stream_change(spark, S.replay(spark, shapes, "interval_no"), S.shared_folder(spark, "change"))


@query("r8_stream_rules", over_requests(CLAIMED + " SELECT line_id, claim FROM c"))
def _(spark, d):
    folder = S.shared_folder(spark, "rules")
    rules(spark).write.parquet(f"{folder}/table")
    return S.stream_rules(request_stream(spark, d), f"{folder}/table", folder)


@query("r8_stream_rules_change", over_requests(CLAIMED + f", h AS (SELECT CAST(floor(avg(line_id)) AS BIGINT) AS half FROM r) SELECT line_id, CASE WHEN line_id > half AND status = '404' THEN 'lost' WHEN line_id > half THEN {_CLAIM_WITHOUT_ERRORS} ELSE claim END AS claim FROM c, h"))
def _(spark, d):
    """From the middle line on, errors is no rule any more and lost is the first one: the table changes after the first part has run."""
    folder = S.shared_folder(spark, "rules")
    r = render_line(requests_view(spark, d))
    half = r.agg(F.floor(F.avg("line_id"))).first()[0] or 0
    old = rules(spark)
    lost = spark.createDataFrame([("lost", -1, "compete", "code", ["404"], half + 1, None)], old.schema)
    new = old.withColumn("valid_to", F.when(F.col("name") == "errors", half + 1).otherwise(F.col("valid_to"))).unionByName(lost)
    out = None
    for table, part in ((old, r.where(F.col("line_id") <= half)), (new, r.where(F.col("line_id") > half))):
        table.write.mode("overwrite").parquet(f"{folder}/table")
        part.write.mode("append").parquet(f"{folder}/source")
        out = S.stream_rules(spark.readStream.schema(r.schema).parquet(f"{folder}/source"), f"{folder}/table", folder)
    return out


@query("r9_stream_log_sink", over_requests(TOTALS + " SELECT interval_no, n_lines, bytes, errors FROM t"))
def _(spark, d):
    folder = S.shared_folder(spark, "sink")
    t = totals(spark, d)
    S.write_intervals(S.replay(spark, t, "interval_no"), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(t.schema).json(f"{folder}/log").select(*t.columns)


_LOG = _DENSE + """, al AS (SELECT interval_no, lane, direction, threshold, value, CASE WHEN active THEN 'triggered' ELSE 'recovered' END AS event FROM tr WHERE active <> was)"""


@query("r9_stream_log_alerts", over_requests(CLAIMED + TOTALS + _LOG + " SELECT interval_no, 0 AS place, 'interval' AS kind, NULL AS lane, NULL AS direction, NULL AS threshold, coalesce(n_lines, 0) AS value, NULL AS event FROM (SELECT DISTINCT interval_no FROM g) n LEFT JOIN t USING (interval_no) UNION ALL SELECT interval_no, row_number() OVER (PARTITION BY interval_no ORDER BY lane, direction, threshold), 'alert', lane, direction, threshold, value, event FROM al"))
def _(spark, d):
    t = written(totals(spark, d), "totals")
    values = C.dense_lanes(lane_table(spark, d), t).groupBy("interval_no").agg(F.map_from_entries(F.collect_list(F.struct("lane", "value"))).alias("values"))
    lines = t.select("interval_no", "n_lines")  # intervals without lines are closed too
    rows = values.join(lines, "interval_no", "left").select("interval_no", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "values")
    return S.write_log(S.replay(spark, rows, "interval_no"), alert_rules(spark), S.shared_folder(spark, "log"))
