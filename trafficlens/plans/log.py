"""Queries: the interval log written from the given tables, read back and questioned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import change as C
from ..operators import interval_log as L
from ..operators import intervals as I
from ..operators import keys as K
from ..operators import rules as R
from ..sources.shared import shared_folder, written
from ..sources.tables_view import hourly_requests
from .change import _DENSE, INPUTS, SHAPE, alert_rules
from .common import over_requests, query
from .keys import KEYS, agent_islands, candidates
from .requests import CLAIMED, TOTALS, claimed, known

SESSION = 240  # intervals of one session


def log_lines(spark, d) -> DataFrame:
    """(line_no, value): session starts, purge commands, intervals, alerts, and some damaged and blank lines, in file order."""
    # every part below reads these lines
    k = written(known(spark, d).select("line_id", "interval_no", "interval_start", "ip", "bytes", "status", "request", "referer", "ua_tokens", "claim", "claim_rank", "known"), "known")
    t, lane = written(I.interval_totals(k), "totals"), written(I.lane_intervals(I.lane_hits(k)), "lanes")
    full = I.running_totals(t).join(t.select("interval_no", "errors"), "interval_no")
    scored = K.with_scores(K.key_state(K.retention_islands(K.key_intervals(K.key_hits(k)))))
    rec = L.interval_records(full, lane, K.rank_keys(scored, 10), _session(), k.select("interval_no", "interval_start").distinct())
    lines = rec.select((F.col("interval") * 10 + 2).alias("line_no"), F.to_json(F.struct(*rec.columns)).alias("value"))
    return lines.unionByName(event_lines(t.select("interval_no"), C.alert_states(alert_rules(spark), C.dense_lanes(lane, t), 3)))


def _session():
    return F.concat(F.lit("s"), F.floor(F.col("interval_no") / SESSION).cast("string"))


def event_lines(number: DataFrame, alert_states: DataFrame) -> DataFrame:
    """The lines beside the intervals. number: (interval_no)."""
    session = _session()
    event = lambda kind, **more: F.to_json(F.struct(F.lit(4).alias("schema_version"), F.lit(kind).alias("event_type"), session.alias("session_id"), *(F.lit(v).alias(k) for k, v in more.items())))
    first = number.groupBy(F.floor(F.col("interval_no") / SESSION)).agg(F.min("interval_no").alias("interval_no"))
    rows = first.select((F.col("interval_no") * 10).alias("line_no"), event("session_start").alias("value"))
    rows = rows.unionByName(number.where("interval_no % 50 = 7").select((F.col("interval_no") * 10 + 1).alias("line_no"), event("command", command_name="purge", status="applied").alias("value")))
    rows = rows.unionByName(number.where("interval_no % 101 = 0").select((F.col("interval_no") * 10 + 9).alias("line_no"), F.lit('{"schema_version": 4, "event').alias("value")))
    rows = rows.unionByName(number.where("interval_no % 103 = 0").select((F.col("interval_no") * 10 + 8).alias("line_no"), F.lit("  ").alias("value")))
    a = C.alert_transitions(alert_states).withColumn("place", F.expr("dense_rank() over (partition by interval_no order by lane, direction)"))
    s = a.select((F.col("interval_no") * 10 + 2 + F.col("place")).alias("line_no"), F.to_json(F.struct(F.lit(4).alias("schema_version"), F.lit("alert").alias("event_type"), session.alias("session_id"), F.col("interval_no").alias("interval"), F.col("lane").alias("matcher"), "direction", "value", "threshold", F.col("event").alias("status"))).alias("value"))
    return rows.unionByName(s)


def records(spark, d) -> DataFrame:
    return L.parse_interval_log(log_lines(spark, d))[0]


_ROWS = CLAIMED + _DENSE + TOTALS + f""", ev AS (SELECT DISTINCT interval_no * 10 + 2 AS line_no, 'interval' AS event_type, interval_no FROM t
 UNION ALL SELECT min(interval_no) * 10, 'session_start', min(interval_no) FROM t GROUP BY interval_no // {SESSION}
 UNION ALL SELECT interval_no * 10 + 1, 'command', interval_no FROM t WHERE interval_no % 50 = 7
 UNION ALL SELECT interval_no * 10 + 2 + dense_rank() OVER (PARTITION BY interval_no ORDER BY lane, direction), 'alert', interval_no FROM tr WHERE active <> was),
lg AS (SELECT line_no, event_type, interval_no, 's' || CAST(interval_no // {SESSION} AS VARCHAR) AS session_id, CASE WHEN event_type IN ('interval', 'alert') THEN interval_no END AS interval FROM ev)"""


@query("a6_a8_v3_flatten_lanes", over_requests(CLAIMED + f" SELECT 's' || CAST(interval_no // {SESSION} AS VARCHAR) AS session_id, interval_no AS interval, name, hits AS interval_count FROM lanes"))
def _(spark, d):
    return L.flatten_lanes(records(spark, d))


@query("a8_issues", over_requests(TOTALS + " SELECT interval_no * 10 + 9 AS line_no, '{\"schema_version\": 4, \"event' AS text FROM t WHERE interval_no % 101 = 0"))
def _(spark, d):
    return L.parse_interval_log(log_lines(spark, d))[1]


@query("a7_event_counts", over_requests(_ROWS + " SELECT session_id, event_type, count(*) AS n_rows FROM lg GROUP BY ALL"))
def _(spark, d):
    return records(spark, d).groupBy("session_id", "event_type").agg(F.count("*").alias("n_rows"))


@query("v1_session_index", over_requests(_ROWS + " SELECT session_id, count(*) AS records, count_if(event_type = 'interval') AS n_intervals, count_if(event_type = 'alert') AS alerts, min(CASE WHEN event_type = 'session_start' THEN line_no END) AS start_line, '4' AS versions FROM lg GROUP BY session_id"))
def _(spark, d):
    return L.session_index(records(spark, d)).drop("first_time", "last_time")


@query("v2_interval_series", over_requests(CLAIMED + TOTALS + f" SELECT 's' || CAST(t.interval_no // {SESSION} AS VARCHAR) AS session_id, t.interval_no AS interval, n_lines AS interval_lines, CAST(sum(t.bytes) OVER (ORDER BY t.interval_no) AS BIGINT) AS total_bytes, errors, l.hits AS lane_count FROM t LEFT JOIN lanes l ON l.interval_no = t.interval_no AND l.name = 'net1'"))
def _(spark, d):
    return L.interval_series(records(spark, d), "net1")


_FLAT = KEYS + f", fk AS (SELECT 's' || CAST(interval_no // {SESSION} AS VARCHAR) AS session_id, interval_no AS interval, interval_no * 10 + 2 AS line_no, stream, key, score, row_number() OVER (PARTITION BY stream, interval_no ORDER BY score DESC, key) AS rank FROM ks QUALIFY rank <= 10)"


@query("v3_flatten_keys", over_requests(_FLAT + " SELECT * FROM fk"))
def _(spark, d):
    return L.flatten_keys(records(spark, d))


@query("v4_track_key", over_requests(_FLAT + TOTALS + f" SELECT 's' || CAST(t.interval_no // {SESSION} AS VARCHAR) AS session_id, t.interval_no AS interval, score FROM t LEFT JOIN fk ON fk.interval = t.interval_no AND stream = 'words' AND key = 'Googlebot'"))
def _(spark, d):
    return L.track_key(records(spark, d), "words", "Googlebot")


_NOTES = ", nt AS (SELECT line_no, event_type, session_id, first_value(CASE WHEN event_type = 'interval' THEN interval END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS owner FROM lg)"


@query("j7_notes_to_interval", over_requests(_ROWS + _NOTES + " SELECT line_no, session_id, 'purge' AS command_name, owner AS interval FROM nt WHERE event_type = 'command'"))
def _(spark, d):
    return L.notes_to_interval(records(spark, d))


_HITS = _NOTES + ", fd AS (SELECT session_id, interval, line_no, stream AS kind, key AS found FROM fk WHERE contains(lower(key), 'bot') UNION ALL SELECT session_id, owner, line_no, 'note', 'purge' FROM nt WHERE event_type = 'command' AND contains('purge', 'bot'))"


@query("v5_search_log", over_requests(_FLAT + _ROWS + _HITS + " SELECT * FROM fd"))
def _(spark, d):
    return L.search_log(records(spark, d), "BOT")


@query("v6_search_counts", over_requests(_FLAT + _ROWS + _HITS + " SELECT session_id, interval, count(*) AS hits FROM fd GROUP BY ALL"))
def _(spark, d):
    return L.search_counts(L.search_log(records(spark, d), "bot"))


@query("v7_alert_timeline", over_requests(CLAIMED + _DENSE + f" SELECT 's' || CAST(interval_no // {SESSION} AS VARCHAR) AS session_id, interval_no AS interval, count(*) AS alerts, string_agg(lane, ',' ORDER BY lane) AS lanes FROM tr WHERE active <> was GROUP BY interval_no"))
def _(spark, d):
    return L.alert_timeline(records(spark, d))


@query("j6_alerts_by_interval", over_requests(_ROWS + ", al AS (SELECT interval, count(*) AS n FROM lg WHERE event_type = 'alert' GROUP BY 1) SELECT session_id, lg.interval, n_lines AS interval_lines, coalesce(n, 0) AS alerts FROM lg JOIN t ON t.interval_no = lg.interval LEFT JOIN al ON al.interval = lg.interval WHERE event_type = 'interval'"))
def _(spark, d):
    return L.alerts_by_interval(records(spark, d))


_RANGE = _NOTES + ", sl AS (SELECT lg.line_no, lg.event_type, lg.interval FROM lg JOIN nt ON nt.line_no = lg.line_no WHERE lg.session_id = 's1' AND (CASE WHEN lg.event_type = 'alert' THEN lg.interval ELSE owner END BETWEEN 250 AND 300 OR lg.event_type = 'session_start'))"


@query("v8_j9_select_range", over_requests(_ROWS + _RANGE + " SELECT line_no, event_type FROM sl"))
def _(spark, d):
    return L.select_range(records(spark, d), "s1", 250, 300).select("line_no", "event_type")


@query("v9_range_errors", over_requests(", q AS (SELECT count(*) AS n FROM r WHERE interval_no = 100000) SELECT 'missing_end' AS code FROM q WHERE n = 0 UNION ALL SELECT 'missing_start' FROM q WHERE n = 0 UNION ALL SELECT 'reversed' FROM q"))
def _(spark, d):
    return L.range_errors(records(spark, d), "s1", 100001, 100000)


#: Ranges over a log with faults: a second start of s1 inside the range, a repeated interval, a session that never started.
_RANGES = [("s1", 250, 300), ("s1", 300, 250), ("s2", 500, 100000), ("s0", 100, 200), ("s9", 1, 2)]


def _faulty(records: DataFrame) -> DataFrame:
    """The records, those of interval 270 twice, and a start of s1 after interval 260 and of s5 after interval 150."""
    again = records.where("event_type = 'interval' and interval = 270").withColumn("line_no", F.col("line_no") + 6)
    start = records.where("event_type = 'interval' and interval in (150, 260)").withColumn("line_no", F.col("line_no") + 6).withColumn("event_type", F.lit("session_start"))
    start = start.withColumn("session_id", F.when(F.col("interval") == 260, "s1").otherwise("s5")).withColumn("interval", F.lit(None).cast("long"))
    return records.unionByName(again).unionByName(start)


@query("v9_range_errors_of_faults", over_requests(_ROWS + f""", fl AS (SELECT line_no, event_type, session_id, interval FROM lg UNION ALL SELECT line_no + 6, event_type, session_id, interval FROM lg WHERE event_type = 'interval' AND interval = 270
 UNION ALL SELECT line_no + 6, 'session_start', CASE interval WHEN 260 THEN 's1' ELSE 's5' END, NULL FROM lg WHERE event_type = 'interval' AND interval IN (150, 260)),
ra(session, first, last) AS (VALUES {', '.join(map(str, _RANGES))}),
ct AS (SELECT ra.*, (SELECT count(*) FROM fl WHERE session_id = session AND event_type = 'session_start') AS starts, (SELECT count(*) FROM fl WHERE session_id = session AND event_type = 'interval' AND interval = first) AS firsts, (SELECT count(*) FROM fl WHERE session_id = session AND event_type = 'interval' AND interval = last) AS lasts,
 (SELECT count(*) - count(DISTINCT interval) FROM fl WHERE session_id = session AND event_type = 'interval') AS repeats, (SELECT min(line_no) FROM fl WHERE session_id = session AND event_type = 'interval' AND interval = first) AS a, (SELECT max(line_no) FROM fl WHERE session_id = session AND event_type = 'interval' AND interval = last) AS b FROM ra),
cu AS (SELECT ct.*, (SELECT count(*) FROM fl WHERE event_type = 'session_start' AND line_no > a AND line_no < b) AS cuts FROM ct)
""" + " UNION ALL ".join(f"SELECT session, first, last, '{n}' AS code FROM cu WHERE {c}" for n, c in {"missing_session_start": "starts = 0", "duplicate_session_start": "starts > 1", "missing_start": "firsts = 0", "ambiguous_start": "firsts > 1", "missing_end": "lasts = 0", "ambiguous_end": "lasts > 1", "reversed": "first > last OR a > b", "duplicate_interval": "repeats > 0", "session_boundary": "cuts > 0"}.items())))
def _(spark, d):
    log = written(_faulty(records(spark, d)).select("line_no", "event_type", "session_id", "interval"), "log")
    found = [L.range_errors(log, *r).select(*(F.lit(v).cast("string" if i == 0 else "long").alias(n) for i, (n, v) in enumerate(zip(("session", "first", "last"), r, strict=True))), "code") for r in _RANGES]
    return reduce(lambda x, y: x.unionByName(y), found)


_MANIFEST = ["records", "n_intervals", "first_interval", "last_interval", "versions"]


@query("v10_range_manifest", over_requests(_ROWS + _RANGE + " SELECT count(*) AS records, count_if(event_type = 'interval') AS n_intervals, min(CASE WHEN event_type = 'interval' THEN interval END) AS first_interval, max(CASE WHEN event_type = 'interval' THEN interval END) AS last_interval, '4' AS versions FROM sl"))
def _(spark, d):
    return L.range_manifest(L.select_range(records(spark, d), "s1", 250, 300)).select(*_MANIFEST)


@query("v11_validate_range", over_requests(_ROWS + _RANGE + " SELECT 'records' AS field, CAST(count(*) + 1 AS VARCHAR) AS stated, CAST(count(*) AS VARCHAR) AS found FROM sl"))
def _(spark, d):
    s = L.select_range(records(spark, d), "s1", 250, 300)
    return L.validate_range(s, L.range_manifest(s).withColumn("records", F.col("records") + 1))


@query("v12_source_catalog", over_requests(CLAIMED + ", x AS (SELECT interval_no, claim AS name, max(line_id) AS line_id FROM c WHERE claim IS NOT NULL GROUP BY 1, 2) SELECT interval_no, name, line_id, dense_rank() OVER (PARTITION BY interval_no ORDER BY name, line_id) AS ref FROM x"))
def _(spark, d):
    return L.source_catalog(I.lane_examples(claimed(spark, d)))


@query("v13_peak_reset_phases", over_requests(_ROWS + f", pz AS (SELECT *, sum(CASE WHEN event_type = 'command' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no) AS purge FROM lg), pn AS (SELECT *, row_number() OVER (PARTITION BY session_id, purge ORDER BY line_no) AS n FROM pz WHERE event_type = 'interval' AND purge > 0) SELECT session_id, interval, CASE n WHEN 1 THEN 'reset' ELSE 'rebaseline' END AS phase FROM pn WHERE n <= 2"))
def _(spark, d):
    return L.peak_reset_phases(records(spark, d))


def full_log(spark, d) -> tuple[DataFrame, DataFrame]:
    """(records, issues) of the full log: nested records, notes and damaged lines, written as files and read back."""
    k = R.mark_lines(known(spark, d)).withColumn("line", F.when(F.col("status") == "500", F.col("line")))  # only error lines are kept as sources
    # every part below reads these lines
    k = written(k.select("line_id", "interval_no", "interval_start", "ip", "bytes", "status", "request", "referer", "user_agent", "ua_tokens", "ua_token_count", "line", "claim", "claim_rank", "known", "mark"), "marked")
    t = written(I.interval_totals(k), "totals")
    rows = written(agent_islands(spark, d, k), "key-islands")
    last = rows.agg(F.max("interval_no").alias("last_no"))
    spells = C.peak_spells(rows, candidates(spark, d, rows, t), 5, 15)
    retained = written(K.with_scores(K.key_state(K.with_silent(rows, 5, 60))), "retained")
    groups = K.ip_group_history(retained, K.ip_groups(retained, 2, 25))
    interesting = L.stream_records(retained, C.members_before(spells, last).join(F.broadcast(last), F.col("interval_no") <= F.col("last_no")).drop("last_no"), groups, 10)
    hits = written(I.lane_hits(k), "lane-hits")
    system = t.select(F.lit("lines").alias("name"), "interval_no", F.col("n_lines").alias("hits")).unionByName(t.select(F.lit("bytes").alias("name"), "interval_no", F.col("bytes").alias("hits"))).unionByName(t.select(F.lit("errs").alias("name"), "interval_no", F.col("errors").alias("hits")))
    lane = I.lane_intervals(hits).select("name", "interval_no", "hits").unionByName(system)
    marks, bands = I.marked_share(k), I.token_band_breakdown(k)
    keys = I.lane_ip_counts(hits, 25).select("name", "interval_no", F.col("ip").alias("key"), "hits").unionByName(I.status_breakdown(k).select(F.lit("errs").alias("name"), "interval_no", F.col("status").alias("key"), F.col("n_lines").alias("hits")))
    keys = keys.unionByName(marks.where("marked > 0").select(F.lit("lines").alias("name"), "interval_no", F.lit("marked").alias("key"), F.col("marked").alias("hits"))).unionByName(bands.select(F.lit("lines").alias("name"), "interval_no", F.concat(F.lit(" "), "band").alias("key"), F.col("n_lines").alias("hits")))
    matchers = L.lane_records(lane, keys, I.lane_prefix_groups(hits, 3))
    full = I.running_totals(t).join(t.select("interval_no", "errors"), "interval_no").join(marks.select("interval_no", "unmarked"), "interval_no")
    full = full.join(k.select("interval_no", "interval_start").distinct(), "interval_no")
    # an interval of errors keeps its first error line as source
    sources = k.where("status = '500'").groupBy("interval_no").agg(F.array(F.min_by("line", "line_id")).alias("source_lines"))
    rec = L.full_records(full, matchers, interesting, k.groupBy("interval_no", "ua_token_count").agg(F.count("*").alias("n_lines")), sources, _session(), F.col("interval_start"))
    lines = rec.select((F.col("interval") * 10 + 2).alias("line_no"), F.to_json(F.struct(*rec.columns)).alias("value"))
    lines = lines.unionByName(event_lines(t.select("interval_no"), C.alert_states(alert_rules(spark), C.dense_lanes(I.lane_intervals(hits), t), 3)))
    path = shared_folder(spark, "interval-log")
    L.write_lines(lines, path)
    return L.read_interval_log(spark, path)


_FULL_LOG = CLAIMED + _DENSE + INPUTS + SHAPE.removeprefix(TOTALS) + _ROWS.removeprefix(CLAIMED + _DENSE + TOTALS) + f""", ba AS (SELECT interval_no * 10 + 9 AS line_no FROM t WHERE interval_no % 101 = 0 UNION ALL SELECT interval_no * 10 + 8 FROM t WHERE interval_no % 103 = 0),
nu AS (SELECT line_no, row_number() OVER (ORDER BY line_no) AS number FROM (SELECT line_no FROM lg UNION ALL SELECT line_no FROM ba)),
iv AS (SELECT t.*, 's' || CAST(t.interval_no // {SESSION} AS VARCHAR) AS session_id, number AS line_no FROM t JOIN nu ON nu.line_no = t.interval_no * 10 + 2)"""
_FULL_TOP = _FULL_LOG + """, fp AS (SELECT session_id, iv.interval_no AS interval, iv.line_no, pb.stream, pb.key, coalesce(ka.score, 0) AS score, coalesce(ka.hits, 0) AS "count", row_number() OVER (PARTITION BY pb.stream, pb.interval_no ORDER BY ka.score DESC NULLS LAST, pb.key) AS rank
 FROM pb JOIN iv ON iv.interval_no = pb.interval_no LEFT JOIN ka ON ka.stream = pb.stream AND ka.key = pb.key AND ka.interval_no = pb.interval_no)"""
_FULL_GROUPS = _FULL_TOP + """, pg AS (SELECT 'ips' AS owner, interval_no, regexp_extract(key, '^([^.]+\\.[^.]+\\.)', 1) AS prefix, CAST(sum(hits) AS BIGINT) AS "count", count(*) AS members, sum(score) AS weight FROM ka WHERE stream = 'ips' GROUP BY ALL HAVING count(*) >= 2),
hp AS (SELECT name, ip, interval_no, regexp_extract(ip, '^([^.]+\\.[^.]+\\.)', 1) AS prefix, count(*) AS k FROM hits GROUP BY ALL),
hq AS (SELECT *, CASE WHEN interval_no = min(interval_no) OVER (PARTITION BY name, ip) THEN 1 ELSE 0 END AS new FROM hp),
hr AS (SELECT name, prefix, interval_no, sum(k) AS k, sum(new) AS new FROM hq GROUP BY ALL),
hg AS (SELECT name AS owner, prefix, interval_no, CAST(sum(k) OVER w AS BIGINT) AS "count", CAST(sum(new) OVER w AS BIGINT) AS members FROM hr WINDOW w AS (PARTITION BY name, prefix ORDER BY interval_no ROWS UNBOUNDED PRECEDING)),
fg AS (SELECT session_id, iv.interval_no AS interval, line_no, owner, prefix, row_number() OVER (PARTITION BY owner, g.interval_no ORDER BY weight DESC, prefix) AS rank, "count", members FROM (SELECT owner, interval_no, prefix, "count", members, weight FROM pg UNION ALL SELECT owner, interval_no, prefix, "count", members, "count" FROM hg WHERE members >= 3) g JOIN iv ON iv.interval_no = g.interval_no QUALIFY rank <= 25)"""


@query("a8_issues_of_files", over_requests(_FULL_LOG + " SELECT number AS line_no, '{\"schema_version\": 4, \"event' AS text FROM nu WHERE line_no % 10 = 9 AND line_no // 10 % 101 = 0 AND line_no IN (SELECT line_no FROM ba)"))
def _(spark, d):
    return full_log(spark, d)[1]


@query("v3_flatten_peaks", over_requests(_FULL_TOP + " SELECT * FROM fp"))
def _(spark, d):
    return L.flatten_peaks(full_log(spark, d)[0])


@query("v3_flatten_groups", over_requests(_FULL_GROUPS + " SELECT * FROM fg"))
def _(spark, d):
    return L.flatten_groups(full_log(spark, d)[0])


@query("v2_interval_percentages", over_requests(_FULL_LOG + " SELECT session_id, iv.interval_no AS interval, iv.n_lines AS interval_lines, iv.bytes, iv.errors, CASE WHEN marked > 0 THEN round(marked * 100 / iv.n_lines, 6) END AS marked_percent, CASE WHEN b16 > 0 THEN round(b16 * 100 / iv.n_lines, 6) END AS b16_percent FROM iv JOIN mk ON mk.interval_no = iv.interval_no JOIN b6 ON b6.interval_no = iv.interval_no"))
def _(spark, d):
    return L.interval_percentages(full_log(spark, d)[0])


@query("v4_track_lane", over_requests(_FULL_LOG + " SELECT session_id, iv.interval_no AS interval, l.hits AS value FROM iv LEFT JOIN lanes l ON l.interval_no = iv.interval_no AND l.name = 'net1'"))
def _(spark, d):
    return L.track_lane(full_log(spark, d)[0], "net1")


_KEYS10 = ", kt AS (SELECT session_id, iv.interval_no AS interval, iv.line_no, stream AS kind, key AS found FROM (SELECT *, row_number() OVER (PARTITION BY stream, interval_no ORDER BY score DESC, key) AS rank FROM ka QUALIFY rank <= 10) q JOIN iv ON iv.interval_no = q.interval_no)"


@query("v5_search_everything", over_requests(_FULL_GROUPS + _KEYS10 + " SELECT * FROM kt WHERE contains(lower(found), '10.1.') UNION SELECT session_id, interval, line_no, stream, key FROM fp WHERE contains(lower(key), '10.1.') UNION SELECT session_id, interval, line_no, 'prefix', prefix FROM fg WHERE contains(lower(prefix), '10.1.')"))
def _(spark, d):
    return L.search_everything(full_log(spark, d)[0], "10.1.")


@query("v10_range_manifest_full", over_requests(_FULL_LOG + " SELECT (SELECT count(*) FROM lg WHERE session_id = 's1' AND (event_type = 'session_start' OR event_type = 'interval' AND interval BETWEEN 250 AND 300 OR event_type = 'alert' AND interval BETWEEN 250 AND 300 OR event_type = 'command' AND interval_no BETWEEN 250 AND 300)) AS records, count(*) AS n_intervals, count_if(EXISTS (SELECT 1 FROM r WHERE r.interval_no = iv.interval_no AND status = '500')) AS retained_source_intervals, min(interval_no) AS first_interval, max(interval_no) AS last_interval, strftime((SELECT min(interval_start) FROM r WHERE interval_no = (SELECT min(i.interval_no) FROM iv i WHERE i.interval_no BETWEEN 250 AND 300 AND session_id = 's1')), '%Y-%m-%d %H:%M:%S') AS first_time, strftime((SELECT max(interval_start) FROM r WHERE interval_no = (SELECT max(i.interval_no) FROM iv i WHERE i.interval_no BETWEEN 250 AND 300 AND session_id = 's1')), '%Y-%m-%d %H:%M:%S') AS last_time, '4' AS versions FROM iv WHERE session_id = 's1' AND interval_no BETWEEN 250 AND 300"))
def _(spark, d):
    return L.range_manifest(L.select_range(full_log(spark, d)[0], "s1", 250, 300))


@query("u2_union_distinct_keys", over_requests(KEYS + " SELECT interval_no AS until, key FROM ki WHERE stream = 'words' UNION SELECT interval_no + 1, key FROM ki WHERE stream = 'words'"))
def _(spark, d):
    k = K.key_intervals(K.key_hits(hourly_requests(spark, d))).where("stream = 'words'")
    # the keys of each pair of neighbouring intervals, by the later one
    return k.select(F.explode(F.array("interval_no", F.col("interval_no") + 1)).alias("until"), "key").distinct()
