"""Queries: change scores, distributions, alerts, peaks, promoted bots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import change as C
from ..operators import intervals as I
from ..operators import keys as K
from ..operators import rules as R
from ..sources.shared import written
from ..sources.tables_view import hourly_requests
from .common import over_requests, query
from .keys import CANDIDATES, KEYS, MAXIMA, _silent, _state, agent_islands, candidates, key_intervals
from .requests import CLAIMED, COMPETE, TOTALS, known, lanes, totals


def _soft(x, h):
    return f"(CASE WHEN {x} > 0 THEN 100 * ({x}) * ({x}) / (({x}) * ({x}) + {h} * {h}) ELSE 0.0 END)"


def _rel(a, b, floor, h):
    return _soft(f"abs({a} - {b}) / greatest(abs({a}), abs({b}), {float(floor)})", h)


SHAPE = TOTALS + """, mk AS (SELECT interval_no, count(mark) AS marked FROM k GROUP BY 1), b6 AS (SELECT interval_no, count_if(len(ua_tokens) = 16) AS b16 FROM r GROUP BY 1),
sh AS (SELECT t.interval_no, n_lines, bytes, errors, bytes / n_lines AS mean_bytes, 100 * marked / n_lines AS marked_pct, 100 * b16 / n_lines AS b16_pct FROM t JOIN mk ON mk.interval_no = t.interval_no JOIN b6 ON b6.interval_no = t.interval_no),
pr AS (SELECT *, """ + ", ".join(f"lag({c}) OVER (ORDER BY interval_no) AS {c}0" for c in ("n_lines", "bytes", "errors", "mean_bytes", "marked_pct", "b16_pct")) + " FROM sh)"
DIST = """, s0 AS (SELECT stream, key, interval_no, hits / sum(hits) OVER (PARTITION BY stream, interval_no) AS share FROM ki),
sg AS (SELECT stream, key, interval_no, share, 1 AS side FROM s0 UNION ALL SELECT stream, key, interval_no + 1, -share, -1 FROM s0),
sk AS (SELECT stream, interval_no, key, sum(share) AS moved, max(side) AS n, min(side) AS o FROM sg GROUP BY ALL),
dd AS (SELECT stream, interval_no, CASE WHEN max(n) = 1 AND min(o) = -1 THEN sum(abs(moved)) / 2 ELSE 1.0 END AS distance FROM sk GROUP BY ALL)"""
_PARTS = {
    "lines": _rel("n_lines0", "n_lines", 100, 0.25), "bytes": _rel("bytes0", "bytes", 1048576, 0.25), "avg bytes/line": _rel("mean_bytes0", "mean_bytes", 128, 0.25),
    "errs": _rel("errors0", "errors", 10, 0.5), "marked": _soft("abs(marked_pct0 - marked_pct)", 4), "b16": _soft("abs(b16_pct0 - b16_pct)", 12),
}


def _scores(more: str, source: str, parts: dict | None = None) -> str:
    rows = " UNION ALL ".join(f"SELECT interval_no, '{k}' AS key, {i} AS place, {e} AS score FROM {source} WHERE n_lines0 IS NOT NULL" for i, (k, e) in enumerate((parts or _PARTS).items()))
    return f""", pc AS ({rows}{more}), rk AS (SELECT *, row_number() OVER (PARTITION BY interval_no ORDER BY score DESC, place) AS rn FROM pc),
w AS (SELECT interval_no, max(CASE WHEN rn = 1 THEN score END) AS p, max(CASE WHEN rn = 2 THEN score END) AS s, max(CASE WHEN rn = 3 THEN score END) AS q, max(CASE WHEN rn = 1 THEN key END) AS prim FROM rk GROUP BY 1),
cs AS (SELECT sh.interval_no, CASE WHEN p IS NOT NULL THEN round(least(100.0, p + (100 - p) * (0.15 * s / 100 + 0.05 * q / 100)) * least(100.0, p + (100 - p) * (0.15 * s / 100 + 0.05 * q / 100)) / 100, 6) END AS score, prim AS "primary" FROM sh LEFT JOIN w ON w.interval_no = sh.interval_no)"""


def shape(spark, d):
    k = written(R.mark_lines(known(spark, d)).select("interval_no", "bytes", "status", "ua_token_count", "mark"), "marked")  # three aggregates read these lines
    return C.change_shape(I.interval_totals(k), I.marked_share(k), I.token_band_breakdown(k))


@query("c1_c2_soft_scores", over_requests(TOTALS + f", p AS (SELECT interval_no, n_lines, bytes, lag(n_lines) OVER (ORDER BY interval_no) AS n0, lag(bytes) OVER (ORDER BY interval_no) AS b0 FROM t) SELECT interval_no, round({_rel('n0', 'n_lines', 10, 0.25)}, 6) AS lines_score, round({_soft('abs(n0 - n_lines)', 4)}, 6) AS points_score FROM p WHERE n0 IS NOT NULL"))
def _(spark, d):
    from pyspark.sql import Window

    t = totals(spark, d).withColumn("n0", F.lag("n_lines").over(Window.orderBy("interval_no"))).where("n0 is not null")
    return t.select("interval_no", F.round(V.relative_change(F.col("n0"), F.col("n_lines"), 10, 0.25), 6).alias("lines_score"), F.round(V.point_change(F.col("n0"), F.col("n_lines"), 4), 6).alias("points_score"))


@query("c3_distribution_distance", over_requests(KEYS + DIST + " SELECT stream, interval_no, round(distance, 6) AS distance FROM dd"))
def _(spark, d):
    return C.distribution_distance(key_intervals(spark, d)).withColumn("distance", F.round("distance", 6))


@query("c4_change_scores", over_requests(CLAIMED + SHAPE + _scores("", "pr") + " SELECT * FROM cs"))
def _(spark, d):
    return C.change_scores(shape(spark, d)).select("interval_no", "score", "primary")


@query("c6_change_reset", over_requests(TOTALS + ", pl AS (SELECT interval_no, row_number() OVER (ORDER BY interval_no) AS place FROM t), pu AS (SELECT *, CASE WHEN interval_no % 50 = 7 THEN place END AS pp FROM pl) SELECT interval_no, coalesce(place - max(pp) OVER (ORDER BY interval_no) < 2, FALSE) AS reset FROM pu"))
def _(spark, d):
    t = totals(spark, d).select("interval_no")
    return C.change_reset(t, t.where("interval_no % 50 = 7"))


@query("c7_change_threshold", over_requests(CLAIMED + SHAPE + _scores("", "pr") + " SELECT interval_no, score FROM cs WHERE round(score) >= 30"))
def _(spark, d):
    return C.above_threshold(C.change_scores(shape(spark, d)), 30).select("interval_no", "score")


_ALERTS = [("errors", "above", 2), ("net1", "above", 3), ("bots", "below", 2), ("host", "above", 1)]
_DENSE = f""", g AS (SELECT n.name AS lane, x.interval_no FROM (SELECT DISTINCT name FROM lanes) n, (SELECT unnest(range(0, (SELECT max(interval_no) + 1 FROM r))) AS interval_no) x),
dl AS (SELECT g.lane, g.interval_no, coalesce(hits, 0) AS value FROM g LEFT JOIN lanes l ON l.name = g.lane AND l.interval_no = g.interval_no),
ar(lane, direction, threshold) AS (VALUES {', '.join(map(str, _ALERTS))}),
h AS (SELECT dl.lane, direction, threshold, interval_no, value, CASE WHEN direction = 'above' THEN value >= threshold ELSE value < threshold END AS hit FROM dl JOIN ar ON ar.lane = dl.lane),
h1 AS (SELECT *, CASE WHEN hit = lag(hit) OVER (PARTITION BY lane, direction ORDER BY interval_no) THEN 0 ELSE 1 END AS turn FROM h),
h2 AS (SELECT *, sum(turn) OVER (PARTITION BY lane, direction ORDER BY interval_no) AS run FROM h1),
h3 AS (SELECT *, row_number() OVER (PARTITION BY lane, direction, run ORDER BY interval_no) AS streak FROM h2),
st AS (SELECT *, coalesce(last_value(CASE WHEN streak >= 3 THEN hit END IGNORE NULLS) OVER (PARTITION BY lane, direction ORDER BY interval_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS active FROM h3),
tr AS (SELECT *, coalesce(lag(active) OVER (PARTITION BY lane, direction ORDER BY interval_no), FALSE) AS was FROM st)"""


def alert_rules(spark):
    return spark.createDataFrame(_ALERTS, "lane string, direction string, threshold long")


def lane_table(spark, d):
    """lanes, computed once: for the names and for the counts."""
    return written(lanes(spark, d), "lanes")


def states(spark, d):
    return C.alert_states(alert_rules(spark), C.dense_lanes(lane_table(spark, d), totals(spark, d)), 3)


@query("c8_alert_transitions", over_requests(CLAIMED + _DENSE + " SELECT lane, direction, threshold, interval_no, value, CASE WHEN active THEN 'triggered' ELSE 'recovered' END AS event FROM tr WHERE active <> was"))
def _(spark, d):
    return C.alert_transitions(states(spark, d))


@query("c9_alert_rule_check", over_requests(CLAIMED + ", ar AS (SELECT name AS lane, 'above' AS direction, max(hits) - 3 AS threshold FROM lanes GROUP BY name UNION ALL SELECT name, 'below', min(hits) - 1 FROM lanes GROUP BY name), u AS (SELECT lane, min(threshold) AS upper FROM ar WHERE direction = 'above' GROUP BY lane) SELECT ar.lane, direction, threshold, CASE WHEN threshold < 0 THEN 'negative' WHEN direction = 'below' AND threshold < 1 THEN 'below 1' ELSE 'below exceeds above' END AS reason FROM ar JOIN u ON u.lane = ar.lane WHERE threshold < 0 OR direction = 'below' AND (threshold < 1 OR threshold > upper)"))
def _(spark, d):
    g = lanes(spark, d).groupBy(F.col("name").alias("lane"))
    rules = g.agg((F.max("hits") - 3).alias("threshold")).withColumn("direction", F.lit("above")).unionByName(g.agg((F.min("hits") - 1).alias("threshold")).withColumn("direction", F.lit("below")))
    return C.check_alert_rules(rules)[1]


@query("c10_active_alerts", over_requests(CLAIMED + _DENSE + ", la AS (SELECT *, row_number() OVER (PARTITION BY lane, direction ORDER BY interval_no DESC) AS back FROM st) SELECT lane, direction, threshold, value FROM la WHERE back = 1 AND active"))
def _(spark, d):
    return C.active_alerts(states(spark, d))


#: Peak lists: each key's hits in runs without more than 15 empty intervals; the strongest candidates of each interval enter the places
#: that are free, walked interval by interval.
PEAKS = CANDIDATES + """, hn AS (SELECT stream, key, interval_no, lead(interval_no) OVER (PARTITION BY stream, key ORDER BY interval_no) AS nx FROM ki),
he AS (SELECT *, CASE WHEN nx IS NULL OR nx - interval_no > 15 THEN interval_no + 15 END AS ends FROM hn),
hu AS (SELECT stream, key, interval_no, first_value(ends IGNORE NULLS) OVER (PARTITION BY stream, key ORDER BY interval_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS until FROM he),
cl AS MATERIALIZED (SELECT pcd.stream, pcd.interval_no, list({'key': pcd.key, 'until': until} ORDER BY strength DESC, pcd.key) AS cs, row_number() OVER (PARTITION BY pcd.stream ORDER BY pcd.interval_no) AS step FROM pcd JOIN hu ON hu.stream = pcd.stream AND hu.key = pcd.key AND hu.interval_no = pcd.interval_no GROUP BY pcd.stream, pcd.interval_no),
wk AS MATERIALIZED (WITH RECURSIVE walk AS (SELECT stream, step, interval_no, cs[1:5] AS entered, cs[1:5] AS held, len(cs) - len(cs[1:5]) AS contention FROM cl WHERE step = 1
 UNION ALL SELECT stream, step, interval_no, wanted[1:5 - len(stay)], list_concat(stay, wanted[1:5 - len(stay)]), len(wanted) - len(wanted[1:5 - len(stay)]) FROM (
  SELECT *, list_filter(cs, lambda c: NOT list_contains(list_transform(stay, lambda m: m.key), c.key)) AS wanted FROM (
   SELECT cl.stream, cl.step, cl.interval_no, cl.cs, list_filter(walk.held, lambda m: m.until > cl.interval_no) AS stay FROM walk JOIN cl ON cl.stream = walk.stream AND cl.step = walk.step + 1))) SELECT * FROM walk),
sp AS (SELECT stream, interval_no AS first, unnest(entered, recursive := true) FROM wk),
pm AS (SELECT sp.stream, sp.key, n.interval_no FROM sp JOIN (SELECT unnest(range((SELECT max(interval_no) + 1 FROM r))) AS interval_no) n ON n.interval_no >= first AND n.interval_no < until),
pk AS (SELECT pm.stream, pm.interval_no, pm.key, CAST(coalesce(contention, 0) AS BIGINT) AS contention FROM pm LEFT JOIN wk ON wk.stream = pm.stream AND wk.interval_no = pm.interval_no)"""
#: What an interval's distributions consist of: peaks before its close, and of the first 25 words those that are none.
INPUTS = PEAKS + _silent("il", "ia") + _state("ia", "ka") + """, pb AS (SELECT stream, key, interval_no + 1 AS interval_no FROM pm),
wv AS (SELECT key, interval_no, hits, score, place FROM (SELECT *, row_number() OVER (PARTITION BY stream, interval_no ORDER BY score DESC, key) AS place FROM ka WHERE stream = 'words' QUALIFY place <= 25) w ANTI JOIN (SELECT * FROM pb WHERE stream = 'words') p ON p.key = w.key AND p.interval_no = w.interval_no),
ci AS (SELECT ki.stream, ki.key, ki.interval_no, ki.hits FROM ki SEMI JOIN pb ON pb.stream = ki.stream AND pb.key = ki.key AND pb.interval_no = ki.interval_no UNION ALL SELECT 'wave', key, interval_no, hits FROM wv WHERE hits > 0)"""


def _peak_parts(spark, d):
    """(rows of keys with hits, spells in the peak lists, the last interval); the rows are computed once."""
    rows = written(agent_islands(spark, d), "key-islands")
    return rows, C.peak_spells(rows, candidates(spark, d, rows), 5, 15), rows.agg(F.max("interval_no").alias("last_no"))


def peaks(spark, d):
    rows = written(agent_islands(spark, d), "key-islands")
    return C.peak_lifecycle(rows, written(candidates(spark, d, rows), "candidates"), 5, 15)


@query("w12_peak_lifecycle", over_requests(PEAKS + " SELECT stream, interval_no, key, contention FROM pk"))
def _(spark, d):
    return peaks(spark, d)


@query("w20_peak_counts", over_requests(PEAKS + ", n AS (SELECT stream, interval_no, count(*) AS members FROM pk GROUP BY ALL) SELECT stream, interval_no, members, round(avg(members) OVER (PARTITION BY stream ORDER BY interval_no RANGE BETWEEN 79 PRECEDING AND CURRENT ROW), 6) AS mean_members FROM n"))
def _(spark, d):
    return C.peak_counts(peaks(spark, d))


def _ranked(rows):
    return K.rank_keys(K.with_scores(K.key_state(K.with_silent(rows.drop("agent_delta"), 5, 60))))


@query("j8_c5_word_wave", over_requests(INPUTS + " SELECT key, interval_no, score, place FROM wv"))
def _(spark, d):
    rows, spells, last = _peak_parts(spark, d)
    return C.word_wave(_ranked(rows), C.members_before(spells, last)).select("key", "interval_no", "score", "place")


_FULL = CLAIMED + INPUTS + SHAPE.removeprefix(TOTALS) + DIST.replace("FROM ki)", "FROM ci)")
_WITH_DIST = f" UNION ALL SELECT pr.interval_no, 'peak balance', 6, greatest({_soft('coalesce(wd.words, 0.0)', 0.10)}, 0.80 * {_soft('coalesce(wd.refs, 0.0)', 0.12)}, 0.40 * {_soft('coalesce(wd.ips, 0.0)', 0.25)}) FROM pr LEFT JOIN wd ON wd.interval_no = pr.interval_no WHERE n_lines0 IS NOT NULL UNION ALL SELECT pr.interval_no, 'word wave', 7, 0.75 * {_soft('coalesce(wd.wave, 0.0)', 0.30)} FROM pr LEFT JOIN wd ON wd.interval_no = pr.interval_no WHERE n_lines0 IS NOT NULL"
_WIDE = ", wd AS (SELECT interval_no, " + ", ".join(f"max(CASE WHEN stream = '{p}' THEN distance END) AS {p}" for p in ("words", "refs", "ips", "wave")) + " FROM dd GROUP BY 1)"


def input_keys(spark, d):
    """(stream, key, interval_no, hits) of the peaks of the three streams and of the wave."""
    rows, spells, last = _peak_parts(spark, d)
    return C.change_inputs(_ranked(rows), rows, C.members_before(spells, last))


def input_distances(spark, d):
    """(part, interval_no, distance) of the peaks of the three streams and of the wave."""
    return C.distribution_distance(input_keys(spark, d)).select(F.col("stream").alias("part"), "interval_no", "distance")


@query("c5_change_inputs", over_requests(_FULL + " SELECT stream AS part, interval_no, round(distance, 6) AS distance FROM dd"))
def _(spark, d):
    return input_distances(spark, d).withColumn("distance", F.round("distance", 6))


@query("c4_c5_change_scores_full", over_requests(_FULL + _WIDE + _scores(_WITH_DIST, "pr") + " SELECT * FROM cs"))
def _(spark, d):
    return C.change_scores(shape(spark, d), input_distances(spark, d)).select("interval_no", "score", "primary")


#: Bot names promoted interval by interval: each step takes what is left of an interval's names and hands on those done.
_PROMOTED = """, ly AS (SELECT lp.interval_no, coalesce(max(hits), 0) AS top, avg(peak) AS bound FROM lp LEFT JOIN lanes ON lanes.name = lp.name AND lanes.interval_no = lp.interval_no GROUP BY lp.interval_no),
bk AS (SELECT interval_no, list_filter(ua_tokens, lambda t: regexp_matches(t, '(?i).(bot|spider|crawler|agent)$'))[1] AS key FROM r WHERE regexp_matches(user_agent, '(?i)bot|spider|crawler|agent')),
bh AS (SELECT interval_no, key, count(*) AS hits FROM bk WHERE key IS NOT NULL GROUP BY ALL),
bl AS MATERIALIZED (SELECT bh.interval_no, row_number() OVER (ORDER BY bh.interval_no) AS step, list({'key': key, 'hits': hits} ORDER BY hits DESC, key) AS names, coalesce(any_value(ly.top), 0) AS top, coalesce(any_value(ly.bound), 0.0) AS bound FROM bh LEFT JOIN ly ON ly.interval_no = bh.interval_no GROUP BY bh.interval_no),
bw AS (WITH RECURSIVE walk AS (SELECT CAST(0 AS BIGINT) AS step, CAST(-1 AS BIGINT) AS interval_no, CAST([] AS STRUCT(key VARCHAR, hits BIGINT)[]) AS got, CAST([] AS VARCHAR[]) AS done
 UNION ALL SELECT step, interval_no, got, list_concat(done, list_transform(got, lambda g: g.key)) FROM (
  SELECT *, CASE WHEN own[1] IS NULL OR top >= total OR own[1].hits < bound THEN own[1:0] WHEN step > 1 OR own[2] IS NULL OR own[2].hits < CASE WHEN bound > 0 THEN bound ELSE (total - own[1].hits) // 4 END THEN own[1:1]
   WHEN own[3] IS NULL OR own[3].hits < CASE WHEN bound > 0 THEN bound ELSE (total - own[1].hits - own[2].hits) // 4 END THEN own[1:2] ELSE own[1:3] END AS got FROM (
   SELECT *, coalesce(CAST(list_sum(list_transform(own, lambda x: x.hits)) AS BIGINT), 0) AS total FROM (
    SELECT bl.step, bl.interval_no, bl.top, bl.bound, walk.done, list_filter(bl.names, lambda x: NOT list_contains(walk.done, x.key)) AS own FROM walk JOIN bl ON bl.step = walk.step + 1)))) SELECT * FROM walk),
bp AS (SELECT interval_no, unnest(got, recursive := true) FROM bw)"""


@query("w17_promote_bots", over_requests(CLAIMED + TOTALS + MAXIMA + _PROMOTED + " SELECT key AS name, interval_no + 1 AS valid_from, hits FROM bp"))
def _(spark, d):
    bots = R.bot_keys(hourly_requests(spark, d)).groupBy("interval_no", "key").agg(F.count("*").alias("hits"))
    return C.promote_bots(bots, C.lane_maxima(lane_table(spark, d), COMPETE, totals(spark, d)))


@query("j4_compare_lanes", over_requests(CLAIMED + ", x AS (SELECT name, hits, row_number() OVER (ORDER BY hits DESC, name) AS place FROM lanes WHERE interval_no = 30), y AS (SELECT name, hits, row_number() OVER (ORDER BY hits DESC, name) AS place FROM lanes WHERE interval_no = 60) SELECT coalesce(x.name, y.name) AS name, x.hits AS hits_a, y.hits AS hits_b, x.place AS place_a, y.place AS place_b, coalesce(y.hits, 0) - coalesce(x.hits, 0) AS delta FROM x FULL OUTER JOIN y ON x.name = y.name"))
def _(spark, d):
    from ..operators.interval_log import compare_lanes

    return compare_lanes(lanes(spark, d), 30, 60)


@query("j5_compare_intervals", over_requests(CLAIMED + SHAPE + " SELECT a.interval_no AS interval_a, b.interval_no AS interval_b, b.n_lines - a.n_lines AS lines_delta, b.bytes - a.bytes AS bytes_delta, b.errors - a.errors AS errors_delta, round(b.marked_pct - a.marked_pct, 6) AS marked_delta, round(b.b16_pct - a.b16_pct, 6) AS b16_delta FROM sh a JOIN sh b ON b.interval_no = a.interval_no + 24"))
def _(spark, d):
    from ..operators.interval_log import compare_intervals

    return compare_intervals(shape(spark, d), 24)
