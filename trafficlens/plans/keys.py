"""Queries: key streams, retention, strength, ranks, groups, agent distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import intervals as I
from ..operators import keys as K
from ..operators import rules as R
from ..operators.change import lane_maxima
from ..sources.shared import written
from ..sources.tables_view import hourly_requests
from .common import over_requests, query
from .requests import CLAIMED, COMPETE, REFS, TOTALS, WORDS, known, lanes, totals

_TTL = V.RETENTION[5]
#: Quiet intervals that a key survives, at hourly intervals with the times rescaled from minutes.
_KEEP = "CASE stream WHEN 'words' THEN 1 WHEN 'refs' THEN 1 ELSE 2 END"
KEYS = f""", kh AS (SELECT 'words' AS stream, unnest({WORDS}) AS key, interval_no, line_id, bytes, status FROM r
 UNION ALL SELECT 'refs', unnest({REFS}), interval_no, line_id, bytes, status FROM r UNION ALL SELECT 'ips', ip, interval_no, line_id, bytes, status FROM r),
ki AS (SELECT stream, key, interval_no, count(*) AS hits, CAST(sum(bytes) AS BIGINT) AS bytes, max_by(status, line_id) AS last_status, min(line_id) AS first_line_id, max(line_id) AS last_line_id FROM kh GROUP BY ALL),
il0 AS (SELECT *, interval_no - lag(interval_no) OVER (PARTITION BY stream, key ORDER BY interval_no) AS gap FROM ki),
il AS (SELECT * EXCLUDE (gap), max(CASE WHEN gap IS NULL OR gap > {_KEEP} THEN interval_no END) OVER (PARTITION BY stream, key ORDER BY interval_no ROWS UNBOUNDED PRECEDING) AS island_start FROM il0)"""


def _state(rows: str, out: str, delta: str = "") -> str:
    """The state of keys (out) over rows of keys and intervals. delta: a factor of burst and strength."""
    return f""", {out}0 AS (SELECT *, least(80, interval_no - island_start) AS depth,
 CAST(coalesce(sum(hits) OVER w, 0) AS BIGINT) AS history_total, coalesce(max(hits) OVER w, 0) AS history_peak, CAST(coalesce(sum(hits * hits) OVER w, 0) AS BIGINT) AS history_squares,
 CAST(hits + coalesce(sum(hits) OVER (PARTITION BY stream, key, island_start ORDER BY interval_no RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prime_flux
 FROM {rows} WINDOW w AS (PARTITION BY stream, key, island_start ORDER BY interval_no RANGE BETWEEN 80 PRECEDING AND 1 PRECEDING)),
{out} AS (SELECT *, CASE WHEN depth <= 1 OR history_total = 0 THEN 0.0 ELSE round(sqrt(greatest(history_squares / depth - (history_total / depth) * (history_total / depth), 0.0)) / (history_total / depth) * depth / 80{delta}, 6) END AS burst,
 CASE WHEN depth = 0 THEN CAST(hits AS DOUBLE) ELSE round(history_total / depth{delta}, 6) END AS strength, hits + prime_flux AS score FROM {out}0)"""


KEYS += _state("il", "ks")


def _silent(rows: str, out: str, more: str = "", keep: str = _KEEP) -> str:
    """rows and those retained in silence (out): a row for each interval that a key is retained in. more: columns that silence keeps."""
    return f""", {out} AS (SELECT stream, key, interval_no, hits, bytes, island_start{more} FROM {rows} UNION ALL
 SELECT stream, key, n.interval_no, 0, 0, island_start{more} FROM (SELECT *, lead(interval_no) OVER (PARTITION BY stream, key ORDER BY interval_no) AS next_no FROM {rows}) q JOIN (SELECT unnest(range((SELECT max(interval_no) + 1 FROM r))) AS interval_no) n
 ON n.interval_no > q.interval_no AND n.interval_no <= q.interval_no + {keep} AND (q.next_no IS NULL OR n.interval_no < q.next_no))"""


RETAINED = KEYS + _silent("il", "ia") + _state("ia", "ka")
#: Of each line the token distance of its agent from the first one of its address's island; of each key and interval the running mean
#: of its lines' distances, walked row by row along the island.
_CODE = "array_to_string(list_transform({0}, lambda x: chr(CAST(47 + list_position(words, x) AS INTEGER))), '')"
DELTAS = KEYS + f""", fa AS (SELECT key, island_start, first_line_id, user_agent AS agent, ua_tokens AS base FROM il JOIN r ON line_id = first_line_id WHERE stream = 'ips' AND il.interval_no = island_start),
dp AS (SELECT r.line_id, r.ip, r.interval_no, base, ua_tokens, list_distinct(list_concat(base, ua_tokens)) AS words FROM r JOIN il ON stream = 'ips' AND il.key = r.ip AND il.interval_no = r.interval_no JOIN fa ON fa.key = il.key AND fa.island_start = il.island_start WHERE r.line_id > fa.first_line_id AND user_agent <> agent),
ad AS (SELECT line_id, ip, interval_no, CASE WHEN len(base) = 0 OR len(ua_tokens) = 0 THEN 2.0 ELSE round(levenshtein({_CODE.format('base')}, {_CODE.format('ua_tokens')}) / len(base), 6) END AS distance FROM dp),
km AS (SELECT stream, key, kh.interval_no, CAST(sum(coalesce(distance, 0.0)) AS DOUBLE) AS moved, CAST(min_by(coalesce(distance, 0.0), kh.line_id) AS DOUBLE) AS first_moved FROM kh LEFT JOIN ad ON ad.line_id = kh.line_id GROUP BY ALL),
dn AS MATERIALIZED (SELECT il.*, moved - CASE WHEN il.interval_no = island_start THEN first_moved ELSE 0.0 END AS moved, row_number() OVER (PARTITION BY il.stream, il.key, island_start ORDER BY il.interval_no) AS step FROM il JOIN km ON km.stream = il.stream AND km.key = il.key AND km.interval_no = il.interval_no),
ad1 AS (WITH RECURSIVE walk AS (SELECT stream, key, island_start, interval_no, step, moved / (hits + 1) AS agent_delta FROM dn WHERE step = 1
 UNION ALL SELECT dn.stream, dn.key, dn.island_start, dn.interval_no, dn.step, (walk.agent_delta + dn.moved) / (dn.hits + 1) FROM walk JOIN dn ON dn.stream = walk.stream AND dn.key = walk.key AND dn.island_start = walk.island_start AND dn.step = walk.step + 1) SELECT * FROM walk),
id AS (SELECT il.*, agent_delta FROM il JOIN ad1 ON ad1.stream = il.stream AND ad1.key = il.key AND ad1.interval_no = il.interval_no)"""
MOVED = DELTAS + _state("id", "kd", " * (1 + agent_delta)")
MOVED_RETAINED = DELTAS + _silent("id", "ib", ", agent_delta") + _state("ib", "kb", " * (1 + agent_delta)")
#: The state of keys that live to see an interval's close, that interval included.
CLOSED = DELTAS + _silent("id", "ic", ", agent_delta", f"{_KEEP} - 1") + """, kc0 AS (SELECT *, least(80, interval_no - island_start + 1) AS depth, CAST(sum(hits) OVER w AS BIGINT) AS total, CAST(sum(hits * hits) OVER w AS BIGINT) AS squares FROM ic
 WINDOW w AS (PARTITION BY stream, key, island_start ORDER BY interval_no RANGE BETWEEN 79 PRECEDING AND CURRENT ROW)),
kc AS (SELECT *, CASE WHEN depth <= 1 OR total = 0 THEN 0.0 ELSE round(sqrt(greatest(squares / depth - (total / depth) * (total / depth), 0.0)) / (total / depth) * depth / 80 * (1 + agent_delta), 6) END AS burst, round(total / depth * (1 + agent_delta), 6) AS strength FROM kc0)"""
NORM = TOTALS + """, tp AS (SELECT interval_no, n_lines, coalesce(max(n_lines) OVER (ORDER BY interval_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top, coalesce(max(n_lines) OVER (ORDER BY interval_no ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING), 0) AS recent_top FROM t),
nd AS (SELECT interval_no, round(CASE WHEN top = 0 THEN avg(n_lines) OVER (ORDER BY interval_no ROWS 4 PRECEDING) / 10 ELSE (sum(top) OVER (ORDER BY interval_no ROWS 2 PRECEDING) + 2 * avg(n_lines) OVER (ORDER BY interval_no ROWS 4 PRECEDING)) / 50 END, 6) AS denominator,
 round(avg(recent_top) OVER (ORDER BY interval_no ROWS 2 PRECEDING), 6) AS line_mean FROM tp)"""

CANDIDATES = CLOSED + NORM + """, pcd AS (SELECT stream, key, interval_no, hits, CASE WHEN stream = 'ips' THEN CAST(hits AS DOUBLE) ELSE strength END AS strength, burst FROM kc JOIN nd USING (interval_no)
 WHERE depth >= 4 AND ((stream <> 'ips' AND strength / denominator >= 1) OR (stream = 'ips' AND ((hits > 10 AND burst >= 1) OR hits > line_mean / 10))))"""

#: The mean of the last three highest lane maxima, over all compete lanes; an absent lane has 0 hits.
MAXIMA = f""", lg AS (SELECT n.name, x.interval_no FROM (SELECT unnest({COMPETE}) AS name) n, (SELECT unnest(range((SELECT max(interval_no) + 1 FROM r))) AS interval_no) x),
lp AS (SELECT lg.name, lg.interval_no, coalesce(max(hits) OVER (PARTITION BY lg.name ORDER BY lg.interval_no ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING), 0) AS peak FROM lg LEFT JOIN lanes ON lanes.name = lg.name AND lanes.interval_no = lg.interval_no),
lx AS (SELECT interval_no, avg(max(peak)) OVER (ORDER BY interval_no ROWS 2 PRECEDING) AS line_mean FROM lp GROUP BY interval_no)"""


def key_intervals(spark, d):
    return K.key_intervals(K.key_hits(hourly_requests(spark, d)))


def islands(spark, d):
    # the same number of quiet intervals as at one-minute intervals
    return K.retention_islands(key_intervals(spark, d), 5, 60)


def scored(spark, d):
    return K.with_scores(K.key_state(islands(spark, d)))


def retained(spark, d):
    """scored with the keys that are retained in silence."""
    return K.with_scores(K.key_state(K.with_silent(islands(spark, d), 5, 60)))


def agent_islands(spark, d, requests=None):
    """Keys and intervals with their agent distances. Without the last status, which as a text would make Spark sort all tokens to count them."""
    hits = K.key_hits(K.with_agent_distance(hourly_requests(spark, d) if requests is None else requests))
    return K.with_agent_delta(K.retention_islands(K.key_intervals(hits).drop("last_status"), 5, 60))


def agent_scored(spark, d):
    """scored with the lines' agent distances in burst and strength."""
    return K.with_scores(K.key_state(agent_islands(spark, d)))


def agent_retained(spark, d):
    """agent_scored with the keys that are retained in silence."""
    return K.with_scores(K.key_state(K.with_silent(agent_islands(spark, d), 5, 60)))


def candidates(spark, d, islands, t=None):
    t = written(totals(spark, d), "totals") if t is None else t
    return K.peak_candidates(K.closed_state(K.with_silent(islands, 5, 60, closing=True)), K.norm_denominator(t), K.line_means(t), 4)


@query("g12_u1_key_intervals", over_requests(KEYS + " SELECT * FROM ki"))
def _(spark, d):
    return key_intervals(spark, d)


@query("w1_prime_flux", over_requests(KEYS + " SELECT stream, key, interval_no, hits, CAST(hits + coalesce(sum(hits) OVER (PARTITION BY stream, key ORDER BY interval_no RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prime_flux FROM ki"))
def _(spark, d):
    return K.prime_flux(key_intervals(spark, d)).select("stream", "key", "interval_no", "hits", "prime_flux")


@query("w2_retention", over_requests(f", k AS (SELECT DISTINCT CASE WHEN line_id % 3 = 0 THEN 'words' WHEN line_id % 3 = 1 THEN 'refs' ELSE 'ips' END AS stream FROM r) SELECT stream, CASE stream WHEN 'words' THEN {_TTL[0]} WHEN 'refs' THEN {_TTL[1]} ELSE {_TTL[2]} END AS ttl_seconds FROM k"))
def _(spark, d):
    streams = K.key_hits(hourly_requests(spark, d)).select("stream").distinct()
    return streams.join(K.retention_ttl(spark, 5), "stream")


@query("w3_retention_islands", over_requests(KEYS + " SELECT stream, key, interval_no, island_start FROM il"))
def _(spark, d):
    return islands(spark, d).select("stream", "key", "interval_no", "island_start")


@query("w4_key_state", over_requests(KEYS + " SELECT stream, key, interval_no, depth, history_total, history_peak, history_squares, prime_flux FROM ks"))
def _(spark, d):
    return K.key_state(islands(spark, d)).select("stream", "key", "interval_no", "depth", "history_total", "history_peak", "history_squares", "prime_flux")


@query("w4_key_history", over_requests(KEYS + ", la AS (SELECT stream, key, max(interval_no) AS newest, max(island_start) AS since FROM il GROUP BY ALL), gr AS (SELECT stream, key, unnest(range(greatest(since, newest - 80), newest)) AS interval_no FROM la), hi AS (SELECT gr.stream, gr.key, string_agg(CAST(coalesce(hits, 0) AS VARCHAR), ',' ORDER BY gr.interval_no) AS history FROM gr LEFT JOIN il ON il.stream = gr.stream AND il.key = gr.key AND il.interval_no = gr.interval_no GROUP BY ALL) SELECT la.stream, la.key, coalesce(history, '') AS history FROM la LEFT JOIN hi ON hi.stream = la.stream AND hi.key = la.key"))
def _(spark, d):
    return K.key_history(islands(spark, d)).select("stream", "key", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"))


@query("w5_w9_burst_strength", over_requests(MOVED + " SELECT stream, key, interval_no, burst, strength, score FROM kd"))
def _(spark, d):
    return agent_scored(spark, d).select("stream", "key", "interval_no", "burst", "strength", "score")


_VOLATILE = CLAIMED + ", n AS (SELECT max(interval_no) + 1 AS k FROM r), g AS (SELECT name, max(hits) AS peak, sum(hits) AS total, sum(hits * hits) AS squares FROM lanes GROUP BY name), vo AS (SELECT name, round(CASE WHEN peak < 10 OR peak <= total / k THEN 0.0 ELSE (peak - total / k) * ln(peak) END, 6) AS spikiness, round(sqrt(greatest(squares / k - (total / k) * (total / k), 0.0)) / (total / k), 6) AS burstiness FROM g, n)"


def _n_intervals(spark, d):
    return F.lit(hourly_requests(spark, d).agg((F.max("interval_no") + 1).alias("n")).first()["n"] or 1)  # one number


@query("w6_lane_volatility", over_requests(_VOLATILE + " SELECT * FROM vo"))
def _(spark, d):
    return K.lane_volatility(lanes(spark, d), _n_intervals(spark, d))


@query("w19_most_volatile", over_requests(_VOLATILE + " SELECT * FROM vo WHERE spikiness > 0 ORDER BY spikiness DESC, name LIMIT 3"))
def _(spark, d):
    return K.most_volatile(lanes(spark, d), _n_intervals(spark, d))


@query("w7_agent_distance", over_requests(DELTAS + " SELECT line_id, ip, interval_no, distance FROM ad"))
def _(spark, d):
    return K.agent_distance(hourly_requests(spark, d))


@query("w8_agent_delta", over_requests(DELTAS + " SELECT key AS ip, interval_no, round(agent_delta, 6) AS agent_delta FROM id WHERE stream = 'ips'"))
def _(spark, d):
    r = hourly_requests(spark, d)
    return K.agent_delta(r, K.agent_distance(r))


@query("w10_norm_denominator", over_requests(NORM + " SELECT interval_no, denominator FROM nd"))
def _(spark, d):
    return K.norm_denominator(totals(spark, d))


@query("w11_peak_candidates", over_requests(CANDIDATES + " SELECT stream, key, interval_no, hits, strength, burst FROM pcd"))
def _(spark, d):
    return candidates(spark, d, agent_islands(spark, d))


@query("w13_t1_rank_keys", over_requests(RETAINED + " SELECT stream, key, interval_no, score, row_number() OVER (PARTITION BY stream, interval_no ORDER BY score DESC, key) AS place FROM ka QUALIFY place <= 10"))
def _(spark, d):
    return K.rank_keys(retained(spark, d), 10).select("stream", "key", "interval_no", "score", "place")


@query("w14_rank_ips_display", over_requests(CLAIMED + MOVED_RETAINED + ", mk AS (SELECT DISTINCT ip AS key, interval_no FROM k WHERE mark IS NOT NULL), v AS (SELECT kb.key, kb.interval_no, CAST(score + CASE WHEN prime_flux > 8 THEN CAST(floor(burst * 100) AS BIGINT) + CAST(floor(agent_delta * 10) AS BIGINT) ELSE 0 END AS BIGINT) AS value, mk.key IS NOT NULL AS marked FROM kb LEFT JOIN mk ON mk.key = kb.key AND mk.interval_no = kb.interval_no WHERE stream = 'ips') SELECT *, row_number() OVER (PARTITION BY interval_no ORDER BY value DESC, marked DESC, key) AS place FROM v QUALIFY place <= 10"))
def _(spark, d):
    return K.rank_ips_display(agent_retained(spark, d), R.mark_lines(known(spark, d)).where("mark is not null"), 10)


@query("w15_ip_groups", over_requests(MOVED_RETAINED + """, gi AS (SELECT *, regexp_extract(key, '^([^.]+\\.[^.]+\\.)', 1) AS ip_prefix FROM kb WHERE stream = 'ips'),
gg AS (SELECT ip_prefix, interval_no, count(*) AS members, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(prime_flux) AS BIGINT) AS prime_flux, CAST(sum(bytes) AS BIGINT) AS bytes, round(CAST(sum(CAST(round(burst * 1000000) AS BIGINT)) AS DOUBLE) / count(*)) / 1000000 AS burst, max(depth) AS depth, round(avg(agent_delta), 6) AS agent_delta, CAST(sum(hits) + sum(prime_flux) AS BIGINT) AS score FROM gi GROUP BY 1, 2 HAVING count(*) >= 2),
gp AS (SELECT *, row_number() OVER (PARTITION BY interval_no ORDER BY score DESC, ip_prefix) AS place FROM gg QUALIFY place <= 25),
ph AS (SELECT a.ip_prefix, a.interval_no, b.interval_no AS at, sum(b.hits) AS n FROM gi a JOIN gi b ON b.key = a.key AND b.island_start = a.island_start AND b.interval_no < a.interval_no AND b.interval_no >= a.interval_no - 80 GROUP BY ALL),
gh AS (SELECT ip_prefix, interval_no, unnest(range(interval_no - depth, interval_no)) AS at FROM gp),
hs AS (SELECT gh.ip_prefix, gh.interval_no, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY gh.at) AS history FROM gh LEFT JOIN ph ON ph.ip_prefix = gh.ip_prefix AND ph.interval_no = gh.interval_no AND ph.at = gh.at GROUP BY ALL)
SELECT gp.*, coalesce(history, '') AS history FROM gp LEFT JOIN hs ON hs.ip_prefix = gp.ip_prefix AND hs.interval_no = gp.interval_no"""))
def _(spark, d):
    s = written(agent_retained(spark, d), "retained")
    return K.ip_group_history(s, K.ip_groups(s, 2, 25)).withColumn("history", F.array_join(F.transform("history", lambda n: n.cast("string")), ","))


@query("g14_new_key_rate", over_requests(KEYS + TOTALS + " SELECT stream, il.interval_no, count(*) AS created, round(count(*) / max(n_lines), 6) AS rate FROM il JOIN t ON t.interval_no = il.interval_no WHERE il.interval_no = island_start GROUP BY stream, il.interval_no"))
def _(spark, d):
    return K.new_key_rate(islands(spark, d), totals(spark, d))


@query("g15_one_hit_share", over_requests(RETAINED + " SELECT stream, interval_no, count(*) AS n_keys, round(count_if(prime_flux = 1) / count(*), 6) AS one_hit FROM ka GROUP BY ALL"))
def _(spark, d):
    return K.one_hit_share(retained(spark, d))


@query("g16_prefix_census", over_requests(RETAINED + ", g AS (SELECT regexp_extract(key, '^([^.]+\\.[^.]+\\.)', 1) AS ip_prefix, interval_no, count(*) AS members FROM ka WHERE stream = 'ips' GROUP BY 1, 2) SELECT interval_no, count(*) AS prefixes, count_if(members >= 2) AS active, round(avg(members), 6) AS mean_members FROM g GROUP BY interval_no"))
def _(spark, d):
    return K.prefix_census(retained(spark, d), 2)


def _promoted_sql(depth: int, share: int) -> str:
    return over_requests(CLAIMED + KEYS + TOTALS + MAXIMA + f""", mk AS (SELECT DISTINCT ip AS key, interval_no FROM k WHERE mark IS NOT NULL),
o AS (SELECT ks.* FROM ks ANTI JOIN mk ON mk.key = ks.key AND mk.interval_no = ks.interval_no WHERE stream = 'ips' AND depth > {depth}), b AS (SELECT *, row_number() OVER (PARTITION BY interval_no ORDER BY hits DESC, first_line_id) AS place FROM o QUALIFY place = 1)
SELECT b.interval_no, b.key AS ip, b.hits FROM b JOIN t ON t.interval_no = b.interval_no JOIN lx ON lx.interval_no = b.interval_no WHERE b.hits >= n_lines // 10 AND b.hits >= line_mean / {share}""")


def _promoted(spark, d, depth, share):
    # the lines once, for totals, lanes and marks
    k = written(R.mark_lines(known(spark, d)).select("line_id", "interval_no", "ip", "bytes", "status", "claim", "claim_rank", "known", "mark"), "marked")
    t, lane = written(I.interval_totals(k), "totals"), written(I.lane_intervals(I.lane_hits(k)), "lanes")
    means = lane_maxima(lane, COMPETE, t).withColumn("line_mean", F.col("line_mean") / share)
    # addresses alone: the other streams are not promoted
    own = K.with_scores(K.key_state(K.retention_islands(K.key_intervals(K.key_hits(k, {"ips": T.ip_tokens(F.col("ip"))})), 5, 60)))
    return K.promote_ip(own, k, t, means, depth)


@query("w18_promote_ip", _promoted_sql(5, 1))
def _(spark, d):
    return _promoted(spark, d, 5, 1)


@query("w18_promote_ip_early", _promoted_sql(0, 8))
def _(spark, d):
    """The same from the first completed interval of an address on, and at an eighth of the lanes' maxima, which the given tables meet."""
    return _promoted(spark, d, 0, 8)


@query("w19_most_active", over_requests(CLAIMED + ", p AS (SELECT name, hits, row_number() OVER (PARTITION BY name ORDER BY interval_no DESC) AS back FROM lanes) SELECT name, CAST(sum(hits) AS BIGINT) AS recent FROM p WHERE back <= 2 GROUP BY name ORDER BY recent DESC, name LIMIT 3"))
def _(spark, d):
    return K.most_active(lanes(spark, d))


@query("w21_full_history", over_requests(KEYS + " SELECT stream, key, interval_no, depth FROM ks WHERE depth = least(interval_no, 80)"))
def _(spark, d):
    return K.full_history(scored(spark, d))


@query("w22_seed_lane_history", over_requests(CLAIMED + KEYS + ", s AS (SELECT 'clicks' AS name, interval_no, hits FROM ki WHERE stream = 'ips' AND key = '10.0.0.28' AND interval_no < 100 UNION ALL SELECT name, interval_no, hits FROM lanes WHERE name = 'clicks' AND interval_no >= 100) SELECT * FROM s"))
def _(spark, d):
    return K.seed_lane_history(key_intervals(spark, d), lanes(spark, d), "clicks", "10.0.0.28", 100)
