"""Queries: parsing, tokens, bands, claims and marks, aggregates for each interval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import intervals as I
from ..operators import rules as R
from ..sources import access_log as A
from ..sources.shared import shared_folder
from ..sources.tables_view import hourly_requests, log_lines, requests_view
from .common import SYMBOLS, over_requests, query

#: The rules of the registered queries: (name, lane, scope, patterns) in order.
RULES = [
    ("errors", "compete", "code", ["500"]),
    ("signups", "compete", "words", ["/signup/", "/register/"]),
    ("net1", "compete", "ips", ["10.1."]),
    ("host", "compete", "ips", ["10.2.3.10", "10.3.0."]),
    ("clicks", "compete", "starts", ["10.0.0.28", "10.0.4."]),
    ("bots", "bots", "bots", []),
    ("mailed", "observe", "line", ["src=mail"]),
    ("orgs", "observe", "refs", [".org/"]),
    ("Browser", "observe", "regex", [R.BROWSER]),
    ("Platform", "observe", "regex", [R.PLATFORM]),
]
COMPETE = [name for name, lane, _, _ in RULES if lane == "compete"]
#: The same in SQL: direct hits of each rule, by rank.
_HIT = {
    "errors": "contains(status, '500')",
    "signups": "(contains(user_agent, '/signup/') OR contains(request, '/signup/') OR contains(user_agent, '/register/') OR contains(request, '/register/'))",
    "net1": "ip_prefix = '10.1.'",
    "host": "(ip = '10.2.3.10' OR starts_with(ip, '10.3.0.'))",
    "clicks": "(starts_with(line, '10.0.0.28') OR starts_with(line, '10.0.4.'))",
    "bots": "regexp_matches(user_agent, '(?i)bot|spider|crawler|agent')",
    "mailed": "contains(line, 'src=mail')",
    "orgs": "contains(referer, '.org/')",
    "Browser": f"regexp_matches(line, '{R.BROWSER}')",
    "Platform": f"regexp_matches(line, '{R.PLATFORM}')",
}
_COMPETE = ["errors", "signups", "net1", "host", "clicks"]
_CLAIM = "CASE " + " ".join(f"WHEN {_HIT[n]} THEN '{n}'" for n in [*_COMPETE, "bots"]) + " END"
_PLACE = "CASE c.claim " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate([*_COMPETE, "bots"])) + " ELSE 99 END"
CLAIMED = f""", c AS (SELECT r.*, {_CLAIM} AS claim FROM r),
m AS (SELECT ip, claim AS name, CASE claim {' '.join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(_COMPETE))} END AS place, min(line_id) AS start FROM c WHERE claim IN ({', '.join(f"'{n}'" for n in _COMPETE)}) GROUP BY ip, claim),
rem AS (SELECT c.line_id, c.interval_no, c.ip, c.bytes, m.name FROM c JOIN m ON m.ip = c.ip AND m.start < c.line_id WHERE m.place < {_PLACE}),
tag AS (SELECT c.line_id, min_by(m.name, m.place) AS name FROM c JOIN m ON m.ip = c.ip AND m.start < c.line_id GROUP BY c.line_id),
k AS (SELECT c.*, COALESCE(tag.name, c.claim, CASE WHEN {_HIT['mailed']} THEN 'mailed' WHEN {_HIT['orgs']} THEN 'orgs' END) AS mark FROM c LEFT JOIN tag ON tag.line_id = c.line_id),
hits AS (SELECT line_id, interval_no, ip, bytes, claim AS name, TRUE AS direct FROM c WHERE claim IS NOT NULL UNION ALL SELECT line_id, interval_no, ip, bytes, name, FALSE FROM rem),
lanes AS (SELECT name, interval_no, count(*) AS hits, count_if(direct) AS claims, CAST(sum(bytes) AS BIGINT) AS bytes FROM hits GROUP BY name, interval_no)"""
TOTALS = ", t AS (SELECT interval_no, count(*) AS n_lines, CAST(sum(bytes) AS BIGINT) AS bytes, count_if(substr(status, 1, 1) IN ('4', '5')) AS errors FROM r GROUP BY interval_no)"
SIZE_BAND = "CASE " + " ".join(f"WHEN bytes < {b} THEN '{n}'" for b, n in V.SIZE_BANDS) + f" ELSE '{V.LARGEST_BAND}' END"
TOKEN_BAND = f"CASE WHEN len(ua_tokens) IN ({', '.join(map(str, V.TOKEN_BANDS))}) THEN 'b' || CAST(len(ua_tokens) AS VARCHAR) ELSE 'other' END"
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
INTERESTING = f"octet_length(encode(t)) >= 3 AND t NOT IN ({_STOPS}) AND NOT regexp_full_match(t, '[0-9._E]+')"
WORDS = f"""CASE WHEN len(list_filter(list_concat(ua_tokens, string_split(translate(request, {SYMBOLS}), ' ')), lambda t: {INTERESTING})) = 0 THEN ['--filtered--']
 ELSE list_filter(list_concat(ua_tokens, string_split(translate(request, {SYMBOLS}), ' ')), lambda t: {INTERESTING}) END"""
REFS = f"""CASE WHEN referer IN ('', '-', ' ') THEN ['--empty--'] ELSE list_filter(string_split(translate(CASE WHEN instr(referer, '//') > 0 THEN substr(referer, instr(referer, '//') + 2) ELSE referer END, {SYMBOLS}), ' '), lambda t: octet_length(encode(t)) >= 3) END"""


def rules(spark):
    return R.rules_from_rows(spark, RULES)[0]


def claimed(spark, sf_dir):
    """Claims; the hits are those of the rules that can claim, remember or mark."""
    return R.claim_lines(R.match_rules(hourly_requests(spark, sf_dir), R.without_observed_regexes(rules(spark))))


def known(spark, sf_dir):
    return R.with_memory(claimed(spark, sf_dir))


def lanes(spark, sf_dir):
    return I.lane_intervals(I.lane_hits(known(spark, sf_dir)))


def totals(spark, sf_dir):
    return I.interval_totals(hourly_requests(spark, sf_dir))


_LINES = over_requests(""", l AS (SELECT line_id, CASE WHEN line_id % 97 = 0 THEN '!!! add rule' || CAST(line_id AS VARCHAR)
 WHEN line_id % 50 <> 0 THEN line
 WHEN (line_id // 50) % 5 = 0 THEN replace(line, '"', '') WHEN (line_id // 50) % 5 = 1 THEN 'localhost' || substr(line, 9)
 WHEN (line_id // 50) % 5 = 2 THEN replace(line, '[', '(') WHEN (line_id // 50) % 5 = 3 THEN replace(line, ' "GET', 'GET')
 ELSE replace(line, '" 200 ', '" 200 x') END AS line FROM r),
j AS (SELECT line_id, line, CASE WHEN regexp_extract(line, '^([^ ]+) ', 1) IS NULL OR NOT contains(line, ' ') THEN 'no_space'
 WHEN NOT regexp_matches(regexp_extract(line, '^([^ ]+) ', 1), '^[^.]+\\.[^.]+\\.[^.]*[0-9]') THEN 'ip'
 WHEN length(line) - length(replace(line, '"', '')) < 6 THEN 'quotes'
 WHEN NOT regexp_matches(line, '^[^ ]+ .*?"[^"]*" .{3} [^"]* "[^"]*" ?[^"]*".*?"( "-")?\\s*$') THEN 'fields'
 WHEN TRY_CAST(regexp_extract(line, '^[^ ]+ .*?"[^"]*" .{3} ([^"]*) "', 1) AS BIGINT) IS NULL THEN 'bad_bytes'
 WHEN NOT regexp_matches(line, '\\[\\d{2}/[A-Za-z]{3}/\\d{4}:\\d{2}:\\d{2}:\\d{2}') THEN 'time' END AS reason FROM l WHERE NOT starts_with(line, '!!! '))""")


@query("a9_command_lines", _LINES + " SELECT line_id, substr(line, 5) AS command FROM l WHERE starts_with(line, '!!! ')")
def _(spark, d):
    return A.command_lines(log_lines(spark, d)).select("line_id", "command")


@query("a4_follow_access_log", _LINES + " SELECT row_number() OVER (ORDER BY line_id) - 1 AS line_id, line FROM l")
def _(spark, d):
    folder = shared_folder(spark, "followed")
    lines = log_lines(spark, d).withColumnRenamed("line", "value")
    half = lines.agg(F.floor(F.avg("line_id"))).first()[0] or 0
    out = None
    for chunk in (lines.where(F.col("line_id") <= half), lines.where(F.col("line_id") > half)):  # the second comes when the first has been read
        chunk.repartitionByRange("line_id").sortWithinPartitions("line_id").select("value").write.mode("append").text(f"{folder}/logs")
        out = A.follow_access_log(spark, f"{folder}/logs", folder)
    return out.select("line_id", "line")


@query("a1_p1_parse_requests", _LINES + ", g AS (SELECT r.* FROM j JOIN r ON r.line_id = j.line_id WHERE j.reason IS NULL) SELECT line_id, date_trunc('second', ts) AS ts, ip, ip_prefix, request, status, bytes, referer, user_agent, len(ua_tokens) AS ua_token_count FROM g")
def _(spark, d):
    return A.parse_requests(log_lines(spark, d)).select("line_id", "ts", "ip", "ip_prefix", "request", "status", "bytes", "referer", "user_agent", "ua_token_count")


@query("p2_parse_rejects", _LINES + " SELECT line_id, reason FROM j WHERE reason IS NOT NULL")
def _(spark, d):
    return A.parse_rejects(log_lines(spark, d)).select("line_id", "reason")


@query("a2_recent_window", over_requests("SELECT line_id, ts, ip FROM r WHERE ts >= (SELECT max(ts) FROM r) - INTERVAL 6000 MINUTE"))
def _(spark, d):
    return A.recent_window(requests_view(spark, d), 6000).select("line_id", "ts", "ip")


@query("a3_trim_partial", over_requests("SELECT line_id, ts FROM r WHERE interval_start > (SELECT min(interval_start) FROM r) AND interval_start < (SELECT max(interval_start) FROM r)"))
def _(spark, d):
    return A.trim_partial(requests_view(spark, d), "hour").select("line_id", "ts")


@query("p3_p4_p5_time_prefix_error", over_requests("SELECT line_id, date_trunc('second', ts) AS ts, ip_prefix AS prefix, substr(status, 1, 1) IN ('4', '5') AS is_error FROM r"))
def _(spark, d):
    return hourly_requests(spark, d).select("line_id", T.parse_time(F.col("line")).alias("ts"), T.ip_prefix(F.col("ip")).alias("prefix"), T.is_error(F.col("status")).alias("is_error"))


@query("p6_p7_bands", over_requests(f"SELECT line_id, {SIZE_BAND} AS size_band, {TOKEN_BAND} AS token_band FROM r"))
def _(spark, d):
    return requests_view(spark, d).select("line_id", V.size_band(F.col("bytes")).alias("size_band"), V.token_band(F.col("ua_token_count")).alias("token_band"))


@query("p8_p9_agent_tokens", over_requests("SELECT line_id, array_to_string(ua_tokens, '|') AS tokens FROM r"))
def _(spark, d):
    return requests_view(spark, d).select("line_id", F.array_join("ua_tokens", "|").alias("tokens"))


@query("p10_p11_word_tokens", over_requests(f"SELECT line_id, array_to_string({WORDS}, '|') AS tokens FROM r"))
def _(spark, d):
    return requests_view(spark, d).select("line_id", F.array_join(T.word_tokens(F.col("ua_tokens"), F.col("request")), "|").alias("tokens"))


@query("p12_p13_referer_and_ip_tokens", over_requests(f"SELECT line_id, array_to_string({REFS}, '|') AS refs, ip AS ips FROM r"))
def _(spark, d):
    return requests_view(spark, d).select("line_id", F.array_join(T.referer_tokens(F.col("referer")), "|").alias("refs"), F.array_join(T.ip_tokens(F.col("ip")), "|").alias("ips"))


@query("p14_p15_bots", over_requests("SELECT line_id, regexp_matches(user_agent, '(?i)bot|spider|crawler|agent') AS bot_like, list_filter(ua_tokens, lambda t: regexp_matches(t, '(?i).(bot|spider|crawler|agent)$'))[1] AS bot_name FROM r"))
def _(spark, d):
    return requests_view(spark, d).select("line_id", T.bot_like(F.col("user_agent")).alias("bot_like"), T.bot_name(F.col("ua_tokens")).alias("bot_name"))


@query("p16_filter_contains", over_requests("SELECT line_id, line FROM r WHERE contains(line, 'item7?src=web')"))
def _(spark, d):
    return hourly_requests(spark, d).where(T.contains_key(F.col("line"), "item7?src=web")).select("line_id", "line")


@query("p17_intervals", over_requests("SELECT line_id, interval_start, interval_no FROM r"))
def _(spark, d):
    return hourly_requests(spark, d).select("line_id", "interval_start", "interval_no")


@query("p17_compact_intervals", over_requests("SELECT line_id, interval_start, CAST(dense_rank() OVER (ORDER BY interval_start) - 1 AS BIGINT) AS interval_no FROM r"))
def _(spark, d):
    return A.number_intervals(requests_view(spark, d), "hour", compact=True).select("line_id", "interval_start", "interval_no")


@query("p18_address_hint", over_requests("SELECT ip_prefix AS pattern, (length(ip_prefix) - length(replace(ip_prefix, '.', ''))) >= 2 AND regexp_matches(ip_prefix, '^[0-9]') AS is_address FROM r GROUP BY ip_prefix UNION ALL SELECT DISTINCT status, FALSE FROM r"))
def _(spark, d):
    v = requests_view(spark, d)
    p = v.select(F.col("ip_prefix").alias("pattern")).distinct().unionByName(v.select(F.col("status").alias("pattern")).distinct())
    return p.select("pattern", R.address_hint(F.array("pattern")).alias("is_address"))


@query("m1_m9_match_rules", over_requests("".join(f" {'UNION ALL' if i else ''} SELECT line_id, '{n}' AS name FROM r WHERE {c}" for i, (n, c) in enumerate(_HIT.items()))))
def _(spark, d):
    return R.match_rules(hourly_requests(spark, d), rules(spark)).select("line_id", F.explode("hits.name").alias("name"))


@query("m10_claim_lines", over_requests(CLAIMED + " SELECT line_id, claim FROM c"))
def _(spark, d):
    return claimed(spark, d).select("line_id", "claim")


@query("m11_remembered_hits", over_requests(CLAIMED + " SELECT line_id, name FROM rem"))
def _(spark, d):
    return R.remembered_hits(known(spark, d)).select("line_id", "name")


@query("m12_mark_lines", over_requests(CLAIMED + " SELECT line_id, mark FROM k"))
def _(spark, d):
    return R.mark_lines(known(spark, d)).select("line_id", "mark")


def _regex_sql(names: dict) -> str:
    return " UNION ALL ".join(f"SELECT line_id, interval_no, '{n}' AS name, unnest(regexp_extract_all(line, '{p}', 1)) AS key FROM r" for n, p in names.items())


_PACKAGED = {"Browser": R.BROWSER, "Platform": R.PLATFORM}


def _packaged_keys(spark, d):
    r = hourly_requests(spark, d)
    return reduce(lambda a, b: a.unionByName(b), [R.regex_keys(r, n, p) for n, p in _PACKAGED.items()])


@query("m7_m8_regex_keys", over_requests(f", x AS ({_regex_sql(_PACKAGED)}) SELECT name, key, count(*) AS hits FROM x GROUP BY name, key"))
def _(spark, d):
    return _packaged_keys(spark, d).groupBy("name", "key").agg(F.count("*").alias("hits"))


#: A rule that meets clicks by their address, and some mailed items, which turn it.
_TURNING = r'(?:^|item3[05][?]src=)(10[.][0-9.]+|mail)(?: - - [^"]*"GET /click| )'


@query("m7_regex_memory", over_requests(f""", x AS (SELECT line_id, interval_no, ip, bytes, regexp_extract_all(line, '{_TURNING}', 1) AS keys FROM r),
tu AS (SELECT min(line_id) AS turn FROM x WHERE len(keys) > 0 AND keys[1] <> ip),
di AS (SELECT line_id, interval_no, ip, bytes, CASE WHEN line_id >= turn THEN 'key' ELSE 'address' END AS kind, unnest(CASE WHEN line_id >= turn THEN keys ELSE [ip] END) AS key FROM x, tu WHERE len(keys) > 0),
se AS (SELECT key, min(line_id) AS start FROM di GROUP BY key)
SELECT line_id, interval_no, ip, bytes, 'turning' AS name, kind, key FROM di UNION ALL SELECT x.line_id, interval_no, ip, bytes, 'turning', 'related', ip FROM x JOIN se ON se.key = x.ip AND x.line_id > start WHERE len(keys) = 0"""))
def _(spark, d):
    return R.regex_lane(hourly_requests(spark, d), "turning", _TURNING)


#: Each line is a change of one of nine rules, dealt by its bytes.
_CHANGES = "ch AS (SELECT line_id, CASE WHEN (bytes // 10) % 2 = 0 THEN 'add' ELSE 'remove' END AS action, 'rule' || CAST((bytes // 20) % 9 AS VARCHAR) AS name FROM r), va AS (SELECT name, line_id AS valid_from, action, lead(line_id) OVER (PARTITION BY name ORDER BY line_id) AS valid_to FROM ch), v AS (SELECT name, valid_from, valid_to FROM va WHERE action = 'add')"


def _changes(spark, d):
    n = F.floor(F.col("bytes") / 10)
    return requests_view(spark, d).select("line_id", F.when(n % 2 == 0, "add").otherwise("remove").alias("action"), F.concat(F.lit("rule"), (F.floor(n / 2) % 9).cast("string")).alias("name"))


@query("m13_rule_validity", over_requests(f", {_CHANGES} SELECT name, valid_from, valid_to FROM v"))
def _(spark, d):
    return R.rule_validity(_changes(spark, d))


@query("j10_temporal_rules", over_requests(f", {_CHANGES} SELECT v.name, count(*) AS n_lines FROM r JOIN v ON v.name = 'rule' || CAST(r.line_id % 9 AS VARCHAR) AND r.line_id >= v.valid_from AND (v.valid_to IS NULL OR r.line_id < v.valid_to) GROUP BY v.name"))
def _(spark, d):
    r = requests_view(spark, d).select("line_id", F.concat(F.lit("rule"), (F.col("line_id") % 9).cast("string")).alias("name"))
    return R.lines_under_rules(r, _changes(spark, d)).groupBy("name").agg(F.count("*").alias("n_lines"))


@query("g1_interval_totals", over_requests(TOTALS + " SELECT * FROM t"))
def _(spark, d):
    return totals(spark, d)


@query("g2_status_breakdown", over_requests("SELECT interval_no, status, count(*) AS n_lines FROM r WHERE substr(status, 1, 1) IN ('4', '5') GROUP BY ALL"))
def _(spark, d):
    return I.status_breakdown(hourly_requests(spark, d))


def _bands(expr):
    return over_requests(f", b AS (SELECT interval_no, {expr} AS band, count(*) AS n_lines FROM r GROUP BY ALL) SELECT *, round(100 * n_lines / sum(n_lines) OVER (PARTITION BY interval_no), 6) AS share FROM b")


@query("g3_size_band_breakdown", _bands(SIZE_BAND))
def _(spark, d):
    return I.size_band_breakdown(hourly_requests(spark, d))


@query("g4_token_band_breakdown", _bands(TOKEN_BAND))
def _(spark, d):
    return I.token_band_breakdown(hourly_requests(spark, d))


@query("g5_marked_share", over_requests(CLAIMED + ", n AS (SELECT interval_no, count(mark) AS marked, count_if(mark IS NULL) AS unmarked FROM k GROUP BY interval_no) SELECT *, round(100 * marked / (marked + unmarked), 6) AS share FROM n"))
def _(spark, d):
    return I.marked_share(R.mark_lines(known(spark, d)))


@query("g6_ua_token_histogram", over_requests("SELECT len(ua_tokens) AS ua_token_count, count(*) AS n_lines, CAST(sum(len(ua_tokens)) AS BIGINT) AS tokens FROM r GROUP BY 1"))
def _(spark, d):
    return I.ua_token_histogram(requests_view(spark, d))


@query("g7_lane_intervals", over_requests(CLAIMED + " SELECT *, CAST(sum(bytes) OVER (PARTITION BY name ORDER BY interval_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes_to_date FROM lanes"))
def _(spark, d):
    return lanes(spark, d)


@query("g8_lane_ip_counts", over_requests(CLAIMED + ", p AS (SELECT name, interval_no, ip, count(*) AS hits FROM hits GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY name, interval_no ORDER BY hits DESC, ip) AS place FROM p QUALIFY place <= 5"))
def _(spark, d):
    return I.lane_ip_counts(I.lane_hits(known(spark, d)), 5)


@query("g9_lane_prefix_groups", over_requests(CLAIMED + """, f AS (SELECT name, ip, min(interval_no) AS since FROM hits GROUP BY ALL), n AS (SELECT name, regexp_extract(ip, '^([^.]+\\.[^.]+\\.)', 1) AS ip_prefix, since FROM f),
p AS (SELECT name, regexp_extract(ip, '^([^.]+\\.[^.]+\\.)', 1) AS ip_prefix, interval_no, count(*) AS k FROM hits GROUP BY ALL)
SELECT p.name, p.ip_prefix, p.interval_no, (SELECT CAST(sum(k) AS BIGINT) FROM p q WHERE q.name = p.name AND q.ip_prefix = p.ip_prefix AND q.interval_no <= p.interval_no) AS hits, (SELECT count(*) FROM n WHERE n.name = p.name AND n.ip_prefix = p.ip_prefix AND since <= p.interval_no) AS members FROM p WHERE members >= 3"""))
def _(spark, d):
    return I.lane_prefix_groups(I.lane_hits(known(spark, d)), 3)


@query("g10_lane_keys", over_requests(f", b AS (SELECT interval_no, list_filter(ua_tokens, lambda t: regexp_matches(t, '(?i).(bot|spider|crawler|agent)$'))[1] AS key FROM r WHERE regexp_matches(user_agent, '(?i)bot|spider|crawler|agent')), x AS ({_regex_sql(_PACKAGED)}), a AS (SELECT 'Bots' AS name, interval_no, key FROM b WHERE key IS NOT NULL UNION ALL SELECT name, interval_no, key FROM x UNION ALL SELECT 'errs', interval_no, status FROM r WHERE substr(status, 1, 1) IN ('4', '5')), p AS (SELECT name, interval_no, key, count(*) AS hits FROM a GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY name, interval_no ORDER BY hits DESC, key) AS place FROM p QUALIFY place <= 25"))
def _(spark, d):
    r = hourly_requests(spark, d)
    return I.lane_keys(R.bot_keys(r).unionByName(_packaged_keys(spark, d)).unionByName(R.error_keys(r)))


@query("g11_lane_examples", over_requests(CLAIMED + ", p AS (SELECT claim AS name, interval_no, min(line_id) AS first_line_id, max(line_id) AS last_line_id FROM c WHERE claim IS NOT NULL GROUP BY ALL) SELECT *, min(first_line_id) OVER (PARTITION BY name) AS first_ever_id FROM p"))
def _(spark, d):
    return I.lane_examples(claimed(spark, d))


@query("g13_running_totals", over_requests(TOTALS + " SELECT interval_no, n_lines, CAST(sum(n_lines) OVER (ORDER BY interval_no) AS BIGINT) AS total_lines, CAST(sum(bytes) OVER (ORDER BY interval_no) AS BIGINT) AS total_bytes FROM t"))
def _(spark, d):
    return I.running_totals(totals(spark, d))


@query("g17_traffic_extremes", over_requests(TOTALS + " SELECT interval_no, " + ", ".join(f"max({c}) OVER w AS peak_{c}, CAST(floor(sum({c}) OVER w / count(*) OVER w) AS BIGINT) AS mean_{c}" for c in ("n_lines", "bytes", "errors")) + " FROM t WINDOW w AS (ORDER BY interval_no RANGE BETWEEN 79 PRECEDING AND CURRENT ROW)"))
def _(spark, d):
    return I.traffic_extremes(totals(spark, d))


@query("g18_lane_summary", over_requests(CLAIMED + " SELECT name, CAST(sum(hits) AS BIGINT) AS total, max(hits) AS peak, min(hits) AS least, round(avg(hits), 6) AS mean, count(*) AS n_intervals FROM lanes GROUP BY name"))
def _(spark, d):
    return I.lane_summary(lanes(spark, d))


@query("g19_shared_scale", over_requests(CLAIMED + f", p AS (SELECT name, max(hits) AS peak, min(hits) AS least FROM lanes WHERE name IN ({', '.join(repr(n) for n in _COMPETE)}) GROUP BY name) SELECT min(least) AS least, round(avg(peak), 6) AS mean_peak, max(peak) AS peak FROM p"))
def _(spark, d):
    return I.shared_scale(lanes(spark, d), _COMPETE)


@query("w16_lane_trend", over_requests(CLAIMED + ", p AS (SELECT name, interval_no, hits, lag(hits) OVER (PARTITION BY name ORDER BY interval_no) AS previous FROM lanes) SELECT *, CASE WHEN previous >= 3 AND hits / previous >= 1.1 THEN 'up' WHEN previous >= 3 AND hits / previous <= 0.9 THEN 'down' ELSE 'flat' END AS trend FROM p"))
def _(spark, d):
    return I.lane_trend(lanes(spark, d), 3)


@query("t2_bands_in_order", over_requests(f", b AS (SELECT {SIZE_BAND} AS band, count(*) AS n_lines FROM r GROUP BY 1) SELECT band, n_lines, row_number() OVER (ORDER BY CASE band " + " ".join(f"WHEN '{n}' THEN {i}" for i, (_, n) in enumerate(V.SIZE_BANDS)) + f" ELSE {len(V.SIZE_BANDS)} END) AS place FROM b"))
def _(spark, d):
    from pyspark.sql import Window

    b = requests_view(spark, d).groupBy(V.size_band(F.col("bytes")).alias("band")).agg(F.count("*").alias("n_lines"))
    return b.withColumn("place", F.row_number().over(Window.orderBy(V.size_band_order(F.col("band")))))


@query("f6_formats", over_requests(TOTALS + ", q AS (SELECT interval_no, n_lines * 1777 AS n, bytes * 31 AS b FROM t) SELECT interval_no, CASE WHEN n <= 9999 THEN printf('%4d', n) WHEN n <= 999999 THEN printf('%3dK', n // 1000) WHEN n < 10000000 THEN printf('%4.1fM', round(n / 1e6, 1)) ELSE '----' END AS lines_text, CASE WHEN b >= 1073741824 THEN printf('%2.0fG', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%2.0fM', b / 1048576.0) WHEN b >= 1024 THEN printf('%2.0fK', b / 1024.0) ELSE printf('%2dB', b) END AS bytes_text FROM q"))
def _(spark, d):
    t = totals(spark, d)
    return t.select("interval_no", V.format_count(F.col("n_lines") * 1777).alias("lines_text"), V.format_bytes(F.col("bytes") * 31).alias("bytes_text"))
