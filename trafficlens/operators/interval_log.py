"""The interval log: nested records in file order, their tolerant reading, and the questions asked of a recorded log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.access_log import read_access_log

SCHEMA_VERSION = 4
ISSUE_CHARS = 240
_ENTRY = "struct<key: string, rank: int, score: bigint, count: bigint, prime_flux: bigint, burstiness: double, agent_delta_metric: double, history_total: bigint, history_peak: bigint, history_depth: bigint, is_peak: boolean>"
RECORD = (
    "schema_version int, event_type string, session_id string, timestamp string, log_time string, interval bigint, interval_lines bigint, "
    "total_lines bigint, total_bytes bigint, errors bigint, unmarked bigint, agent_token_cardinality map<string, bigint>, "
    "matchers array<struct<name: string, interval_count: bigint, last_interval_count: bigint, history_total: bigint, history_peak: bigint, "
    "top_keys: array<struct<key: string, count: bigint, rank: int>>, top_groups: array<struct<prefix: string, count: bigint, members: bigint, rank: int>>>>, "
    f"interesting array<struct<name: string, total_keys: bigint, top: array<{_ENTRY}>, peaks: array<{_ENTRY}>, "
    "ip_groups: array<struct<prefix: string, rank: int, score: bigint, count: bigint, members: bigint, bytes: bigint, burstiness: double, agent_delta_metric: double, history_depth: bigint, history: array<bigint>>>>>, "
    "source_lines array<string>, result map<string, string>, command_name string, status string, matcher string, direction string, value bigint, threshold bigint"
)


def lane_records(lanes: DataFrame, keys: DataFrame, groups: DataFrame, k: int = 25, depth: int = 80) -> DataFrame:
    """(interval_no, matchers): of each interval its lanes with the count now and before, the history of completed intervals, first keys and groups.

    lanes: (name, interval_no, hits). keys: (name, interval_no, key, hits). groups: (name, ip_prefix, interval_no, hits, members), to date.
    """
    past = Window.partitionBy("name").orderBy("interval_no")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = lanes.select(
        "name", "interval_no", F.col("hits").alias("interval_count"), zero(F.sum("hits").over(past.rangeBetween(-1, -1))).alias("last_interval_count"),
        zero(F.sum("hits").over(past.rangeBetween(-depth, -1))).alias("history_total"), zero(F.max("hits").over(past.rangeBetween(-depth, -1))).alias("history_peak"),
    )
    first = lambda by: F.row_number().over(Window.partitionBy("name", "interval_no").orderBy(F.desc("hits"), by)).alias("rank")
    top = keys.select("name", "interval_no", "key", F.col("hits").alias("count"), first("key")).where(F.col("rank") <= k).groupBy("name", "interval_no").agg(_listed("key", "count", "rank").alias("top_keys"))
    most = groups.select("name", "interval_no", F.col("ip_prefix").alias("prefix"), F.col("hits").alias("count"), "members", first("ip_prefix")).where(F.col("rank") <= k).groupBy("name", "interval_no").agg(_listed("prefix", "count", "members", "rank").alias("top_groups"))
    j = rows.join(top, ["name", "interval_no"], "left").join(most, ["name", "interval_no"], "left")
    return j.groupBy("interval_no").agg(F.array_sort(F.collect_list(F.struct("name", "interval_count", "last_interval_count", "history_total", "history_peak", "top_keys", "top_groups"))).alias("matchers"))


def _listed(*fields: str) -> Column:
    """The rows of a group as structs, by rank."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("entry"))))
    return F.transform(ranked, lambda x: x["entry"])


def stream_records(scored: DataFrame, members: DataFrame, groups: DataFrame, k: int = 25) -> DataFrame:
    """(interval_no, interesting): of each interval its streams with the number of retained keys, the first k, the peaks, the address groups.

    scored: retained keys with score, burst, agent_delta and history. members: (stream, interval_no, key), the peaks before the close;
    one that is no longer retained is listed without counts. groups: of ip_groups with place and history.
    """
    key = ["stream", "key", "interval_no"]
    order = Window.partitionBy("stream", "interval_no").orderBy(F.col("score").desc_nulls_last(), "key")
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    values = [
        whole("score").alias("score"), whole("hits").alias("count"), whole("prime_flux").alias("prime_flux"), F.coalesce("burst", F.lit(0.0)).alias("burstiness"),
        F.round(F.coalesce("agent_delta", F.lit(0.0)), 6).alias("agent_delta_metric"), whole("history_total").alias("history_total"), whole("history_peak").alias("history_peak"), whole("depth").alias("history_depth"),
    ]
    fields = ["rank", "key", "score", "count", "prime_flux", "burstiness", "agent_delta_metric", "history_total", "history_peak", "history_depth", "is_peak"]
    n = scored.groupBy("stream", "interval_no").agg(F.count("*").alias("total_keys"))
    # the first k and the peaks are found apart, so that no interval's keys are ordered beyond them
    flags = members.select(*key, F.lit(True).alias("is_peak"))
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(flags, key, "left")
    top = top.select("stream", "interval_no", F.lit("top").alias("list"), "rank", "key", F.coalesce("is_peak", F.lit(False)).alias("is_peak"), *values)
    peaks = flags.join(scored.join(flags.select(*key), key, "left_semi"), key, "left").withColumn("rank", F.row_number().over(order))
    listed = top.unionByName(peaks.select("stream", "interval_no", F.lit("peaks").alias("list"), "rank", "key", "is_peak", *values))
    per = listed.groupBy("stream", "interval_no").agg(*(F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct(*fields)))).alias(name) for name in ("top", "peaks")))
    n = n.join(per, ["stream", "interval_no"], "full").withColumn("total_keys", whole("total_keys"))
    g = groups.select("interval_no", F.col("place").alias("rank"), F.col("ip_prefix").alias("prefix"), "score", F.col("hits").alias("count"), "members", "bytes", F.col("burst").alias("burstiness"), F.col("agent_delta").alias("agent_delta_metric"), F.col("depth").alias("history_depth"), "history")
    g = g.groupBy("interval_no").agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in g.columns if c not in ("rank", "interval_no"))))).alias("ip_groups")).withColumn("stream", F.lit("ips"))
    j = n.join(g, ["stream", "interval_no"], "left")
    return j.groupBy("interval_no").agg(F.array_sort(F.collect_list(F.struct(F.col("stream").alias("name"), "total_keys", "top", "peaks", "ip_groups"))).alias("interesting"))


def full_records(totals: DataFrame, matchers: DataFrame, interesting: DataFrame, tokens: DataFrame, sources: DataFrame, session: Column, start: Column) -> DataFrame:
    """One full nested record for each interval. totals: with total_lines, total_bytes and unmarked; tokens: (interval_no, ua_token_count, n_lines); sources: (interval_no, source_lines)."""
    t = tokens.groupBy("interval_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("ua_token_count").cast("string"), "n_lines")))).alias("agent_token_cardinality"))
    j = totals.join(matchers, "interval_no", "left").join(interesting, "interval_no", "left").join(t, "interval_no", "left").join(sources, "interval_no", "left")
    time = start.cast("string")
    return j.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("interval").alias("event_type"), session.alias("session_id"), time.alias("timestamp"), time.alias("log_time"), F.col("interval_no").alias("interval"), F.col("n_lines").alias("interval_lines"),
        "total_lines", "total_bytes", "errors", "unmarked", "agent_token_cardinality", "matchers", "interesting", "source_lines",
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """(line_no, value) as text files whose lines, taken file by file in path order, are in order of line_no."""
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.text(path)


def interval_records(totals: DataFrame, lanes: DataFrame, ranked: DataFrame, sessions: Column, starts: DataFrame) -> DataFrame:
    """One nested record for each interval. lanes: (name, interval_no, hits); ranked: (stream, key, interval_no, score, place)."""
    m = lanes.groupBy("interval_no").agg(F.array_sort(F.collect_list(F.struct("name", F.col("hits").alias("interval_count")))).alias("matchers"))
    per = ranked.groupBy("stream", "interval_no").agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("rank"), "key", "score"))).alias("top"), F.count("*").alias("total_keys"))
    k = per.groupBy("interval_no").agg(F.array_sort(F.collect_list(F.struct(F.col("stream").alias("name"), "total_keys", "top"))).alias("interesting"))
    j = totals.join(m, "interval_no", "left").join(k, "interval_no", "left").join(starts, "interval_no", "left")
    return j.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("interval").alias("event_type"), sessions.alias("session_id"), F.col("interval_start").cast("string").alias("timestamp"), F.col("interval_no").alias("interval"), F.col("n_lines").alias("interval_lines"), "total_lines", "total_bytes", "errors", "matchers", "interesting")


def write_interval_log(records: DataFrame, path: str) -> None:
    records.write.json(path, ignoreNullFields=True)


def write_event_log(events: DataFrame, path: str) -> None:
    """Alert or command rows beside the intervals, in folders by event type."""
    events.write.partitionBy("event_type").json(path, ignoreNullFields=True)


def parse_interval_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, issues) from (line_no, value). Blank lines are skipped; what is no JSON object becomes an issue with its first characters.

    Records lack no event type (unknown) or session (unscoped), and log_time falls back to timestamp.
    """
    filled = lines.where(F.trim("value") != "")
    parsed = filled.withColumn("j", F.from_json("value", RECORD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull() | ~F.ltrim("value").startswith("{")
    good = parsed.where(~bad).select("line_no", "j.*").drop("_bad")
    records = good.withColumn("event_type", F.coalesce("event_type", F.lit("unknown"))).withColumn("session_id", F.coalesce("session_id", F.lit("unscoped"))).withColumn("log_time", F.coalesce("log_time", "timestamp"))
    return records, parsed.where(bad).select("line_no", F.substring("value", 1, ISSUE_CHARS).alias("text"))


def read_interval_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and issues of the files in a folder; line_no is a line's true number from 1, file by file in path order."""
    return parse_interval_log(read_access_log(spark, path).select((F.col("line_id") + 1).alias("line_no"), F.col("line").alias("value")))


def session_index(records: DataFrame) -> DataFrame:
    own = F.col("event_type") != "session_start"
    return records.groupBy("session_id").agg(
        F.count("*").alias("records"), F.count_if(F.col("event_type") == "interval").alias("n_intervals"), F.count_if(F.col("event_type") == "alert").alias("alerts"),
        F.min(F.when(~own, F.col("line_no"))).alias("start_line"), F.array_join(F.transform(F.array_sort(F.collect_set("schema_version")), lambda x: x.cast("string")), ",").alias("versions"),
        F.min_by("log_time", F.when(own & F.col("log_time").isNotNull(), F.col("line_no"))).alias("first_time"), F.max_by("log_time", F.when(own & F.col("log_time").isNotNull(), F.col("line_no"))).alias("last_time"),
    )


def interval_series(records: DataFrame, lane: str) -> DataFrame:
    """Lines, bytes to date, errors and one lane's count for each interval record; null where the lane is absent."""
    found = F.get(F.filter("matchers", lambda m: m["name"] == lane), F.lit(0))
    return records.where("event_type = 'interval'").select("session_id", "interval", "interval_lines", "total_bytes", "errors", found["interval_count"].alias("lane_count"))


def flatten_lanes(records: DataFrame) -> DataFrame:
    return records.where("event_type = 'interval'").select("session_id", "interval", F.inline("matchers")).select("session_id", "interval", "name", "interval_count")


def flatten_keys(records: DataFrame) -> DataFrame:
    s = records.where("event_type = 'interval'").select("session_id", "interval", "line_no", F.explode("interesting").alias("s"))
    return s.select("session_id", "interval", "line_no", F.col("s.name").alias("stream"), F.inline("s.top")).select("session_id", "interval", "line_no", "stream", "key", "score", "rank")


def flatten_peaks(records: DataFrame) -> DataFrame:
    s = records.where("event_type = 'interval'").select("session_id", "interval", "line_no", F.explode("interesting").alias("s"))
    return s.select("session_id", "interval", "line_no", F.col("s.name").alias("stream"), F.inline("s.peaks")).select("session_id", "interval", "line_no", "stream", "key", "score", "count", "rank")


def flatten_lane_keys(records: DataFrame) -> DataFrame:
    m = records.where("event_type = 'interval'").select("session_id", "interval", F.explode("matchers").alias("m"))
    return m.select("session_id", "interval", F.col("m.name").alias("name"), F.inline("m.top_keys"))


def flatten_groups(records: DataFrame) -> DataFrame:
    """Address groups of the streams and prefix groups of the lanes, by owner (`ips`, or the lane's name)."""
    i = records.where("event_type = 'interval'").select("session_id", "interval", "line_no", "matchers", "interesting")
    own = ["session_id", "interval", "line_no"]
    of = lambda df: df.select(*own, "owner", "prefix", "rank", "count", "members")
    s = i.select(*own, F.explode("interesting").alias("s")).select(*own, F.col("s.name").alias("owner"), F.inline("s.ip_groups"))
    m = i.select(*own, F.explode("matchers").alias("m")).select(*own, F.col("m.name").alias("owner"), F.inline("m.top_groups"))
    return of(s).unionByName(of(m))


def flatten_notes(records: DataFrame) -> DataFrame:
    """(session_id, interval, line_no, command_name, status, field, value): the open result of each command, a row for each of its fields."""
    notes = _owned(records).where("event_type = 'command'")
    return notes.select("session_id", F.col("owner").alias("interval"), "line_no", "command_name", "status", F.explode_outer("result").alias("field", "value"))


def interval_percentages(records: DataFrame) -> DataFrame:
    """Lines, bytes and errors of each interval record by its lanes, and the shares of marked and of b16 lines; null where lane or key is absent."""
    lane = lambda n: F.get(F.filter("matchers", lambda m: m["name"] == n), F.lit(0))
    key = lambda k: F.get(F.filter(lane("lines")["top_keys"], lambda x: x["key"] == k), F.lit(0))["count"]
    share = lambda k: F.when(lane("lines")["interval_count"] > 0, F.round(key(k) * 100 / lane("lines")["interval_count"], 6))
    return records.where("event_type = 'interval'").select("session_id", "interval", "interval_lines", lane("bytes")["interval_count"].alias("bytes"), lane("errs")["interval_count"].alias("errors"), share("marked").alias("marked_percent"), share(" b16").alias("b16_percent"))


def track_lane(records: DataFrame, name: str) -> DataFrame:
    """One value for each interval: the lane's count, null where it is absent."""
    found = F.get(F.filter("matchers", lambda m: m["name"] == name), F.lit(0))
    return records.where("event_type = 'interval'").select("session_id", "interval", found["interval_count"].alias("value"))


def track_key(records: DataFrame, stream: str, key: str) -> DataFrame:
    """One value for each interval: the key's score, null where it is not listed."""
    own = flatten_keys(records).where((F.col("stream") == stream) & (F.col("key") == key)).select("session_id", "interval", "score")
    return records.where("event_type = 'interval'").select("session_id", "interval").join(own, ["session_id", "interval"], "left")


def notes_to_interval(records: DataFrame) -> DataFrame:
    """(line_no, session_id, command_name, interval): a command belongs to the next interval of its session in file order."""
    ahead = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(0, Window.unboundedFollowing)
    mine = F.first(F.when(F.col("event_type") == "interval", F.col("interval")), ignorenulls=True).over(ahead)
    return records.withColumn("owner", mine).where("event_type = 'command'").select("line_no", "session_id", "command_name", F.col("owner").alias("interval"))


def search_log(records: DataFrame, text: str) -> DataFrame:
    """Keys and notes that contain a text in any case, newest first by line."""
    needle = F.lower(F.lit(text))
    keys = flatten_keys(records).select("session_id", "interval", "line_no", F.col("stream").alias("kind"), F.col("key").alias("found"))
    notes = notes_to_interval(records).select("session_id", "interval", "line_no", F.lit("note").alias("kind"), F.col("command_name").alias("found"))
    return keys.unionByName(notes).where(F.contains(F.lower("found"), needle))


def search_everything(records: DataFrame, text: str) -> DataFrame:
    """(session_id, interval, line_no, kind, found): keys (first ones and peaks), prefixes and notes that contain a text in any case.

    Each row belongs to its interval; newest first is descending line_no.
    """
    of = lambda df, kind, found: df.select("session_id", "interval", "line_no", kind.alias("kind"), F.col(found).alias("found"))
    rows = of(flatten_keys(records), F.col("stream"), "key").unionByName(of(flatten_peaks(records), F.col("stream"), "key"))
    rows = rows.unionByName(of(flatten_groups(records), F.lit("prefix"), "prefix")).unionByName(of(notes_to_interval(records), F.lit("note"), "command_name"))
    return rows.where(F.contains(F.lower("found"), F.lower(F.lit(text)))).distinct()


def search_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("session_id", "interval").agg(F.count("*").alias("hits"))


def alert_timeline(records: DataFrame) -> DataFrame:
    """Alerts of schema 4 that name their interval, with their interval's lines."""
    own = records.where("event_type = 'alert' and schema_version = 4 and interval is not null")
    return own.groupBy("session_id", "interval").agg(F.count("*").alias("alerts"), F.array_join(F.array_sort(F.collect_list("matcher")), ",").alias("lanes"))


def alerts_by_interval(records: DataFrame) -> DataFrame:
    i = records.where("event_type = 'interval'").select("session_id", "interval", "interval_lines")
    return i.join(alert_timeline(records), ["session_id", "interval"], "left").select("session_id", "interval", "interval_lines", F.coalesce("alerts", F.lit(0)).alias("alerts"))


def _owned(records: DataFrame) -> DataFrame:
    """Adds owner: the interval a row belongs to (alerts by number, others by the next interval in file order)."""
    ahead = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(0, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("event_type") == "interval", F.col("interval")), ignorenulls=True).over(ahead)
    return records.withColumn("owner", F.when(F.col("event_type") == "alert", F.col("interval")).otherwise(nxt))


def select_range(records: DataFrame, session: str, first: int, last: int) -> DataFrame:
    """The rows of one session that an inclusive range of intervals owns, and its session start."""
    own = _owned(records.where(F.col("session_id") == session))
    return own.where(F.col("owner").between(first, last) | (F.col("event_type") == "session_start")).drop("owner")


def range_errors(records: DataFrame, session: str, first: int, last: int) -> DataFrame:
    """One row for each failed check of a range: starts of the session, ends of the range, their order, repeats, and a session start of any session inside it."""
    own = F.col("session_id") == session
    interval = own & (F.col("event_type") == "interval")
    start = F.col("event_type") == "session_start"
    c = records.agg(
        F.count_if(own & start).alias("starts"),
        F.count_if(interval & (F.col("interval") == first)).alias("firsts"),
        F.count_if(interval & (F.col("interval") == last)).alias("lasts"),
        (F.count_if(interval) - F.count_distinct(F.when(interval, F.col("interval")))).alias("repeats"),
        F.min(F.when(interval & (F.col("interval") == first), F.col("line_no"))).alias("from_line"),
        F.max(F.when(interval & (F.col("interval") == last), F.col("line_no"))).alias("through_line"),
    )
    # a session start between both ends, this session's or another's, cuts the range in two
    inside = records.where(start).select("line_no").crossJoin(F.broadcast(c.select("from_line", "through_line"))).where((F.col("line_no") > F.col("from_line")) & (F.col("line_no") < F.col("through_line"))).agg(F.count("*").alias("cuts"))
    c = c.crossJoin(F.broadcast(inside))  # one row each
    checks = {
        "missing_session_start": F.col("starts") == 0, "duplicate_session_start": F.col("starts") > 1, "missing_start": F.col("firsts") == 0, "ambiguous_start": F.col("firsts") > 1,
        "missing_end": F.col("lasts") == 0, "ambiguous_end": F.col("lasts") > 1, "reversed": F.lit(first > last) | F.coalesce(F.col("from_line") > F.col("through_line"), F.lit(False)), "duplicate_interval": F.col("repeats") > 0, "session_boundary": F.col("cuts") > 0,
    }
    return c.select(F.explode(F.array(*(F.when(x, F.lit(n)) for n, x in checks.items()))).alias("code")).where("code is not null")


def range_manifest(selected: DataFrame) -> DataFrame:
    """One row: records, intervals, those that kept source lines, both ends with their times, schema versions."""
    interval = F.col("event_type") == "interval"
    at = lambda f, c: f(c, F.when(interval, F.col("interval")))
    return selected.agg(
        F.count("*").alias("records"), F.count_if(interval).alias("n_intervals"), F.count_if(interval & (F.size("source_lines") > 0)).alias("retained_source_intervals"), F.min(F.when(interval, F.col("interval"))).alias("first_interval"),
        F.max(F.when(interval, F.col("interval"))).alias("last_interval"), at(F.min_by, "log_time").alias("first_time"), at(F.max_by, "log_time").alias("last_time"),
        F.array_join(F.transform(F.array_sort(F.collect_set("schema_version")), lambda x: x.cast("string")), ",").alias("versions"),
    )


def validate_range(selected: DataFrame, manifest: DataFrame) -> DataFrame:
    """(field, stated, found) where a manifest and its records disagree."""
    names = manifest.columns
    side = lambda df, v: df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias(v)) for n in names))).alias("x")).select("x.*")
    return side(manifest, "stated").join(side(range_manifest(selected), "found"), "field").where(~F.col("stated").eqNullSafe(F.col("found")))


def export_range(lines: DataFrame, selected: DataFrame, path: str) -> None:
    """The chosen records' original lines in file order, and a manifest row."""
    lines.join(selected.select("line_no"), "line_no", "left_semi").orderBy("line_no").select("value").write.text(f"{path}/records")
    range_manifest(selected).write.json(f"{path}/manifest")


def source_catalog(examples: DataFrame) -> DataFrame:
    """(interval_no, name, line_id, ref): example lines of an interval numbered from 1 in the order of first use (by lane name).

    examples: (name, interval_no, first_ever_id, first_line_id, last_line_id); an entry shows its last line, else its first.
    """
    shown = examples.select("interval_no", "name", F.coalesce("last_line_id", "first_line_id", "first_ever_id").alias("line_id"))
    first = shown.withColumn("used", F.min("name").over(Window.partitionBy("interval_no", "line_id")))
    order = Window.partitionBy("interval_no").orderBy("used", "line_id")
    return first.withColumn("ref", F.dense_rank().over(order)).select("interval_no", "name", "line_id", "ref")


def peak_reset_phases(records: DataFrame) -> DataFrame:
    """The two intervals after an applied purge of a session: reset, then rebaseline."""
    order = Window.partitionBy("session_id").orderBy("line_no")
    purge = (F.col("event_type") == "command") & (F.col("command_name") == "purge") & (F.col("status") == "applied")
    own = records.withColumn("purge", F.sum(purge.cast("int")).over(order)).where("event_type = 'interval' and purge > 0")
    n = F.row_number().over(Window.partitionBy("session_id", "purge").orderBy("line_no"))
    return own.withColumn("n", n).where("n <= 2").select("session_id", "interval", F.when(F.col("n") == 1, "reset").otherwise("rebaseline").alias("phase"))


def compare_lanes(lanes: DataFrame, a: int, b: int) -> DataFrame:
    """Lanes of two intervals side by side, with their places by hits."""
    def one(k: int, s: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("interval_no").orderBy(F.desc("hits"), "name"))
        return lanes.where(F.col("interval_no") == k).select("name", F.col("hits").alias(f"hits_{s}"), place.alias(f"place_{s}"))

    return one(a, "a").join(one(b, "b"), "name", "full").withColumn("delta", F.coalesce("hits_b", F.lit(0)) - F.coalesce("hits_a", F.lit(0)))


def compare_intervals(shape: DataFrame, distance: int) -> DataFrame:
    """Each interval against the one so many intervals later: differences of the scalar measures."""
    a, b = shape.alias("a"), shape.alias("b")
    j = a.join(b, F.col("b.interval_no") == F.col("a.interval_no") + distance)
    diff = lambda c, n: F.round(F.col(f"b.{c}") - F.col(f"a.{c}"), 6).alias(n)
    return j.select(F.col("a.interval_no").alias("interval_a"), F.col("b.interval_no").alias("interval_b"), (F.col("b.n_lines") - F.col("a.n_lines")).alias("lines_delta"), (F.col("b.bytes") - F.col("a.bytes")).alias("bytes_delta"), (F.col("b.errors") - F.col("a.errors")).alias("errors_delta"), diff("marked_pct", "marked_delta"), diff("b16_pct", "b16_delta"))
