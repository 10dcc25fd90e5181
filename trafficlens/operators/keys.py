"""Key streams: words, referers and addresses with counts for each interval, retention, strength, ranks and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

STREAMS = ("words", "refs", "ips")
DEPTH = 80


def stream_tokens() -> dict[str, Column]:
    """Token arrays of the three streams. Any array column can be a stream."""
    return {"words": T.word_tokens(F.col("ua_tokens"), F.col("request")), "refs": T.referer_tokens(F.col("referer")), "ips": T.ip_tokens(F.col("ip"))}


def key_hits(requests: DataFrame, streams: dict[str, Column] | None = None) -> DataFrame:
    """(stream, key, interval_no, line_id, bytes, status): one row for each token; repeats count. A line's distance is kept if there.

    One walk over the lines for all streams, however costly the lines are.
    """
    own = ["interval_no", "line_id", "bytes", "status", *(c for c in ("distance",) if c in requests.columns)]
    lists = requests.select(*own, F.inline(F.array(*(F.struct(F.lit(n).alias("stream"), c.alias("keys")) for n, c in (streams or stream_tokens()).items()))))
    return lists.select("stream", F.explode("keys").alias("key"), *own)


def key_intervals(hits: DataFrame) -> DataFrame:
    """Counts of each key and interval; of hits with a distance also moved, its sum, and first_moved, that of the first hit."""
    more = [F.sum("distance").alias("moved"), F.min_by("distance", "line_id").alias("first_moved")] if "distance" in hits.columns else []
    return hits.groupBy("stream", "key", "interval_no").agg(
        F.count("*").alias("hits"), F.sum("bytes").alias("bytes"), F.max_by("status", "line_id").alias("last_status"), F.min("line_id").alias("first_line_id"), F.max("line_id").alias("last_line_id"), *more
    )


def retention_ttl(spark, push: int = 5) -> DataFrame:
    """(stream, ttl_seconds) at one purge intensity; values outside 0 to 11 count as the nearest."""
    row = V.RETENTION[min(11, max(0, push))]
    return spark.createDataFrame(list(zip(STREAMS, row, strict=True)), "stream string, ttl_seconds int")


def ttl_column(push: int = 5) -> Column:
    row = V.RETENTION[min(11, max(0, push))]
    return F.when(F.col("stream") == "words", row[0]).when(F.col("stream") == "refs", row[1]).otherwise(row[2])


def prime_flux(keys: DataFrame, flux: int = 3) -> DataFrame:
    """Adds prime_flux: this interval's count and the sum of the last completed ones. Missing intervals count as 0."""
    w = Window.partitionBy("stream", "key").orderBy("interval_no").rangeBetween(-flux, -1)
    return keys.withColumn("prime_flux", F.col("hits") + F.coalesce(F.sum("hits").over(w), F.lit(0)))


def retention_islands(keys: DataFrame, push: int = 5, interval_seconds: int = 60) -> DataFrame:
    """Adds island_start: a key that was quiet for longer than its time to live starts anew."""
    order = Window.partitionBy("stream", "key").orderBy("interval_no")
    gap = F.col("interval_no") - F.lag("interval_no").over(order)
    new = gap.isNull() | (gap > F.floor(ttl_column(push) / interval_seconds))
    out = keys.withColumn("new_at", F.when(new, F.col("interval_no")))
    return out.withColumn("island_start", F.last("new_at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new_at")


def with_silent(islands: DataFrame, push: int = 5, interval_seconds: int = 60, closing: bool = False) -> DataFrame:
    """Adds a row without hits for each quiet interval through which a key is still retained.

    There it ranks by what its last intervals hold, and counts among the retained keys; agent_delta, if there, stays what it was.
    The end of the table ends retention. closing: only the intervals whose close the key lives to see, one less.
    """
    order = Window.partitionBy("stream", "key").orderBy("interval_no")
    here, last = F.col("interval_no"), islands.agg(F.max("interval_no").alias("last_no"))  # one row
    until = F.least(here + F.floor(ttl_column(push) / interval_seconds) - int(closing), F.col("next_no") - 1, F.col("last_no"))
    rows = islands.withColumn("next_no", F.lead("interval_no").over(order)).crossJoin(F.broadcast(last))
    rows = rows.withColumn("at", F.explode(F.sequence(here, F.greatest(until, here))))
    kept = ("stream", "key", "island_start", "agent_delta")
    value = lambda c: F.col(c) if c in kept else F.when(F.col("at") == here, F.col(c)).otherwise(F.lit(0) if c in ("hits", "bytes") else F.lit(None)).alias(c)
    return rows.select(*(F.col("at").alias(c) if c == "interval_no" else value(c) for c in islands.columns))


def key_state(islands: DataFrame, flux: int = 3, depth: int = DEPTH) -> DataFrame:
    """Adds depth, history_total, history_peak, history_squares and prime_flux over the completed intervals of the island.

    Range frames stand for the zero-filled history: absent intervals add nothing to a sum.
    """
    own = Window.partitionBy("stream", "key", "island_start").orderBy("interval_no")
    past, recent = own.rangeBetween(-depth, -1), own.rangeBetween(-flux, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        islands.withColumn("depth", F.least(F.lit(depth), F.col("interval_no") - F.col("island_start")))
        .withColumn("history_total", zero(F.sum("hits").over(past)))
        .withColumn("history_peak", zero(F.max("hits").over(past)))
        .withColumn("history_squares", zero(F.sum(F.col("hits") * F.col("hits")).over(past)))
        .withColumn("prime_flux", F.col("hits") + zero(F.sum("hits").over(recent)))
    )


def burstiness(total: Column, squares: Column, depth: Column, agent_delta: Column | None = None, most: int = DEPTH) -> Column:
    """(deviation / mean) (1 + agent_delta) depth / most over the completed history; 0 at depth 1 or without hits."""
    mean = total / depth
    spread = F.sqrt(F.greatest(squares / depth - mean * mean, F.lit(0.0))) / mean
    out = spread * depth / most * (1 + agent_delta if agent_delta is not None else F.lit(1))
    return F.when((depth <= 1) | (total == 0), F.lit(0.0)).otherwise(out)


def normalized_strength(total: Column, depth: Column, hits: Column, agent_delta: Column | None = None, scale: float = 1.0) -> Column:
    """Mean of the history, scaled; the count itself where there is no history."""
    return F.when(depth == 0, hits.cast("double")).otherwise(total / depth * scale * (1 + agent_delta if agent_delta is not None else F.lit(1)))


def with_agent_delta(islands: DataFrame, memory: int = 48) -> DataFrame:
    """Adds agent_delta: the running mean of the lines' distances, whose weight restarts in each interval: (m + moved) / (hits + 1).

    An island starts at 0, and the hit that begins it does not count. Every interval with hits at least halves what came before, so
    the last `memory` rows decide it to 14 digits, and no row needs its whole island. Silent rows change nothing: add them after this.
    """
    order = Window.partitionBy("stream", "key", "island_start").orderBy("interval_no")
    begun = F.when(F.col("interval_no") == F.col("island_start"), F.coalesce("first_moved", F.lit(0.0))).otherwise(0.0)
    steps = islands.withColumn("step", F.struct((F.coalesce("moved", F.lit(0.0)) - begun).alias("moved"), (F.col("hits") + 1).alias("n")))
    steps = steps.withColumn("steps", F.collect_list("step").over(order.rowsBetween(-memory, 0)))
    return steps.withColumn("agent_delta", F.aggregate("steps", F.lit(0.0), lambda m, x: (m + x["moved"]) / x["n"])).drop("step", "steps")


def with_scores(state: DataFrame) -> DataFrame:
    """Adds burst, strength and score; burst and strength grow with agent_delta where state has it."""
    t, q, d, n = (F.col(c) for c in ("history_total", "history_squares", "depth", "hits"))
    delta = F.col("agent_delta") if "agent_delta" in state.columns else None
    return state.withColumn("burst", F.round(burstiness(t, q, d, delta), 6)).withColumn("strength", F.round(normalized_strength(t, d, n, delta), 6)).withColumn("score", n + F.col("prime_flux"))


def norm_denominator(totals: DataFrame, flux: int = 3) -> DataFrame:
    """(interval_no, denominator): what a strength is measured against at each interval's close."""
    order = Window.orderBy("interval_no")
    top = F.coalesce(F.max("n_lines").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    peaks = totals.select("interval_no", "n_lines", top.alias("top"))
    mean5 = F.avg("n_lines").over(order.rowsBetween(-4, 0))
    last3 = F.sum("top").over(order.rowsBetween(-2, 0))
    out = F.when(F.col("top") == 0, mean5 / 10).otherwise((last3 + 2 * mean5) / ((flux + 2) * 10))
    return peaks.select("interval_no", F.round(out, 6).alias("denominator"))


def closed_state(retained: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Adds depth, burst and strength as they are when an interval has just closed: it belongs to the history already.

    retained: rows of with_silent(closing=True); agent_delta counts where it is there.
    """
    past = Window.partitionBy("stream", "key", "island_start").orderBy("interval_no").rangeBetween(1 - depth, 0)
    rows = retained.select(
        "*",
        F.least(F.lit(depth), F.col("interval_no") - F.col("island_start") + 1).alias("depth"),
        F.sum("hits").over(past).alias("history_total"),
        F.sum(F.col("hits") * F.col("hits")).over(past).alias("history_squares"),
    )
    t, q, d = F.col("history_total"), F.col("history_squares"), F.col("depth")
    delta = F.col("agent_delta") if "agent_delta" in retained.columns else None
    return rows.withColumn("burst", F.round(burstiness(t, q, d, delta), 6)).withColumn("strength", F.round(normalized_strength(t, d, F.col("hits"), delta), 6))


def peak_candidates(closed: DataFrame, denominators: DataFrame, line_means: DataFrame, grace: int = 15) -> DataFrame:
    """Rows of closed_state whose key may become a peak at the close of their interval, with the strength that orders them.

    Words and referers need a strength of the denominator at least. Addresses need more than 10 hits and a burst of 1, or more hits
    than a tenth of line_mean; their strength is their number of hits.
    """
    j = closed.join(F.broadcast(denominators), "interval_no").join(F.broadcast(line_means), "interval_no")
    ips = F.col("stream") == "ips"
    strong = ~ips & (F.col("strength") / F.col("denominator") >= 1)
    busy = ips & (((F.col("hits") > 10) & (F.col("burst") >= 1)) | (F.col("hits") > F.col("line_mean") / 10))
    strength = F.when(ips, F.col("hits").cast("double")).otherwise(F.col("strength"))
    return j.where((F.col("depth") >= grace) & (strong | busy)).select("stream", "key", "interval_no", "hits", strength.alias("strength"), "burst")


def line_means(totals: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(interval_no, line_mean): mean of the last three maxima of lines, each over the intervals completed before it."""
    order = Window.orderBy("interval_no")
    top = totals.select("interval_no", F.coalesce(F.max("n_lines").over(order.rowsBetween(-depth, -1)), F.lit(0)).alias("top"))
    return top.select("interval_no", F.round(F.avg("top").over(order.rowsBetween(-2, 0)), 6).alias("line_mean"))


def rank_keys(scored: DataFrame, k: int = 25) -> DataFrame:
    order = Window.partitionBy("stream", "interval_no").orderBy(F.desc("score"), "key")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def rank_ips_display(scored: DataFrame, marked: DataFrame, k: int = 25) -> DataFrame:
    """Addresses by score, with bursts (and agent_delta, if there) added above a flux of 8; marked ones first on ties."""
    own = scored.where("stream = 'ips'").join(marked.select(F.col("ip").alias("key"), "interval_no", F.lit(True).alias("marked")).distinct(), ["key", "interval_no"], "left")
    delta = (F.col("agent_delta") * 10).cast("int") if "agent_delta" in scored.columns else F.lit(0)
    value = F.col("score") + F.when(F.col("prime_flux") > 8, (F.col("burst") * 100).cast("int") + delta).otherwise(0)
    out = own.select("key", "interval_no", value.cast("long").alias("value"), F.coalesce("marked", F.lit(False)).alias("marked"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("interval_no").orderBy(F.desc("value"), F.desc("marked"), "key"))).where(F.col("place") <= k)


def ip_groups(scored: DataFrame, min_members: int = 15, k: int | None = None) -> DataFrame:
    """Address prefixes with enough retained members in an interval: sums over the members, mean burst, deepest history, mean agent_delta if there.

    k: only the first so many of each interval, by score descending and prefix ascending, with their place.
    """
    more = [F.round(F.avg("agent_delta"), 6).alias("agent_delta")] if "agent_delta" in scored.columns else []
    own = scored.where("stream = 'ips'").withColumn("ip_prefix", T.ip_prefix(F.col("key")))
    # summed in whole millionths, so that the order of addition does not decide a half
    mean_burst = F.round(F.sum(F.round(F.col("burst") * 1_000_000).cast("long")) / F.count("*")) / 1_000_000
    g = own.groupBy("ip_prefix", "interval_no").agg(F.count("*").alias("members"), F.sum("hits").alias("hits"), F.sum("prime_flux").alias("prime_flux"), F.sum("bytes").alias("bytes"), mean_burst.alias("burst"), F.max("depth").alias("depth"), *more)
    g = g.where(F.col("members") >= min_members).withColumn("score", F.col("hits") + F.col("prime_flux"))
    return g if k is None else g.withColumn("place", F.row_number().over(Window.partitionBy("interval_no").orderBy(F.desc("score"), "ip_prefix"))).where(F.col("place") <= k)


def ip_group_history(scored: DataFrame, groups: DataFrame, depth: int = DEPTH) -> DataFrame:
    """groups (of ip_groups) with history: the zero-filled sums of the members' counts in the intervals before, oldest first.

    A count belongs to the history of every later interval that its key's island reaches, so counts are summed by how far they reach
    and only these sums, depth at most of each prefix and interval, are spread over the intervals: no key is paired with its past.
    """
    own = scored.where("stream = 'ips'").select("key", "interval_no", "hits", F.max("interval_no").over(Window.partitionBy("key", "island_start")).alias("ends"))
    reach = F.least(F.col("ends") - F.col("interval_no"), F.lit(depth))
    per = own.where("hits > 0").groupBy(T.ip_prefix(F.col("key")).alias("ip_prefix"), F.col("interval_no").alias("at"), reach.alias("reach")).agg(F.sum("hits").alias("hits")).where("reach > 0")
    far = Window.partitionBy("ip_prefix", "at").orderBy(F.desc("reach"))
    per = per.select("ip_prefix", "at", "reach", F.sum("hits").over(far).alias("hits"), F.coalesce(F.lead("reach").over(far), F.lit(0)).alias("nearer"))
    per = per.select("ip_prefix", "at", "hits", F.explode(F.sequence(F.col("at") + F.col("nearer") + 1, F.col("at") + F.col("reach"))).alias("interval_no"))
    per = per.join(groups.select("ip_prefix", "interval_no"), ["ip_prefix", "interval_no"], "left_semi")
    sums = per.groupBy("ip_prefix", "interval_no").agg(F.map_from_entries(F.collect_list(F.struct("at", "hits"))).alias("sums"))
    i = F.col("interval_no")
    filled = F.transform(F.sequence(i - F.col("depth"), i - 1), lambda at: F.coalesce(F.col("sums")[at], F.lit(0).cast("long")))
    history = F.when(F.col("depth") == 0, F.array().cast("array<bigint>")).otherwise(filled)
    return groups.join(sums, ["ip_prefix", "interval_no"], "left").select(*groups.columns, history.alias("history"))


def prefix_census(scored: DataFrame, min_members: int = 15) -> DataFrame:
    """Of each interval: prefixes, active prefixes, addresses for each prefix."""
    own = scored.where("stream = 'ips'").groupBy(T.ip_prefix(F.col("key")).alias("ip_prefix"), "interval_no").agg(F.count("*").alias("members"))
    return own.groupBy("interval_no").agg(F.count("*").alias("prefixes"), F.count_if(F.col("members") >= min_members).alias("active"), F.round(F.avg("members"), 6).alias("mean_members"))


def new_key_rate(islands: DataFrame, totals: DataFrame) -> DataFrame:
    """Keys that begin in an interval for each of its lines."""
    new = islands.where("interval_no = island_start").groupBy("stream", "interval_no").agg(F.count("*").alias("created"))
    return new.join(F.broadcast(totals.select("interval_no", "n_lines")), "interval_no").select("stream", "interval_no", "created", F.round(F.col("created") / F.col("n_lines"), 6).alias("rate"))


def one_hit_share(state: DataFrame) -> DataFrame:
    return state.groupBy("stream", "interval_no").agg(F.count("*").alias("n_keys"), F.round(F.count_if(F.col("prime_flux") == 1) / F.count("*"), 6).alias("one_hit"))


def full_history(state: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Keys that have been present since the first interval, or for as long as history goes back."""
    return state.where(F.col("depth") == F.least(F.col("interval_no"), F.lit(depth))).select("stream", "key", "interval_no", "depth")


def key_history(islands: DataFrame, at: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """(stream, key, history): zero-filled counts before interval `at` of the keys retained there, oldest first.

    Without at: of every key, before its latest interval.
    """
    seen = islands if at is None else islands.where(F.col("interval_no") < at)
    last = seen.groupBy("stream", "key").agg(F.max("island_start").alias("island_start"), F.max("interval_no" if at is None else at).alias("at"))
    own = seen.join(last, ["stream", "key", "island_start"]).where(F.col("interval_no") >= F.col("at") - depth)
    grid = own.groupBy("stream", "key", "island_start", "at").agg(F.map_from_entries(F.collect_list(F.struct("interval_no", "hits"))).alias("m"))
    first, end = F.greatest(F.col("island_start"), F.col("at") - depth), F.col("at")
    filled = F.transform(F.sequence(first, end - 1), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long")))
    return grid.select("stream", "key", F.when(first < end, filled).otherwise(F.array().cast("array<bigint>")).alias("history"))


def first_agents(requests: DataFrame, push: int = 5, interval_seconds: int = 60) -> DataFrame:
    """(ip, interval_no, first_line_id, first_agent, first_tokens): the first line retained for an address, for each interval with lines of it."""
    per = requests.groupBy(F.lit("ips").alias("stream"), F.col("ip").alias("key"), "interval_no").agg(F.min(F.struct("line_id", "user_agent", "ua_tokens")).alias("begun"))
    island = Window.partitionBy("stream", "key", "island_start").orderBy("interval_no")
    first = F.first("begun").over(island)
    return retention_islands(per, push, interval_seconds).select(F.col("key").alias("ip"), "interval_no", first["line_id"].alias("first_line_id"), first["user_agent"].alias("first_agent"), first["ua_tokens"].alias("first_tokens"))


def token_distance(a: Column, b: Column) -> Column:
    """Edits that turn one list of tokens into the other, by the length of the first; 2 where either is empty.

    Tokens become single characters of two bytes each, so that the built-in distance applies; about 55,000 different ones can be told
    apart, and more give null.
    """
    words = F.array_distinct(F.concat(a, b))
    code = lambda t: F.decode(F.unhex(F.array_join(F.transform(t, lambda x: F.lpad(F.hex(F.array_position(words, x) + 255), 4, "0")), "")), "UTF-16BE")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(2.0)).when(F.size(words) <= 55_000, F.levenshtein(code(a), code(b)) / F.size(a))


def with_agent_distance(requests: DataFrame, push: int = 5, interval_seconds: int = 60) -> DataFrame:
    """Adds distance: token edit distance of a line's agent from the first one retained for its address; 0 for that line and its like.

    One join of the lines, by address and interval, to the first agents; Spark splits an address with very many lines.
    """
    j = requests.join(first_agents(requests, push, interval_seconds), ["ip", "interval_no"], "left")
    differs = (F.col("line_id") > F.col("first_line_id")) & (F.col("user_agent") != F.col("first_agent"))
    distance = F.when(differs, F.round(token_distance(F.col("first_tokens"), F.col("ua_tokens")), 6)).otherwise(0.0)
    return j.select(*requests.columns, distance.alias("distance"), differs.alias("agent_differs"))


def agent_distance(requests: DataFrame, push: int = 5, interval_seconds: int = 60) -> DataFrame:
    """(line_id, ip, interval_no, distance) of the lines of a known address whose agent text differs from its first one."""
    return with_agent_distance(requests, push, interval_seconds).where("agent_differs").select("line_id", "ip", "interval_no", "distance")


def agent_delta(requests: DataFrame, distances: DataFrame, push: int = 5, interval_seconds: int = 60) -> DataFrame:
    """(ip, interval_no, agent_delta) of the addresses, as in with_agent_delta; the first line of an island has no distance."""
    n = requests.groupBy("ip", "interval_no").agg(F.count("*").alias("hits")).join(distances.groupBy("ip", "interval_no").agg(F.sum("distance").alias("moved")), ["ip", "interval_no"], "left")
    per = n.select(F.lit("ips").alias("stream"), F.col("ip").alias("key"), "interval_no", "hits", "moved", F.lit(0.0).alias("first_moved"))
    return with_agent_delta(retention_islands(per, push, interval_seconds)).select(F.col("key").alias("ip"), "interval_no", F.round("agent_delta", 6).alias("agent_delta"))


def most_volatile(lanes: DataFrame, n_intervals: Column, k: int = 3) -> DataFrame:
    """The k lanes of highest spikiness over all intervals; lanes without any are left out."""
    return lane_volatility(lanes, n_intervals).where("spikiness > 0").orderBy(F.desc("spikiness"), "name").limit(k)


def most_active(lanes: DataFrame, k: int = 3) -> DataFrame:
    """The k lanes with the highest last and current count together."""
    order = Window.partitionBy("name").orderBy(F.desc("interval_no"))
    two = lanes.withColumn("back", F.row_number().over(order)).where("back <= 2").groupBy("name").agg(F.sum("hits").alias("recent"))
    return two.orderBy(F.desc("recent"), "name").limit(k)


def spikiness(peak: Column, mean: Column) -> Column:
    """(peak - mean) ln peak; peaks below 10 do not count."""
    return F.when((peak < 10) | (peak <= mean), F.lit(0.0)).otherwise((peak - mean) * F.ln(peak))


def lane_volatility(lanes: DataFrame, n_intervals: Column) -> DataFrame:
    """(name, spikiness, burstiness) of each lane over all intervals, absent ones as 0."""
    g = lanes.groupBy("name").agg(F.max("hits").alias("peak"), F.sum("hits").alias("total"), F.sum(F.col("hits") * F.col("hits")).alias("squares"))
    mean = F.col("total") / n_intervals
    deviation = F.sqrt(F.greatest(F.col("squares") / n_intervals - mean * mean, F.lit(0.0)))
    return g.select("name", F.round(spikiness(F.col("peak"), mean), 6).alias("spikiness"), F.round(deviation / mean, 6).alias("burstiness"))


def promote_ip(scored: DataFrame, marked: DataFrame, totals: DataFrame, means: DataFrame, least_depth: int = 5) -> DataFrame:
    """The busiest unmarked address of each interval, if it has enough history, a whole tenth of the lines and the mean of recent maxima."""
    seen = marked.where("mark is not null").select(F.col("ip").alias("key"), "interval_no").distinct()
    own = scored.where((F.col("stream") == "ips") & (F.col("depth") > least_depth)).join(seen, ["key", "interval_no"], "left_anti")
    top = own.groupBy("interval_no").agg(F.max_by("key", F.struct("hits", F.col("first_line_id") * -1)).alias("ip"), F.max("hits").alias("hits"))
    j = top.join(F.broadcast(totals.select("interval_no", "n_lines")), "interval_no").join(F.broadcast(means), "interval_no")
    return j.where((F.col("hits") >= F.col("line_mean")) & (F.col("hits") >= F.floor(F.col("n_lines") / 10))).select("interval_no", "ip", "hits")


def seed_lane_history(keys, lane_rows, name: str, key: str, valid_from: int):
    """A rule made from a retained key begins with that key's history: of addresses, else referers, else words."""
    order = F.when(F.col("stream") == "ips", 0).when(F.col("stream") == "refs", 1).otherwise(2)
    own = keys.where((F.col("key") == key) & (F.col("interval_no") < valid_from))
    first = own.agg(F.min_by("stream", order).alias("stream"))  # one row
    seeded = own.join(F.broadcast(first), "stream").select(F.lit(name).alias("name"), "interval_no", "hits")
    return seeded.unionByName(lane_rows.where((F.col("name") == name) & (F.col("interval_no") >= valid_from)).select("name", "interval_no", "hits"))
