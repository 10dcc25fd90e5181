"""Rule lanes: which rules a request meets, which one claims it, whom a rule remembers, how a request is marked.

A rule table has (name, rank, lane, scope, patterns, valid_from, valid_to). It is small by nature and its size is checked. Up to
INLINE_RULES rules become literal predicates, which Spark compiles; of larger tables the plain scopes travel as one array in a one-row
broadcast. So every per-line question is answered without a shuffle; only memory, which spans lines, joins on the address.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: A rule table beyond this many rows is refused: it is sent to every task.
MOST_RULES = 10_000
#: Tables up to this many rules become literal predicates.
INLINE_RULES = 64
#: The patterns of expr are Spark SQL conditions over the columns of a request.
SCOPES = ("line", "refs", "code", "words", "ips", "starts", "regex", "bots", "expr")
LANES = ("compete", "bots", "observe")
RULE_SCHEMA = "name string, rank int, lane string, scope string, patterns array<string>, valid_from long, valid_to long"
BOTS = "Bots"
#: What a condition may ask about.
REQUEST = "line_id long, ts timestamp_ntz, ip string, ip_prefix string, request string, status string, bytes long, referer string, user_agent string, line string"
#: The packaged patterns of the optional browser and platform lanes.
BROWSER = r"(?i)\b(Chrome|CriOS|Firefox|FxiOS|Safari|DuckDuckGo|Edg|Edge|OPR|MSIE|Trident|Brave|PlayStation|Vivaldi|Baidu|SeaMonkey|Maxthon|Puffin|Silk|Sogou|Dolfin|IceCat|Iceweasel|Waterfox|K-Meleon|PaleMoon|Avant|Epiphany)[/\s]?"
PLATFORM = r"(?i)(Windows|Android|iPhone|Mac OS)"


def address_hint(patterns: Column) -> Column:
    """Whether all patterns look like addresses: a digit first and two dots at least."""
    return F.forall(patterns, lambda p: (F.length(p) - F.length(F.replace(p, F.lit("."), F.lit(""))) >= 2) & p.rlike("^[0-9]"))


def rules_from_rows(spark: SparkSession, rows: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(rules, rejects) from (name, lane, scope, patterns) declarations in order. Rejects have a reason: empty, duplicate, scope, lane, regex."""
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, name string, lane string, scope string, patterns array<string>")
    return check_rules(raw)


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same from JSON lines with name, lane, scope, patterns; file order is rule order."""
    raw = spark.read.schema("name string, lane string, scope string, patterns array<string>").json(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(Window.orderBy("file", "block", "at"))  # MOST_RULES rows at most
    return check_rules(raw.limit(MOST_RULES + 1).withColumn("place", place).drop("file", "block", "at"))


def _unusable(raw: DataFrame) -> list[str]:
    """The regex patterns that do not compile and the conditions that do not parse; judged on the driver, as rules are few."""
    spark, bad = raw.sparkSession, []
    request = spark.createDataFrame([], REQUEST)
    for scope, p in raw.where(F.col("scope").isin("regex", "expr")).select("scope", F.explode("patterns").alias("p")).where("p is not null").distinct().limit(MOST_RULES * 10).collect():
        try:
            spark._jvm.java.util.regex.Pattern.compile(p) if scope == "regex" else request.where(p)
        except (Py4JJavaError, PySparkException):
            bad.append(p)
    return bad


def check_rules(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    # few rows: one partition, so that nothing is shuffled
    j = raw.coalesce(1).withColumn("first_place", F.min("place").over(Window.partitionBy("name")))
    scope = F.when((F.col("scope") == "line") & address_hint(F.col("patterns")), "ips").otherwise(F.col("scope"))
    unusable = _unusable(raw)
    bad = F.exists("patterns", lambda p: p.isin(unusable)) if unusable else F.lit(False)
    reason = (
        F.when(F.col("name").isNull() | (F.trim("name") == ""), "empty name")
        .when(F.col("place") > F.col("first_place"), "duplicate name")
        .when(~F.col("lane").isin(*LANES) | F.col("lane").isNull(), "lane")
        .when(~F.col("scope").isin(*SCOPES) | F.col("scope").isNull(), "scope")
        .when((F.col("scope") != "bots") & ((F.coalesce(F.size("patterns"), F.lit(0)) <= 0) | F.exists(F.coalesce("patterns", F.array()), lambda p: F.coalesce(p, F.lit("")) == "")), "empty pattern")
        .when(F.col("scope").isin("regex", "expr") & bad, F.col("scope"))
    )
    j = j.withColumn("reason", reason)
    lane_order = F.when(F.col("lane") == "compete", 0).when(F.col("lane") == "bots", 1).otherwise(2)
    rules = j.where("reason is null").select("name", (lane_order * 100_000 + F.col("place")).cast("int").alias("rank"), "lane", scope.alias("scope"), "patterns", F.lit(0).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return rules, j.where("reason is not null").select("place", "name", "reason")


def pattern_hit(scope: Column, p: Column) -> Column:
    """Whether one pattern of a rule, out of a table, meets the request in the row; for the scopes that need no compiling."""
    dots = F.length(p) - F.length(F.replace(p, F.lit("."), F.lit("")))
    address = F.when((dots == 3) & ~p.endswith("."), F.col("ip") == p).when((dots == 2) & p.endswith("."), F.col("ip_prefix") == p).otherwise(F.startswith(F.col("ip"), p))
    return (
        F.when(scope == "line", F.contains(F.col("line"), p))
        .when(scope == "refs", F.contains(F.col("referer"), p))
        .when(scope == "code", F.contains(F.col("status"), p))
        .when(scope == "words", F.contains(F.col("user_agent"), p) | F.contains(F.col("request"), p))
        .when(scope == "ips", address)
        .when(scope == "starts", F.startswith(F.col("line"), p))
        .otherwise(F.lit(False))
    )


def literal_hit(scope: str, p: str) -> Column:
    """The same for one known pattern, of any scope but bots."""
    if scope == "ips":
        if p.count(".") == 3 and not p.endswith("."):
            return F.col("ip") == p
        return F.col("ip_prefix") == p if p.count(".") == 2 and p.endswith(".") else F.col("ip").startswith(p)
    if scope == "words":
        return F.col("user_agent").contains(p) | F.col("request").contains(p)
    if scope == "expr":
        return F.coalesce(F.expr(p), F.lit(False))
    if scope == "regex":
        return F.col("line").rlike(p)
    if scope == "starts":
        return F.col("line").startswith(p)
    return F.col({"line": "line", "refs": "referer", "code": "status"}[scope]).contains(p)


def _literal_rule(r) -> Column:
    """The rule's hit, or null. Most rules of a table hold at every line and ask no question about it."""
    met = T.bot_like(F.col("user_agent")) if r["scope"] == "bots" else reduce(or_, (literal_hit(r["scope"], p) for p in r["patterns"]))
    if r["valid_from"]:
        met &= F.col("line_id") >= r["valid_from"]
    if r["valid_to"] is not None:
        met &= F.col("line_id") < r["valid_to"]
    return F.when(met, F.struct(*(F.lit(r[c]).alias(c) for c in ("rank", "name", "lane", "scope"))))


def match_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds hits: array of (rank, name, lane, scope) of all rules that directly meet the request and are valid at its line, by rank."""
    rows = sorted(rules.limit(MOST_RULES + 1).collect(), key=lambda r: (r["rank"], r["name"]))
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    kind = "array<struct<rank:int,name:string,lane:string,scope:string>>"
    literal = [r for r in rows if len(rows) <= INLINE_RULES or r["scope"] in ("regex", "expr", "bots")]
    hits = F.array_compact(F.array(*map(_literal_rule, literal))).cast(kind) if literal else F.array().cast(kind)
    if len(literal) == len(rows):
        return requests.withColumn("hits", hits)
    table = rules.where(~F.col("scope").isin("regex", "expr", "bots")).agg(F.array_sort(F.collect_list(F.struct("rank", "name", "lane", "scope", "patterns", "valid_from", "valid_to"))).alias("rules"))
    valid = lambda r: (F.col("line_id") >= r["valid_from"]) & (r["valid_to"].isNull() | (F.col("line_id") < r["valid_to"]))
    met = F.filter("rules", lambda r: valid(r) & F.exists(r["patterns"], lambda p: pattern_hit(r["scope"], p)))
    plain = F.transform(met, lambda r: F.struct(r["rank"].alias("rank"), r["name"].alias("name"), r["lane"].alias("lane"), r["scope"].alias("scope"))).cast(kind)
    return requests.crossJoin(F.broadcast(table)).withColumn("hits", F.array_sort(F.concat(hits, plain))).drop("rules")


def without_observed_regexes(rules: DataFrame) -> DataFrame:
    """The rules that can claim, remember or mark: regex rules of the observe lane only show up among the hits, at the cost of a search of every line."""
    return rules.where(~((F.col("lane") == "observe") & (F.col("scope") == "regex")))


def claim_lines(matched: DataFrame) -> DataFrame:
    """Adds claim, claim_rank, claim_scope: the first compete rule met, else the bots lane; observe rules never claim."""
    first = F.get(F.filter("hits", lambda h: h["lane"] != "observe"), F.lit(0))
    return matched.withColumn("first", first).withColumn("claim", F.col("first.name")).withColumn("claim_rank", F.col("first.rank")).withColumn("claim_scope", F.col("first.scope")).drop("first")


def remembering(claimed: DataFrame) -> DataFrame:
    """(ip, line_id, name, rank, lane): the rules that remember a line's address: the claiming one, and every observe rule met, but no regex rule and no bots lane. One walk over the lines, so that it also serves a stream."""
    fields = lambda r, n, k, lane: F.struct(r[n].alias("name"), r[k].alias("rank"), lane.alias("lane"))
    here = {"claim": F.col("claim"), "claim_rank": F.col("claim_rank")}
    own = F.when(F.col("claim").isNotNull() & ~F.col("claim_scope").isin("regex", "bots"), fields(here, "claim", "claim_rank", F.lit("compete")))
    seen = F.transform(F.filter("hits", lambda h: (h["lane"] == "observe") & (h["scope"] != "regex")), lambda h: fields(h, "name", "rank", h["lane"]))
    return claimed.select("ip", "line_id", F.explode(F.array_compact(F.concat(F.array(own), seen))).alias("m")).select("ip", "line_id", "m.name", "m.rank", "m.lane")


def rule_memory(claimed: DataFrame) -> DataFrame:
    """(ip, name, rank, lane, start): from which line on a rule remembers an address. Regex and bots lanes remember none."""
    return remembering(claimed).groupBy("ip", "name", "rank", "lane").agg(F.min("line_id").alias("start"))


def with_memory(claimed: DataFrame) -> DataFrame:
    """Adds known: array of (rank, name, lane) of rules that remember the request's address from an earlier line, by rank."""
    per_ip = rule_memory(claimed).groupBy("ip").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "lane", "start"))).alias("memory"))
    known = F.filter(F.coalesce("memory", F.array().cast("array<struct<rank:int,name:string,lane:string,start:bigint>>")), lambda m: m["start"] < F.col("line_id"))
    return claimed.join(per_ip, "ip", "left").withColumn("known", known).drop("memory")


def related_rules() -> Column:
    """Of known, the compete rules for which a line counts by memory: no earlier-ranked rule, and not the rule itself, claimed it."""
    return F.filter("known", lambda m: (m["lane"] == "compete") & (F.col("claim_rank").isNull() | (m["rank"] < F.col("claim_rank"))))


def remembered_hits(known: DataFrame) -> DataFrame:
    """(line_id, interval_no, ip, bytes, name, rank): lines that count for a rule by memory."""
    return known.select("line_id", "interval_no", "ip", "bytes", F.explode(related_rules()).alias("m")).select("line_id", "interval_no", "ip", "bytes", F.col("m.name").alias("name"), F.col("m.rank").alias("rank"))


def mark_lines(known: DataFrame) -> DataFrame:
    """Adds mark: the first compete rule that knows the address, else the claiming text rule or bots lane, else the first observe text rule met."""
    tag = F.get(F.filter("known", lambda m: m["lane"] == "compete"), F.lit(0))["name"]
    own = F.when(F.col("claim_scope") != "regex", F.col("claim"))
    seen = F.get(F.filter("hits", lambda h: (h["lane"] == "observe") & (h["scope"] != "regex")), F.lit(0))["name"]
    return known.withColumn("mark", F.coalesce(tag, own, seen))


def regex_keys(requests: DataFrame, name: str, pattern: str, group: int = 1) -> DataFrame:
    """(line_id, interval_no, name, key): every match of a regex lane; the key is the group's text."""
    return requests.select("line_id", "interval_no", F.lit(name).alias("name"), F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(group))).alias("key"))


def regex_lane(lines: DataFrame, name: str, pattern: str, group: int = 1) -> DataFrame:
    """(line_id, interval_no, ip, bytes, name, kind, key): what a regex rule counts on the lines that reach it, and under which key.

    The rule begins by counting addresses: while the key of a line's first match is the line's address, the line is of kind `address`.
    The first line with another key turns the rule for good, and from there on every match counts under its key (kind `key`, one row
    for each match, the line counts once). A line that does not match counts as `related`, under its address, if an earlier line has
    counted that address as a key. group: the group whose text is the key, 0 for a pattern without groups.
    """
    keys = lines.select("line_id", "interval_no", "ip", "bytes", F.lit(name).alias("name"), F.regexp_extract_all("line", F.lit(pattern), F.lit(group)).alias("keys"))
    hit = F.size("keys") > 0
    turn = keys.agg(F.min(F.when(hit & (F.get("keys", F.lit(0)) != F.col("ip")), F.col("line_id"))).alias("turn"))  # one row
    rows = keys.crossJoin(F.broadcast(turn))
    turned = F.coalesce(F.col("line_id") >= F.col("turn"), F.lit(False))
    own = ["line_id", "interval_no", "ip", "bytes", "name"]
    direct = rows.where(hit).select(*own, F.when(turned, "key").otherwise("address").alias("kind"), F.explode(F.when(turned, F.col("keys")).otherwise(F.array("ip"))).alias("key"))
    start = direct.groupBy(F.col("key").alias("ip")).agg(F.min("line_id").alias("start"))
    related = rows.where(~hit).join(start, "ip").where(F.col("line_id") > F.col("start")).select(*own, F.lit("related").alias("kind"), F.col("ip").alias("key"))
    return direct.unionByName(related)


def bot_keys(requests: DataFrame) -> DataFrame:
    """(line_id, interval_no, name, key): lines of the bots lane that give a bot's name."""
    return requests.where(T.bot_like(F.col("user_agent"))).select("line_id", "interval_no", F.lit(BOTS).alias("name"), T.bot_name(F.col("ua_tokens")).alias("key")).where("key is not null")


def error_keys(requests: DataFrame) -> DataFrame:
    """(line_id, interval_no, name, key): error lines under their status."""
    return requests.where(T.is_error(F.col("status"))).select("line_id", "interval_no", F.lit("errs").alias("name"), F.col("status").alias("key"))


def rule_validity(changes: DataFrame) -> DataFrame:
    """(name, valid_from, valid_to) out of a change log (line_id, action add or remove, name)."""
    order = Window.partitionBy("name").orderBy("line_id")
    return changes.withColumn("valid_to", F.lead("line_id").over(order)).where("action = 'add'").select("name", F.col("line_id").alias("valid_from"), "valid_to")


def lines_under_rules(lines: DataFrame, changes: DataFrame, width: int = 100_000) -> DataFrame:
    """(name, line_id) of the lines (name, line_id) whose rule's last change (line_id, action, name) up to them is an add.

    As of the line, in ranges of width line numbers: each range is ordered on its own and takes over the state before it, so work
    grows with the rows, however few names there are.
    """
    part = F.floor(F.col("line_id") / width).alias("part")
    rows = lines.select("name", "line_id", part, F.lit(1).alias("kind"), F.lit(None).cast("boolean").alias("on"))
    rows = rows.unionByName(changes.select("name", "line_id", part, F.lit(0).alias("kind"), (F.col("action") == "add").alias("on")))
    ends = rows.groupBy("name", "part").agg(F.max_by("on", F.when(F.col("kind") == 0, F.col("line_id"))).alias("end"))
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("name", "part", F.last("end", ignorenulls=True).over(earlier).alias("start"))
    within = Window.partitionBy("name", "part").orderBy("line_id", "kind")
    now = rows.withColumn("now", F.last("on", ignorenulls=True).over(within)).where("kind = 1").join(ends, ["name", "part"])
    return now.where(F.coalesce("now", "start", F.lit(False))).select("name", "line_id")
