"""The given tables as web requests: one request for each event, with its page as referer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .access_log import number_intervals, render_line, with_derived

#: The agents that the view deals out.
AGENTS = [
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1",
    "curl/8.4.0",
    "SiteCrawler/1.0",
]


def dealt(df: DataFrame) -> DataFrame:
    """df; if it is so small that Spark reads it in fewer partitions than there are cores, dealt out to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def requests_view(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """(line_id, ts, ip, ip_prefix, request, status, bytes, referer, user_agent, ua_tokens, ua_token_count). events: a stream of them, or the table."""
    e, p = events if events is not None else dealt(spark.read.parquet(f"{sf_dir}/events.parquet").drop("props")), spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    # events go round all pages; their number is read from the file's footer, and Spark broadcasts the urls only where they are small
    r = e.withColumn("page_id", F.col("event_id") % (p.count() or 1)).join(p, "page_id", "left")
    eid, uid = F.col("event_id"), F.col("user_id")
    agent = F.element_at(F.array(*map(F.lit, AGENTS)), (F.pmod(uid + F.when(eid % 23 == 0, 1).otherwise(0), F.lit(6)) + 1).cast("int"))
    text = lambda c: c.cast("string")
    out = r.select(
        eid.alias("line_id"),
        "ts",
        F.concat(F.lit("10."), text(uid % 4), F.lit("."), text(uid % 7), F.lit("."), text(uid)).alias("ip"),
        F.concat(F.lit("GET /"), "event_type", F.lit("/item"), text(eid % 40), F.lit("?src="), F.when(eid % 5 == 0, "mail").otherwise("web"), F.lit(" HTTP/1.1")).alias("request"),
        F.when(F.col("event_type") == "error", "500").when(eid % 17 == 0, "404").when(F.col("event_type") == "signup", "201").otherwise("200").alias("status"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("bytes"),
        F.when(eid % 3 == 0, "-").otherwise(F.col("url")).alias("referer"),
        agent.alias("user_agent"),
    )
    return with_derived(out)


def hourly_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests_view with its log line and its hour as interval."""
    return number_intervals(render_line(requests_view(spark, sf_dir)), "hour")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, line): the view as a raw log, with every 50th line damaged in one of five ways and every 97th a command."""
    r = render_line(requests_view(spark, sf_dir))
    k, line = F.col("line_id") % 50, F.col("line")
    kind = (F.col("line_id") / 50).cast("long") % 5
    broken = F.when(kind == 0, F.regexp_replace(line, '"', "")).when(kind == 1, F.concat(F.lit("localhost"), F.substring(line, 9, 1 << 20))).when(kind == 2, F.replace(line, F.lit("["), F.lit("("))).when(kind == 3, F.replace(line, F.lit(' "GET'), F.lit("GET"))).otherwise(F.replace(line, F.lit('" 200 '), F.lit('" 200 x')))
    return r.select("line_id", F.when(F.col("line_id") % 97 == 0, F.concat(F.lit("!!! add rule"), F.col("line_id").cast("string"))).when(k == 0, broken).otherwise(line).alias("line"))
