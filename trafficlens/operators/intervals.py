"""Aggregates for each interval of parsed, claimed or marked requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def interval_totals(r: DataFrame) -> DataFrame:
    return r.groupBy("interval_no").agg(F.count("*").alias("n_lines"), F.sum("bytes").alias("bytes"), F.count_if(T.is_error(F.col("status"))).alias("errors"))


def status_breakdown(r: DataFrame) -> DataFrame:
    return r.where(T.is_error(F.col("status"))).groupBy("interval_no", "status").agg(F.count("*").alias("n_lines"))


def _with_share(counts: DataFrame) -> DataFrame:
    total = F.sum("n_lines").over(Window.partitionBy("interval_no"))
    return counts.withColumn("share", F.round(100 * F.col("n_lines") / total, 6))


def size_band_breakdown(r: DataFrame) -> DataFrame:
    return _with_share(r.groupBy("interval_no", V.size_band(F.col("bytes")).alias("band")).agg(F.count("*").alias("n_lines")))


def token_band_breakdown(r: DataFrame) -> DataFrame:
    return _with_share(r.groupBy("interval_no", V.token_band(F.col("ua_token_count")).alias("band")).agg(F.count("*").alias("n_lines")))


def marked_share(marked: DataFrame) -> DataFrame:
    n = marked.groupBy("interval_no").agg(F.count("mark").alias("marked"), F.count_if(F.col("mark").isNull()).alias("unmarked"))
    return n.withColumn("share", F.round(100 * F.col("marked") / (F.col("marked") + F.col("unmarked")), 6))


def ua_token_histogram(r: DataFrame) -> DataFrame:
    return r.groupBy("ua_token_count").agg(F.count("*").alias("n_lines"), F.sum("ua_token_count").alias("tokens"))


def lane_hits(known: DataFrame) -> DataFrame:
    """(line_id, interval_no, ip, bytes, name, direct): claims and remembered hits, out of one walk over the lines."""
    from .rules import related_rules

    claim = F.when(F.col("claim").isNotNull(), F.array(F.struct(F.col("claim").alias("name"), F.lit(True).alias("direct")))).otherwise(F.array().cast("array<struct<name:string,direct:boolean>>"))
    related = F.transform(related_rules(), lambda m: F.struct(m["name"].alias("name"), F.lit(False).alias("direct")))
    return known.select("line_id", "interval_no", "ip", "bytes", F.explode(F.concat(claim, related)).alias("h")).select("line_id", "interval_no", "ip", "bytes", "h.name", "h.direct")


def lane_intervals(hits: DataFrame) -> DataFrame:
    """Hits of each lane and interval, and the lane's bytes to date."""
    per = hits.groupBy("name", "interval_no").agg(F.count("*").alias("hits"), F.count_if("direct").alias("claims"), F.sum("bytes").alias("bytes"))
    return per.withColumn("bytes_to_date", F.sum("bytes").over(Window.partitionBy("name").orderBy("interval_no").rowsBetween(Window.unboundedPreceding, 0)))


def lane_ip_counts(hits: DataFrame, k: int = 25) -> DataFrame:
    """The k most frequent addresses of each lane and interval (count descending, address ascending)."""
    per = hits.groupBy("name", "interval_no", "ip").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("name", "interval_no").orderBy(F.desc("hits"), "ip")
    return per.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def lane_prefix_groups(hits: DataFrame, min_members: int = 10) -> DataFrame:
    """(name, ip_prefix, interval_no, hits, members): hits and distinct addresses to date, in each interval with hits of a lane's prefix.

    An address counts from the interval in which the lane first met it, so members are a running sum of first appearances. Prefixes
    are listed from the interval on in which they have enough members.
    """
    per = hits.groupBy("name", "ip", "interval_no").agg(F.count("*").alias("n"))
    first = F.min("interval_no").over(Window.partitionBy("name", "ip"))
    new = per.select("name", T.ip_prefix(F.col("ip")).alias("ip_prefix"), "interval_no", "n", (F.col("interval_no") == first).cast("long").alias("new"))
    g = new.groupBy("name", "ip_prefix", "interval_no").agg(F.sum("n").alias("n"), F.sum("new").alias("new"))
    to_date = Window.partitionBy("name", "ip_prefix").orderBy("interval_no").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("name", "ip_prefix", "interval_no", F.sum("n").over(to_date).alias("hits"), F.sum("new").over(to_date).alias("members")).where(F.col("members") >= min_members)


def lane_keys(keys: DataFrame, k: int = 25) -> DataFrame:
    per = keys.groupBy("name", "interval_no", "key").agg(F.count("*").alias("hits"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("name", "interval_no").orderBy(F.desc("hits"), "key"))).where(F.col("place") <= k)


def lane_examples(claimed: DataFrame) -> DataFrame:
    """Ids of each lane's first line ever, first and last in each interval (direct hits only)."""
    own = claimed.where("claim is not null")
    per = own.groupBy(F.col("claim").alias("name"), "interval_no").agg(F.min("line_id").alias("first_line_id"), F.max("line_id").alias("last_line_id"))
    return per.withColumn("first_ever_id", F.min("first_line_id").over(Window.partitionBy("name")))


def running_totals(totals: DataFrame) -> DataFrame:
    """Lines and bytes to date. One window over interval-sized rows."""
    to_date = Window.orderBy("interval_no").rowsBetween(Window.unboundedPreceding, 0)
    return totals.select("interval_no", "n_lines", F.sum("n_lines").over(to_date).alias("total_lines"), F.sum("bytes").over(to_date).alias("total_bytes"))


def traffic_extremes(totals: DataFrame, depth: int = 80) -> DataFrame:
    """Peak and whole-number mean of lines, bytes and errors over the last intervals."""
    w = Window.orderBy("interval_no").rangeBetween(-(depth - 1), 0)
    n = F.count("*").over(w)
    cols = [c for name in ("n_lines", "bytes", "errors") for c in (F.max(name).over(w).alias(f"peak_{name}"), F.floor(F.sum(name).over(w) / n).cast("long").alias(f"mean_{name}"))]
    return totals.select("interval_no", *cols)


def lane_summary(lanes: DataFrame) -> DataFrame:
    return lanes.groupBy("name").agg(F.sum("hits").alias("total"), F.max("hits").alias("peak"), F.min("hits").alias("least"), F.round(F.avg("hits"), 6).alias("mean"), F.count("*").alias("n_intervals"))


def shared_scale(lanes: DataFrame, names: list[str]) -> DataFrame:
    """Least, mean and largest of the named lanes' peaks."""
    return lanes.where(F.col("name").isin(*names)).groupBy("name").agg(F.max("hits").alias("peak"), F.min("hits").alias("least")).agg(F.min("least").alias("least"), F.round(F.avg("peak"), 6).alias("mean_peak"), F.max("peak").alias("peak"))


def lane_trend(lanes: DataFrame, least: int = 60) -> DataFrame:
    """Each lane's value, the one before, and an arrow at 1.1 and 0.9 of a previous value that is large enough."""
    before = F.lag("hits").over(Window.partitionBy("name").orderBy("interval_no"))
    out = lanes.select("name", "interval_no", "hits", before.alias("previous"))
    rate = F.col("hits") / F.col("previous")
    return out.withColumn("trend", F.when(F.col("previous") >= least, F.when(rate >= 1.1, "up").when(rate <= 0.9, "down").otherwise("flat")).otherwise("flat"))
