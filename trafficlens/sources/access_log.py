"""Access logs: text lines, parsed requests, rejects, commands inside the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import written

COMMAND = "!!! "


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_offset, line_id, line): line_id numbers the lines from 0, file by file in path order, gapless.

    Spark reads large files in blocks, in an order of its own. Within a block lines keep their order, so a line's number is its place
    in the block plus the lines of all earlier blocks: a small table of block sizes, and no line moves.
    """
    return _numbered(spark.read.text(path).select(*_placed()))


def _placed() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("file_offset"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")]


def _numbered(raw: DataFrame) -> DataFrame:
    blocks = raw.groupBy("file", "file_offset").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.orderBy("file", "file_offset").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    blocks = blocks.select("file", "file_offset", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return raw.join(blocks, ["file", "file_offset"]).select("file", "file_offset", (F.col("before") + F.col("at") - F.col("first")).alias("line_id"), "line")


def follow_access_log(spark: SparkSession, directory: str, folder: str) -> DataFrame:
    """(file, file_offset, line_id, ts, line) of all chunks that have come into a directory so far, as a table in folder.

    Call it again to take in what has come since: the stream goes on from its checkpoint in folder. line_id goes on over chunks, gapless, in
    order of arrival and, of chunks that come together, by path; so chunks that are named in order give the numbers of read_access_log.
    A batch numbers its lines after those of earlier batches and replaces what an interrupted run of it left, so a restart changes nothing.
    """
    kind = "file string, file_offset long, line_id long, ts timestamp_ntz, line string"

    def each(batch: DataFrame, number: int) -> None:
        # ids are drawn once, so that both uses of them in the numbering agree
        raw = written(batch.select("file", "file_offset", F.monotonically_increasing_id().alias("at"), "line"), "chunks")
        earlier = spark.read.schema(kind + ", batch long").option("basePath", f"{folder}/lines").parquet(f"{folder}/lines").where(F.col("batch") < number)
        base = earlier.agg((F.coalesce(F.max("line_id"), F.lit(-1)) + 1).alias("base"))  # one row
        rows = _numbered(raw).crossJoin(F.broadcast(base))
        rows.select("file", "file_offset", (F.col("line_id") + F.col("base")).alias("line_id"), T.parse_time(F.col("line")).alias("ts"), "line").write.mode("overwrite").parquet(f"{folder}/lines/batch={number}")

    spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{folder}/lines/batch=-1")
    stream = spark.readStream.text(directory).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("file_offset"), F.col("value").alias("line"))
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kind).parquet(f"{folder}/lines").select("file", "file_offset", "line_id", "ts", "line")


def command_lines(lines: DataFrame) -> DataFrame:
    """Lines that are commands to the analyser, without their mark."""
    return lines.where(F.col("line").startswith(COMMAND)).withColumn("command", F.substring("line", len(COMMAND) + 1, 1 << 20))


def traffic_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("line").startswith(COMMAND))


#: White space that may follow a line.
_BLANK = " \t\n\x0b\f\r"


def _cut(lines: DataFrame) -> DataFrame:
    """Adds the parts that the quotes of a line separate, and what follows from them; null where a part is not what it should be.

    Quotes one and two hold the request, three and four the referer; the agent ends at the last quote, a further "-" field ignored.
    """
    line = F.col("line")
    out = lines.withColumn("q", F.split(line, '"')).withColumn("ip", F.substring_index(line, " ", 1))
    middle = F.get("q", F.lit(2))
    before = sum((F.length(F.get("q", F.lit(k))) for k in range(5)), F.lit(5))
    out = out.withColumn("middle", middle).withColumn("rest", F.rtrim(F.substr(line, before + 1), F.lit(_BLANK)))
    whole = (F.length("middle") >= 6) & F.col("middle").startswith(" ") & (F.substring("middle", 5, 1) == " ") & F.col("middle").endswith(" ")
    size = F.length("rest")
    agent = F.when(F.col("rest").endswith('" "-"'), F.substr("rest", F.lit(1), size - 5)).when(F.col("rest").endswith('"'), F.substr("rest", F.lit(1), size - 1))
    return out.select(
        *lines.columns,
        T.parse_time(line).alias("ts"),
        "ip",
        T.ip_prefix(F.col("ip")).alias("ip_prefix"),
        F.get("q", F.lit(1)).alias("request"),
        F.when(whole, F.substring("middle", 2, 3)).alias("status"),
        F.when(whole, F.substr("middle", F.lit(6), F.length("middle") - 6).try_cast("bigint")).alias("bytes"),
        F.get("q", F.lit(3)).alias("referer"),
        agent.alias("user_agent"),
        F.size("q").alias("parts"),
    )


def _fault() -> Column:
    """Why a cut line is no request; null where it is one. The first fault found in reading order."""
    return (
        F.when(~F.col("line").contains(" "), "no_space")
        .when(F.col("ip_prefix") == "", "ip")
        .when(F.col("parts") < 7, "quotes")
        .when(F.col("status").isNull() | F.col("user_agent").isNull(), "fields")
        .when(F.col("bytes").isNull(), "bad_bytes")
        .when(F.col("ts").isNull(), "time")
    )


_FIELDS = ("ts", "ip", "ip_prefix", "request", "status", "bytes", "referer", "user_agent")


def parse_requests(lines: DataFrame) -> DataFrame:
    """(line_id, ts, ip, ip_prefix, request, status, bytes, referer, user_agent, ua_tokens, ua_token_count, line) of good lines."""
    cut = _cut(traffic_lines(lines).select("line_id", "line"))
    # exploding none or one keeps the judgement from being evaluated again as a pushed filter
    good = cut.select("line_id", "line", F.explode(F.when(_fault().isNull(), F.array(F.struct(*_FIELDS)))).alias("f"))
    good = good.select("line_id", *(F.col(f"f.{c}").alias(c) for c in _FIELDS), T.agent_tokens(F.col("f.user_agent")).alias("ua_tokens"), "line")
    return good.withColumn("ua_token_count", F.size("ua_tokens"))


def parse_rejects(lines: DataFrame) -> DataFrame:
    """(line_id, line, reason) of the lines that parse_requests leaves out."""
    cut = _cut(traffic_lines(lines).select("line_id", "line"))
    return cut.select("line_id", "line", F.explode(F.array_compact(F.array(_fault()))).alias("reason"))


def with_derived(requests: DataFrame) -> DataFrame:
    tokens = T.agent_tokens(F.col("user_agent"))
    return requests.withColumn("ip_prefix", T.ip_prefix(F.col("ip"))).withColumn("ua_tokens", tokens).withColumn("ua_token_count", F.size("ua_tokens"))


def render_line(r: DataFrame) -> DataFrame:
    """Adds the log line that a request's fields stand for."""
    time = F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss")
    return r.withColumn("line", F.concat("ip", F.lit(" - - ["), time, F.lit(' +0000] "'), "request", F.lit('" '), "status", F.lit(" "), F.col("bytes").cast("string"), F.lit(' "'), "referer", F.lit('" "'), "user_agent", F.lit('"')))


def recent_window(requests: DataFrame, minutes: int) -> DataFrame:
    """The tail that lies within so many minutes of the newest row."""
    newest = requests.agg(F.max("ts").alias("newest"))  # one row
    return requests.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.timestamp_add("MINUTE", F.lit(-minutes), F.col("newest"))).drop("newest")


def trim_partial(requests: DataFrame, interval: str = "minute", drop_first: bool = True, drop_last: bool = True) -> DataFrame:
    """Without the first interval, which may lack its beginning, and the last, which is still open."""
    start = F.date_trunc(interval, F.col("ts"))
    ends = requests.agg(F.min(start).alias("first_start"), F.max(start).alias("last_start"))  # one row
    out = requests.crossJoin(F.broadcast(ends))
    if drop_first:
        out = out.where(start > F.col("first_start"))
    if drop_last:
        out = out.where(start < F.col("last_start"))
    return out.drop("first_start", "last_start")


def number_intervals(requests: DataFrame, interval: str = "minute", compact: bool = False) -> DataFrame:
    """Adds interval_start and interval_no: whole intervals since the first one, or the rank among intervals that have rows."""
    start = F.date_trunc(interval, F.col("ts")).cast("timestamp_ntz")
    out = requests.withColumn("interval_start", start)
    if compact:
        starts = out.select("interval_start").distinct().withColumn("interval_no", (F.row_number().over(Window.orderBy("interval_start")) - 1).cast("long"))
        return out.join(F.broadcast(starts), "interval_start")
    first = out.agg(F.min("interval_start").alias("first_start"))  # one row
    return out.crossJoin(F.broadcast(first)).withColumn("interval_no", F.timestamp_diff(interval.upper(), F.col("first_start"), F.col("interval_start")).cast("long")).drop("first_start")
