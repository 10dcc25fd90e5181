"""The interval model over streams: event-time windows, keyed state, and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..sources.shared import shared_folder, written


def stream_interval_totals(requests: DataFrame, interval: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Tumbling totals; rows older than the watermark are dropped."""
    w = requests.withWatermark("ts", late).groupBy(F.window("ts", interval))
    out = w.agg(F.count("*").alias("n_lines"), F.sum("bytes").alias("bytes"), F.count_if(T.is_error(F.col("status"))).alias("errors"))
    return out.select(F.col("window.start").alias("interval_start"), "n_lines", "bytes", "errors")


def stream_key_counts(hits: DataFrame, interval: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Tumbling counts for each stream and key. hits: (ts, stream, key, bytes)."""
    out = hits.withWatermark("ts", late).groupBy(F.window("ts", interval), "stream", "key").agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes"))
    return out.select(F.col("window.start").alias("interval_start"), "stream", "key", "hits", "bytes")


def stream_key_hits(requests: DataFrame) -> DataFrame:
    """One row for each token of the three streams. One generator over one scan: a stream is read once."""
    pair = lambda n, c: F.transform(c, lambda t: F.struct(F.lit(n).alias("stream"), t.alias("key")))
    all_ = F.concat(pair("words", T.word_tokens(F.col("ua_tokens"), F.col("request"))), pair("refs", T.referer_tokens(F.col("referer"))), pair("ips", T.ip_tokens(F.col("ip"))))
    return requests.select("ts", "bytes", F.explode(all_).alias("k")).select("ts", "bytes", "k.stream", "k.key")


def stream_sessions(requests: DataFrame, quiet: str = "2 minutes", late: str = "1 minute") -> DataFrame:
    """Activity islands of each address: a session ends after a quiet time."""
    out = requests.withWatermark("ts", late).groupBy(F.session_window("ts", quiet), "ip").agg(F.count("*").alias("hits"))
    return out.select("ip", F.col("session_window.start").alias("first_seen"), F.col("session_window.end").alias("ends"), "hits")


def sliding_flux(requests: DataFrame, span: str = "4 minutes", step: str = "1 minute", late: str = "1 minute") -> DataFrame:
    out = requests.withWatermark("ts", late).groupBy(F.window("ts", span, step)).agg(F.count("*").alias("flux"))
    return out.select(F.col("window.start").alias("span_start"), F.col("window.end").alias("span_end"), "flux")


def stream_rule_memory(claimed: DataFrame) -> DataFrame:
    """(name, lane, ip, start): from which line on each rule, observe rules included, remembers an address: state keyed by rule and address.

    What is remembered stays, so the state grows with the addresses that rules meet; run it with run_to_table(conf=ROCKS), which
    keeps it on the executors' disks.
    """
    from ..operators.rules import remembering

    return remembering(claimed).groupBy("name", "lane", "ip").agg(F.min("line_id").alias("start"))


def stream_ip_memory(claimed: DataFrame) -> DataFrame:
    """(name, ip, start): the memory of compete rules alone."""
    return stream_rule_memory(claimed.withColumn("hits", F.filter("hits", lambda h: h["lane"] != "observe"))).drop("lane")


def stream_alerts(lanes: DataFrame, rules: DataFrame, flux: int = 3) -> DataFrame:
    """(lane, direction, threshold, interval_no, value, event): hysteresis kept as state for each bound.

    lanes: a stream of (lane, interval_no, value), each interval in one batch at most, in order of intervals across batches.
    """
    joined = lanes.join(F.broadcast(rules), "lane")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lane, direction, threshold = key
        last, streak, active = state.get if state.exists else (False, 0, False)
        rows = pd.concat(list(parts)).sort_values("interval_no")
        out = []
        for k, v in zip(rows["interval_no"], rows["value"], strict=True):
            hit = v >= threshold if direction == "above" else v < threshold
            streak = streak + 1 if streak and hit == last else 1
            last = bool(hit)
            if streak >= flux and last != active:
                active = last
                out.append((lane, direction, threshold, k, v, "triggered" if active else "recovered"))
        state.update((last, streak, active))
        yield pd.DataFrame(out, columns=["lane", "direction", "threshold", "interval_no", "value", "event"])

    return joined.groupBy("lane", "direction", "threshold").applyInPandasWithState(step, "lane string, direction string, threshold long, interval_no long, value long, event string", "last boolean, streak long, active boolean", "append", GroupStateTimeout.NoTimeout)


#: The state store that timers and typed state need.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class KeyRetention(StatefulProcessor):
    """One key of one stream: when it was last seen, where its island began, its zero-filled history of completed intervals.

    A timer in event time ends the state when the time to live has passed; a hit after that begins a new island. A key has one
    timer: when it comes, it is set anew if the key has been seen since. Rows come as they are, without a frame for each key.
    """

    def __init__(self, quiet: dict[str, int], seconds: int, depth: int, flux: int):
        self.quiet, self.seconds, self.depth, self.flux = quiet, seconds, depth, flux

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, start long, ends long, history array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stream, name = key
        old = self.seen.get()
        last, start, history = (old[0], old[1], list(old[3])) if old is not None else (None, None, [])
        quiet, ends = self.quiet.get(stream, 1), None
        for now, hits, at in sorted((r["interval_no"], r["hits"], r["at"]) for r in rows):
            if last is None or now - last > quiet:
                start, history = now, []
            else:
                history = (history + [0] * (now - last - 1))[-self.depth :]
            yield Row(stream=stream, key=name, interval_no=now, island_start=start, hits=hits, depth=len(history), history_total=sum(history), history_peak=max(history, default=0), prime_flux=hits + sum(history[-self.flux :]))
            last, history = now, (history + [hits])[-self.depth :]
            ends = at + (quiet + 1) * self.seconds * 1000
        if old is None:
            self.handle.registerTimer(ends)
        self.seen.update((last, start, ends, history))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ends = self.seen.get()[2]
        if ends > expiredTimerInfo.getExpiryTimeInMs() and ends > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(ends)
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_key_retention(keys: DataFrame, quiet: dict[str, int] | None = None, interval_seconds: int = 60, late: str = "0 seconds", depth: int = 80, flux: int = 3) -> DataFrame:
    """(stream, key, interval_no, island_start, hits, depth, history_total, history_peak, prime_flux): retention, history and flux as state.

    keys: a stream of (stream, key, interval_no, ts, hits), closed intervals in order across batches; ts: when the interval ended, a timestamp after 1970.
    quiet: the longest quiet time of each stream in intervals (1 where it has none). A key's state goes when the watermark passes its
    time to live, so the state holds live keys. Run it with run_to_table(conf=ROCKS).
    """
    out = "stream string, key string, interval_no long, island_start long, hits long, depth long, history_total long, history_peak long, prime_flux long"
    own = keys.select("stream", "key", "interval_no", "hits", F.unix_millis("ts").alias("at"), "ts").withWatermark("ts", late).groupBy("stream", "key")
    return own.transformWithState(KeyRetention(quiet or {}, interval_seconds, depth, flux), out, "append", "eventTime")


def write_intervals(stream: DataFrame, path: str, checkpoint: str, then=None):
    """Writes each batch's closed intervals as JSON, a batch that is run again over its own rows, then calls `then` (alerts, change scores, rules read anew) with that batch."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")
        if then is not None:
            then(batch, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str, folder: str | None = None, conf: dict | None = None) -> DataFrame:
    """Runs a stream over everything that is there and gives its result, as files in the shared folder; nothing passes the driver.

    mode: complete (each batch replaces the result) or append. A batch that is run again writes the same files again. folder: that of
    an earlier run, which this one goes on from. conf: settings for this run alone.
    """
    folder = folder or shared_folder(spark, name)
    out = f"{folder}/rows"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")  # so that an empty stream has a result

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def _parts(df: DataFrame, order: str, parts: int) -> Iterator[DataFrame]:
    """A table in so many parts of about equal size, by ascending order. It is computed once, for its quantiles and all parts."""
    df = written(df, "parts")
    cuts = df.stat.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        low = F.lit(True) if lo is None else F.col(order) >= lo
        yield df.where(low if hi is None else low & (F.col(order) < hi))


def run_in_parts(spark: SparkSession, df: DataFrame, order: str, build, name: str, parts: int = 3, conf: dict | None = None, folder: str | None = None) -> DataFrame:
    """A table as a stream that comes in parts, by ascending order: the query stops after each part and goes on from its checkpoint.

    build: the stream's result from the stream of rows. Parts are as many files as Spark makes of them.
    """
    folder = folder or shared_folder(spark, name)
    out = None
    for part in _parts(df, order, parts):
        part.write.mode("append").parquet(f"{folder}/source")
        out = run_to_table(spark, build(spark.readStream.schema(df.schema).parquet(f"{folder}/source")), name, "append", folder, conf)
    return out


def replay(spark: SparkSession, df: DataFrame, order: str, parts: int = 3) -> DataFrame:
    """An interval-sized table as a stream in so many batches, by ascending order: each batch is one file. For larger ones: run_in_parts."""
    path = shared_folder(spark, "replay")
    for part in _parts(df, order, parts):
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def write_log(lanes: DataFrame, rules: DataFrame, folder: str, flux: int = 3) -> DataFrame:
    """(interval_no, place, kind, lane, direction, threshold, value, event): each closed interval, then its alerts, written exactly once.

    lanes: a stream of (interval_no, n_lines, values: map of lane to hits), in order of intervals across batches, every interval
    present. Place 0 of an interval is its own record (kind interval, value: its lines); its alerts follow from 1, by lane, direction
    and threshold. Every batch writes, each into a folder of its number, its log, the state of each bound and the last flux - 1
    intervals. It starts from those of the batch before, so its work does not grow with the past, and a batch that is run again
    replaces its own rows. Call it again with the same folder to go on after a stop.
    """
    from ..operators.change import alert_states, alert_transitions

    spark = lanes.sparkSession
    bounds = ["lane", "direction", "threshold"]
    state, row = "lane string, direction string, threshold long, active boolean", "interval_no long, n_lines long, values map<string, long>"
    line = "interval_no long, place long, kind string, lane string, direction string, threshold long, value long, event string"
    at = lambda kind, number: f"{folder}/{kind}/batch={number}"

    def each(batch: DataFrame, number: int) -> None:
        batch.select("interval_no", "n_lines", "values").write.mode("overwrite").parquet(at("intervals", number))
        new = spark.read.schema(row).parquet(at("intervals", number))
        start = spark.read.schema(state).parquet(at("states", number - 1))
        rows = spark.read.schema(row).parquet(at("recent", number - 1)).unionByName(new)
        first, last = new.agg(F.min("interval_no")).first()[0], rows.agg(F.max("interval_no")).first()[0]
        states = alert_states(rules, rows.select("interval_no", F.explode("values").alias("lane", "value")), flux, start)
        turned = alert_transitions(states, start).where(F.col("interval_no") >= F.lit(first))
        turned = turned.withColumn("place", F.row_number().over(Window.partitionBy("interval_no").orderBy(*bounds)).cast("long"))
        head = new.select("interval_no", F.lit(0).cast("long").alias("place"), F.lit("interval").alias("kind"), F.col("n_lines").alias("value"))
        log = head.unionByName(turned.withColumn("kind", F.lit("alert")), allowMissingColumns=True)
        log.repartitionByRange("interval_no").sortWithinPartitions("interval_no", "place").write.mode("overwrite").json(at("log", number))
        known = start.withColumn("interval_no", F.lit(-1).cast("long")).unionByName(states.select(*bounds, "active", "interval_no"))
        known.groupBy(*bounds).agg(F.max_by("active", "interval_no").alias("active")).write.mode("overwrite").parquet(at("states", number))
        rows.where(F.col("interval_no") > F.lit(last) - (flux - 1)).write.mode("overwrite").parquet(at("recent", number))

    for kind, schema in (("states", state), ("recent", row)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(at(kind, -1))
    spark.createDataFrame([], line).write.mode("overwrite").json(at("log", -1))
    lanes.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(line).json(f"{folder}/log/batch=*")


def stream_change(spark: SparkSession, shapes: DataFrame, folder: str) -> DataFrame:
    """Change scores of closed intervals, in order across batches.

    shapes: a stream of (interval_no, n_lines, bytes, errors), of the other fields of change_shape as far as there, and of `inputs`,
    an array of (stream, key, hits): what the interval's distributions consist of (change_inputs). Fields that are not there take
    their components away. Each batch is written to the table of closed intervals; its rows are scored against it, the row before
    the batch included.
    """
    from ..operators.change import change_scores, distribution_distance

    fields = ["n_lines", "bytes", "errors", "mean_bytes", "marked_pct", "b16_pct"]

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/closed/batch={number}")
        first = spark.read.schema(batch.schema).parquet(f"{folder}/closed/batch={number}").agg(F.min("interval_no")).first()[0]
        if first is None:
            return
        closed = spark.read.schema(batch.schema).parquet(f"{folder}/closed").select(*batch.columns)
        start = closed.where(F.col("interval_no") < first).agg(F.max("interval_no")).first()[0]
        now = closed.where(F.col("interval_no") >= (start if start is not None else first))
        shape = now.select("interval_no", *(F.col(c) if c in batch.columns else F.lit(None).cast("double").alias(c) for c in fields))
        distances = None
        if "inputs" in batch.columns:
            keys = now.select("interval_no", F.explode("inputs").alias("k")).select("k.stream", "k.key", "interval_no", "k.hits")
            distances = distribution_distance(keys).withColumnRenamed("stream", "part")
        change_scores(shape, distances).where(F.col("interval_no") >= first).select("interval_no", "score", "primary").write.mode("overwrite").parquet(f"{folder}/scores/batch={number}")

    shapes.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/scores").drop("batch")


def stream_rules(requests: DataFrame, rules_path: str, folder: str) -> DataFrame:
    """(line_id, claim): claims of a stream under a rule table that is read anew for each batch, so that rules may change while it runs.

    A rule holds from its valid_from to before its valid_to, in line numbers, so a change takes effect at its line and not with the
    batch in which it is noticed. Call it again with the same folder to go on after a stop.
    """
    from ..operators.rules import claim_lines, match_rules

    spark = requests.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        rules = spark.read.parquet(rules_path)
        claim_lines(match_rules(batch, rules)).select("line_id", "claim").write.mode("overwrite").parquet(f"{folder}/claims/batch={number}")

    requests.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/claims").drop("batch")
