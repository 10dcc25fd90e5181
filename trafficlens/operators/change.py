"""Change between consecutive intervals, and alerts with hysteresis."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.shared import shared_folder, written

#: Component names in order, which decides ties.
COMPONENTS = ["lines", "bytes", "avg bytes/line", "errs", "marked", "b16", "peak balance", "word wave"]


def composite(components: Column) -> tuple[Column, Column, Column]:
    """(score, primary, sorted components) of an array of (score, place, key): the strongest counts fully, the next two in part."""
    ranked = F.array_sort(F.filter(components, lambda c: c["score"].isNotNull()), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["place"] - b["place"]))
    at = lambda k: F.coalesce(F.get(ranked, F.lit(k))["score"], F.lit(0.0))
    whole = F.least(F.lit(100.0), at(0) + (100 - at(0)) * (0.15 * at(1) / 100 + 0.05 * at(2) / 100))
    return whole * whole / 100, F.get(ranked, F.lit(0))["key"], ranked


def change_shape(totals: DataFrame, marks: DataFrame, bands: DataFrame) -> DataFrame:
    """One row for each interval: lines, bytes, errors, mean bytes, marked and b16 in percent."""
    b16 = bands.where("band = 'b16'").select("interval_no", F.col("n_lines").alias("b16_lines"))
    j = totals.join(marks.select("interval_no", "marked"), "interval_no", "left").join(b16, "interval_no", "left")
    pct = lambda c: 100 * F.coalesce(F.col(c), F.lit(0)) / F.col("n_lines")
    return j.select("interval_no", "n_lines", "bytes", "errors", (F.col("bytes") / F.col("n_lines")).alias("mean_bytes"), pct("marked").alias("marked_pct"), pct("b16_lines").alias("b16_pct"))


def component_scores(before: str, now: str, words: Column, refs: Column, ips: Column, wave: Column) -> Column:
    """The eight components as an array of (score, place, key). words, refs, ips, wave: distribution distances; null drops a part."""
    a, b = (lambda c: F.col(f"{before}.{c}")), (lambda c: F.col(f"{now}.{c}"))
    both = lambda c, x: F.when(a(c).isNotNull() & b(c).isNotNull(), x)
    scores = [
        V.relative_change(a("n_lines"), b("n_lines"), 100, 0.25),
        V.relative_change(a("bytes"), b("bytes"), 1024 * 1024, 0.25),
        both("mean_bytes", V.relative_change(a("mean_bytes"), b("mean_bytes"), 128, 0.25)),
        V.relative_change(a("errors"), b("errors"), 10, 0.5),
        both("marked_pct", V.point_change(a("marked_pct"), b("marked_pct"), 4)),
        both("b16_pct", V.point_change(a("b16_pct"), b("b16_pct"), 12)),
        F.when(words.isNotNull(), F.greatest(V.soft_score(words, 0.10), 0.80 * V.soft_score(refs, 0.12), 0.40 * V.soft_score(ips, 0.25))),
        F.when(wave.isNotNull(), 0.75 * V.soft_score(wave, 0.30)),
    ]
    return F.array(*(F.struct(s.cast("double").alias("score"), F.lit(i).alias("place"), F.lit(COMPONENTS[i]).alias("key")) for i, s in enumerate(scores)))


def distribution_distance(keys: DataFrame, value: str = "hits") -> DataFrame:
    """(stream, interval_no, distance) between an interval's shares of keys and those of the interval before.

    keys: (stream, key, interval_no, value). Half the sum of absolute share differences; 0 if both are empty, 1 if one is. Each
    row is counted in its own interval and, with the other sign, in the next: one aggregate, no self-join.
    """
    total = Window.partitionBy("stream", "interval_no")
    shares = keys.select("stream", "key", "interval_no", (F.col(value) / F.sum(value).over(total)).alias("share"))
    signed = shares.withColumn("side", F.lit(1)).unionByName(shares.select("stream", "key", (F.col("interval_no") + 1).alias("interval_no"), (-F.col("share")).alias("share"), F.lit(-1).alias("side")))
    per = signed.groupBy("stream", "interval_no", "key").agg(F.sum("share").alias("moved"), F.max("side").alias("now"), F.min("side").alias("then"))
    d = per.groupBy("stream", "interval_no").agg((F.sum(F.abs("moved")) / 2).alias("half"), F.max("now").alias("now"), F.min("then").alias("then"))
    return d.select("stream", "interval_no", F.when((F.col("now") == 1) & (F.col("then") == -1), F.col("half")).otherwise(F.lit(1.0)).alias("distance"))


def change_scores(shape: DataFrame, distances: DataFrame | None = None, resets: DataFrame | None = None) -> DataFrame:
    """(interval_no, score, primary, components): against the interval before; the first is the baseline, with a null score.

    distances: (part in words, refs, ips, wave; interval_no; distance). resets: interval numbers of applied peak purges, after
    which the next two comparisons leave the distributions out.
    """
    fields = ["n_lines", "bytes", "errors", "mean_bytes", "marked_pct", "b16_pct"]
    order = Window.orderBy("interval_no")
    pair = shape.select("interval_no", F.struct(*fields).alias("now"))
    pair = pair.withColumn("before", F.lag("now").over(order))
    if distances is not None:
        wide = distances.groupBy("interval_no").agg(*(F.max(F.when(F.col("part") == p, F.col("distance"))).alias(p) for p in ("words", "refs", "ips", "wave")))
        pair = pair.join(wide, "interval_no", "left").fillna(0.0, ["words", "refs", "ips", "wave"])
    else:
        pair = pair.select("*", *(F.lit(None).cast("double").alias(p) for p in ("words", "refs", "ips", "wave")))
    if resets is not None:
        pair = change_reset(pair, resets)
        for p in ("words", "refs", "ips", "wave"):
            pair = pair.withColumn(p, F.when(~F.col("reset"), F.col(p)))
    score, primary, ranked = composite(component_scores("before", "now", *(F.col(p) for p in ("words", "refs", "ips", "wave"))))
    has = F.col("before").isNotNull()
    return pair.select("interval_no", F.when(has, F.round(score, 6)).alias("score"), F.when(has, primary).alias("primary"), F.when(has, F.transform(ranked, lambda c: F.struct(c["key"].alias("key"), F.round(c["score"], 6).alias("score")))).alias("components"))


def change_reset(intervals: DataFrame, resets: DataFrame) -> DataFrame:
    """Adds reset: whether fewer than two intervals have been compared since the last applied purge."""
    order = Window.orderBy("interval_no")
    marked = intervals.join(F.broadcast(resets.select("interval_no", F.lit(1).alias("purged")).distinct()), "interval_no", "left")
    placed = marked.withColumn("place", F.row_number().over(order)).withColumn("purge_place", F.when(F.col("purged") == 1, F.col("place")))
    since = F.col("place") - F.last("purge_place", ignorenulls=True).over(order)
    return placed.withColumn("reset", F.coalesce(since < 2, F.lit(False))).drop("place", "purge_place", "purged")


def word_wave(ranked: DataFrame, peaks: DataFrame) -> DataFrame:
    """The top words of each interval that are no peaks."""
    return ranked.where("stream = 'words'").join(peaks.select("stream", "key", "interval_no").distinct(), ["stream", "key", "interval_no"], "left_anti")


def above_threshold(scores: DataFrame, threshold: int) -> DataFrame:
    return scores.where(F.round("score") >= threshold)


def check_alert_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of (lane, direction, threshold): thresholds from 0, below from 1, below not above the lane's upper bound."""
    upper = rules.where("direction = 'above'").groupBy("lane").agg(F.min("threshold").alias("upper"))
    j = rules.join(F.broadcast(upper), "lane", "left")
    reason = F.when(~F.col("direction").isin("above", "below"), "direction").when(F.col("threshold") < 0, "negative").when((F.col("direction") == "below") & (F.col("threshold") < 1), "below 1").when((F.col("direction") == "below") & (F.col("threshold") > F.col("upper")), "below exceeds above")
    j = j.withColumn("reason", reason)
    return j.where("reason is null").select("lane", "direction", "threshold"), j.where("reason is not null").select("lane", "direction", "threshold", "reason")


def alert_states(rules: DataFrame, lanes: DataFrame, flux: int = 3, start: DataFrame | None = None) -> DataFrame:
    """(lane, direction, threshold, interval_no, value, streak, active): on after flux hits in a row, off after flux clears in a row.

    lanes: (lane, interval_no, value), every interval present. Runs are islands of equal hits; a run's flux-th row carries the
    signal, and the state is the last signal. start: (lane, direction, threshold, active) before the first interval, for lanes whose
    earlier intervals are not among the rows; where it has no row, the bound is off.
    """
    j = lanes.join(F.broadcast(rules), "lane")
    hit = F.when(F.col("direction") == "above", F.col("value") >= F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    order = Window.partitionBy("lane", "direction", "threshold").orderBy("interval_no")
    j = j.withColumn("hit", hit).withColumn("turn", F.coalesce((F.col("hit") != F.lag("hit").over(order)).cast("int"), F.lit(1)))
    j = j.withColumn("run", F.sum("turn").over(order))
    j = j.withColumn("streak", F.row_number().over(Window.partitionBy("lane", "direction", "threshold", "run").orderBy("interval_no")))
    signal = F.when(F.col("streak") >= flux, F.col("hit"))
    active = F.coalesce(F.last(signal, ignorenulls=True).over(order), "initial")
    return _initial(j, start).withColumn("active", active).select("lane", "direction", "threshold", "interval_no", "value", "streak", "active")


def _initial(rows: DataFrame, start: DataFrame | None) -> DataFrame:
    """Adds initial: whether a row's bound was on before the first interval. start has one row for each bound, as many as rules."""
    if start is None:
        return rows.withColumn("initial", F.lit(False))
    bounds = ["lane", "direction", "threshold"]
    j = rows.join(F.broadcast(start.select(*bounds, F.col("active").alias("initial"))), bounds, "left")
    return j.withColumn("initial", F.coalesce("initial", F.lit(False)))


def alert_transitions(states: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(lane, direction, threshold, interval_no, value, event): where a bound turns on or off. start: as in alert_states."""
    order = Window.partitionBy("lane", "direction", "threshold").orderBy("interval_no")
    before = F.coalesce(F.lag("active").over(order), "initial")
    return _initial(states, start).withColumn("before", before).where("active <> before").select("lane", "direction", "threshold", "interval_no", "value", F.when(F.col("active"), "triggered").otherwise("recovered").alias("event"))


def active_alerts(states: DataFrame) -> DataFrame:
    last = states.groupBy("lane", "direction", "threshold").agg(F.max_by("active", "interval_no").alias("active"), F.max_by("value", "interval_no").alias("value"))
    return last.where("active").drop("active")


def dense_lanes(lanes: DataFrame, totals: DataFrame) -> DataFrame:
    """(lane, interval_no, value) with 0 where a lane has no hits: lanes and intervals are small lists."""
    names = lanes.select(F.col("name").alias("lane")).distinct()
    ends = totals.agg(F.max("interval_no").alias("last"))  # one row
    grid = names.crossJoin(F.broadcast(ends)).select("lane", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("interval_no"))
    return grid.join(lanes.select(F.col("name").alias("lane"), "interval_no", "hits"), ["lane", "interval_no"], "left").select("lane", "interval_no", F.coalesce("hits", F.lit(0)).alias("value"))


def peak_spells(keys: DataFrame, candidates: DataFrame, limit: int = 20, grace: int = 15, span: int = 10_000) -> DataFrame:
    """(stream, key, first, until): each stay in a stream's peak list, from the close of interval first to before that of until.

    keys: (stream, key, interval_no, hits), rows without hits allowed. candidates: (stream, key, interval_no, strength).
    Free places go to the strongest candidates (strength descending, key ascending); members are never displaced and retire after
    grace intervals without hits. When a key would retire depends on its own hits alone, so each candidate carries that interval.
    Of an interval's candidates no more than limit are members and no more than limit can enter: the first 2 limit decide. They are
    replayed in spans of intervals, so that a group has 2 limit span rows at most, and the members at a span's end, limit for each
    stream, go on to the next.
    """
    hit = F.when(F.col("hits") > 0, F.col("interval_no"))
    order = Window.partitionBy("stream", "key").orderBy("interval_no")
    # what comes after is asked of the rows in descending order: frames that grow cost no second walk for each row
    before, back = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("stream", "key").orderBy(F.desc("interval_no"))
    rows = keys.select("stream", "key", "interval_no", hit.alias("hit"), F.last(hit, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("next"))
    ends = F.when(F.col("hit").isNotNull() & (F.col("next").isNull() | (F.col("next") - F.col("hit") > grace)), F.col("hit") + grace)
    rows = rows.withColumn("ends", ends)
    until = F.when(F.col("hit").isNotNull(), F.last("ends", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    holds = rows.withColumn("until", until).select("stream", "key", "interval_no", F.last("until", ignorenulls=True).over(before).alias("until"))
    best = Window.partitionBy("stream", "interval_no").orderBy(F.desc("strength"), "key")
    first = candidates.select("stream", "key", "interval_no", "strength").withColumn("place", F.row_number().over(best)).where(F.col("place") <= 2 * limit)
    first = written(first.join(holds, ["stream", "key", "interval_no"]), "peak-candidates")
    lo, hi = first.agg(F.min("interval_no"), F.max("interval_no")).first()
    spells, members = None, []
    for start in range(lo, hi + 1, span) if lo is not None else []:
        part = first.where((F.col("interval_no") >= start) & (F.col("interval_no") < start + span))
        found = written(part.groupBy("stream").applyInPandas(_replay(limit, members), "stream string, key string, first long, until long"), "peak-spells")
        spells = found if spells is None else spells.unionByName(found)
        if start + span <= hi:
            members = [m for m in members if m[3] > start + span] + [tuple(r) for r in found.where(F.col("until") > start + span).collect()]
    return spells if spells is not None else candidates.sparkSession.createDataFrame([], "stream string, key string, first long, until long")


def _replay(limit: int, members: list[tuple]):
    """Enters a stream's candidates in order; members: (stream, key, first, until) from the spans before."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        stream = rows["stream"].iloc[0]
        until = {m[1]: m[3] for m in members if m[0] == stream}
        out = []
        for now, g in rows.sort_values(["interval_no", "place"]).groupby("interval_no"):
            until = {k: u for k, u in until.items() if u > now}
            for key, u in zip(g["key"], g["until"], strict=True):
                if len(until) >= limit:
                    break
                if key not in until:
                    until[key] = u
                    out.append((stream, key, now, u))
        return pd.DataFrame(out, columns=["stream", "key", "first", "until"])

    return run


def members_after(spells: DataFrame, last: DataFrame) -> DataFrame:
    """(stream, interval_no, key): the members after each interval's close. last: one row, last_no, the last interval."""
    rows = spells.crossJoin(F.broadcast(last)).where(F.col("first") <= F.col("last_no"))
    return rows.select("stream", F.explode(F.sequence("first", F.least(F.col("until") - 1, F.col("last_no")))).alias("interval_no"), "key")


def members_before(spells: DataFrame, last: DataFrame) -> DataFrame:
    """(stream, interval_no, key): the members before each interval's close, which are those after the close of the one before."""
    return members_after(spells, last).withColumn("interval_no", F.col("interval_no") + 1)


def peak_lifecycle(keys: DataFrame, candidates: DataFrame, limit: int = 20, grace: int = 15, span: int = 10_000) -> DataFrame:
    """(stream, interval_no, key, contention): members of each stream's peak list after each interval.

    contention: candidates of that interval that were neither members nor admitted.
    """
    spells = peak_spells(keys, candidates, limit, grace, span)
    members = members_after(spells, keys.agg(F.max("interval_no").alias("last_no")))
    held = spells.select("stream", "key", "first", "until")
    outside = candidates.select("stream", "key", "interval_no").join(held, ["stream", "key"], "left").groupBy("stream", "key", "interval_no").agg(F.max(F.coalesce((F.col("first") <= F.col("interval_no")) & (F.col("until") > F.col("interval_no")), F.lit(False))).alias("inside"))
    refused = outside.groupBy("stream", "interval_no").agg(F.count_if(~F.col("inside")).alias("contention"))
    return members.join(refused, ["stream", "interval_no"], "left").select("stream", "interval_no", "key", F.coalesce("contention", F.lit(0)).cast("long").alias("contention"))


def change_inputs(ranked: DataFrame, hits: DataFrame, before: DataFrame) -> DataFrame:
    """(stream, key, interval_no, hits): what an interval's distributions consist of, the peaks of each stream and the `wave`.

    before: members before each close (members_before), at most 25 for each stream. hits: (stream, key, interval_no, hits).
    ranked: the first 25 keys of each stream and interval; the words among them that are no peaks are the wave. Keys without hits
    have no share.
    """
    peaks = hits.select("stream", "key", "interval_no", "hits").join(before, ["stream", "key", "interval_no"], "left_semi")
    wave = word_wave(ranked, before).select(F.lit("wave").alias("stream"), "key", "interval_no", "hits")
    return peaks.unionByName(wave).where("hits > 0")


def peak_counts(peaks: DataFrame, depth: int = 80) -> DataFrame:
    """Members of each stream's peak list now, and their mean over the last intervals."""
    n = peaks.groupBy("stream", "interval_no").agg(F.count("*").alias("members"))
    return n.withColumn("mean_members", F.round(F.avg("members").over(Window.partitionBy("stream").orderBy("interval_no").rangeBetween(-(depth - 1), 0)), 6))


def lane_maxima(lanes: DataFrame, names: list[str], totals: DataFrame, depth: int = 80, flux: int = 3) -> DataFrame:
    """(interval_no, top, bound, line_mean) of every interval, over the compete lanes of these names; absent lanes have 0 hits.

    top: the best count. bound: the mean of the lanes' maxima over the completed intervals. line_mean: the mean of the last flux
    highest such maxima, this interval's included.
    """
    past = Window.partitionBy("lane").orderBy("interval_no").rowsBetween(-depth, -1)
    dense = dense_lanes(lanes.where(F.col("name").isin(names)), totals).withColumn("peak", F.coalesce(F.max("value").over(past), F.lit(0)))
    per = dense.groupBy("interval_no").agg(F.max("value").alias("top"), (F.sum("peak") / len(names)).alias("bound"), F.max("peak").alias("most"))
    recent = Window.orderBy("interval_no").rowsBetween(1 - flux, 0)
    return per.select("interval_no", "top", "bound", F.avg("most").over(recent).alias("line_mean"))


def promote_bots(bots: DataFrame, lanes: DataFrame, most: int = 1, first: int = 3, span: int = 1_000) -> DataFrame:
    """(name, valid_from, hits): bot names that become rules of their own.

    bots: (interval_no, key, hits). lanes: (interval_no, top, bound) of lane_maxima. In an interval where the bots together exceed
    every compete lane, the most frequent name that reaches the mean of the lanes' maxima so far is promoted (ties to the smaller
    name); up to three at the first interval. Promotions depend on those before, so intervals are folded in order, in spans. Spark
    sums each interval and finds the names that could be promoted at all: those that reach the bound in an interval that could
    promote and rank there among the first that a span can take. Only their rows come to the fold; names promoted in earlier spans
    are left out by a join, so nothing passes the driver.
    """
    spark, out = bots.sparkSession, "name string, valid_from long, hits long"
    rows = written(bots.join(lanes.select("interval_no", "top", "bound"), "interval_no", "left").fillna(0, ["top", "bound"]), "bot-keys")
    folder = shared_folder(spark, "promoted")
    spark.createDataFrame([], out).write.parquet(f"{folder}/span=-1")  # so that a table without bots has a result
    promoted = lambda: spark.read.schema(out).parquet(folder).select("name", "valid_from", "hits")
    lo, hi = rows.agg(F.min("interval_no"), F.max("interval_no")).first()
    best = Window.partitionBy("interval_no").orderBy(F.desc("hits"), "key")
    for start in range(lo, hi + 1, span) if lo is not None else []:
        part = rows.where((F.col("interval_no") >= start) & (F.col("interval_no") < start + span))
        left = part.join(promoted().select(F.col("name").alias("key")), "key", "left_anti")
        left = left.join(left.groupBy("interval_no").agg(F.sum("hits").alias("total")), "interval_no").where("total > top")
        able = left.withColumn("place", F.row_number().over(best)).where((F.col("place") <= most * span + first) & (F.col("hits") >= F.col("bound")))
        own = left.join(able.select("key").distinct(), "key", "left_semi").withColumn("all", F.lit(1))
        own.groupBy("all").applyInPandas(_promote(lo, most, first), out).write.parquet(f"{folder}/span={start}")
    return promoted()


def _promote(start: int, most: int, first: int):
    """Promotes the names of a span's intervals in order; start: the very first interval, which may promote several."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        done: set = set()
        out = []
        for now, g in pdf.sort_values("interval_no").groupby("interval_no"):
            gone = g["key"].isin(done)
            left = int(g["total"].iloc[0]) - int(g.loc[gone, "hits"].sum())
            if int(g["top"].iloc[0]) >= left:
                continue
            bound = float(g["bound"].iloc[0])
            ranked = g[~gone].sort_values(["hits", "key"], ascending=[False, True])
            for k, (name, n) in enumerate(ranked[["key", "hits"]].head(first if now == start else most).itertuples(index=False)):
                if n < (bound if k == 0 or bound else left // 4):
                    break
                out.append((name, int(now) + 1, int(n)))
                done.add(name)
                left -= n
        return pd.DataFrame(out, columns=["name", "valid_from", "hits"])

    return fold
