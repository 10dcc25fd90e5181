"""Keyed retention as a stream: state that its timers end."""

import os
import random

from pyspark.sql import functions as F

from trafficlens.operators import change as C
from trafficlens.operators import keys as K
from trafficlens.sources.shared import shared_folder
from trafficlens.streaming import live as S


def test_retention_state_holds_live_keys_only(spark):
    rng = random.Random(6)
    rows = []
    for stream, quiet in (("words", 1), ("ips", 2)):
        for k in range(6):
            at = rng.randrange(10)
            while at < 60:
                rows.append((stream, f"k{k}", at, rng.randrange(1, 5)))
                at += rng.choice([1, 1, 2, 2, 3, 9])
    rows.append(("words", "early", 0, 3))  # gone long before the end
    rows.append(("words", "late", 59, 3))
    keys = spark.createDataFrame(rows, "stream string, key string, interval_no long, hits long")
    timed = keys.withColumn("ts", F.timestamp_seconds((F.col("interval_no") + 1) * 60))
    folder = shared_folder(spark, "retention-test")
    got = S.run_in_parts(spark, timed, "interval_no", lambda s: S.stream_key_retention(s, {"words": 1, "ips": 2}), "retention", parts=4, conf=S.ROCKS, folder=folder)
    names = ["stream", "key", "interval_no", "island_start", "hits", "depth", "history_total", "history_peak", "prime_flux"]
    want = K.key_state(K.retention_islands(keys, 5, 60)).select(*names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.collect()))
    state = spark.read.format("statestore").option("stateVarName", "seen").load(f"{folder}/checkpoint")
    left = {(r.stream, r.key) for r in state.select("key.*").collect()}
    last = {}
    for stream, key, at, _ in rows:
        last[stream, key] = max(at, last.get((stream, key), 0))
    end = max(at for _, _, at, _ in rows)
    live = {k for k, at in last.items() if end - at <= {"words": 1, "ips": 2}[k[0]]}
    assert live <= left and ("words", "early") not in left
    assert all(end - last[k] <= {"words": 1, "ips": 2}[k[0]] + 1 for k in left)


def test_log_of_intervals_and_alerts_is_written_once(spark):
    rng = random.Random(9)
    values = [{"a": rng.choice([0, 0, 5, 5, 5]), "b": rng.choice([0, 4])} for _ in range(36)]
    rows = spark.createDataFrame([(i, 10 + i, v) for i, v in enumerate(values)], "interval_no long, n_lines long, values map<string, long>")
    rules = spark.createDataFrame([("a", "above", 3), ("a", "below", 1), ("b", "above", 2)], "lane string, direction string, threshold long")
    lanes = rows.select("interval_no", F.explode("values").alias("lane", "value"))
    for flux in (1, 3):
        folder = shared_folder(spark, "log-test")

        def run(folder=folder, flux=flux):
            return sorted(map(tuple, S.write_log(spark.readStream.schema(rows.schema).parquet(f"{folder}/source"), rules, folder, flux).collect()), key=lambda r: r[:2])

        for lo, hi in ((0, 11), (11, 12), (12, 12), (12, 36)):  # three stops; one part has no rows
            rows.where((F.col("interval_no") >= lo) & (F.col("interval_no") < hi)).write.mode("append").parquet(f"{folder}/source")
            got = run()
        turned = sorted(map(tuple, C.alert_transitions(C.alert_states(rules, lanes, flux)).select("interval_no", "lane", "direction", "threshold", "value", "event").collect()))
        want = []
        for i in range(36):
            own = [t for t in turned if t[0] == i]
            want += [(i, 0, "interval", None, None, None, 10 + i, None)] + [(i, p, "alert", *t[1:]) for p, t in enumerate(own, 1)]
        assert got == want and len(turned) > 3
        commits = folder.removeprefix("file://") + "/checkpoint/commits"
        last = max(int(n) for n in os.listdir(commits) if n.isdigit())
        os.remove(f"{commits}/.{last}.crc")
        os.remove(f"{commits}/{last}")  # as if the driver had been lost after the batch's writes
        assert run() == want
