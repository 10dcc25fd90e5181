"""Steps that many queries share do their work once."""

import random

from pyspark.sql import functions as F

from trafficlens.operators import keys as K
from trafficlens.operators import rules as R
from trafficlens.plans import requests as Q
from trafficlens.streaming import live as S


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_replayed_table_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(n):
        seen.add(1)
        return n

    df = spark.range(0, 90, 1, 3).select(F.udf(look, "long")("id").alias("interval_no"))
    assert S.replay(spark, df, "interval_no").isStreaming
    assert seen.value == 90


def test_key_streams_take_one_walk(spark):
    lines = spark.createDataFrame([(1, 0, 5, "200", ["aa"], ["b", "b"]), (2, 0, 7, "404", [], ["c"])], "line_id long, interval_no long, bytes long, status string, x array<string>, y array<string>")
    hits = K.key_hits(lines, {"x": F.col("x"), "y": F.col("y")})
    assert "Union" not in _plan(hits)
    got = sorted(map(tuple, hits.select("stream", "key", "line_id", "bytes", "status").collect()))
    assert got == [("x", "aa", 1, 5, "200"), ("y", "b", 1, 5, "200"), ("y", "b", 1, 5, "200"), ("y", "c", 2, 7, "404")]


def test_claims_search_no_observed_regex(spark):
    d = "/root/testdata/sf0.001"
    known = Q.known(spark, d)
    assert "PaleMoon" not in _plan(known)
    with_all = R.with_memory(R.claim_lines(R.match_rules(Q.hourly_requests(spark, d), Q.rules(spark))))
    rows = lambda df: sorted(map(str, R.mark_lines(df).select("line_id", "claim", "mark", "known").collect()))
    assert rows(known) == rows(with_all)


def test_group_history_pairs_no_key_with_its_past(spark):
    rng = random.Random(4)
    rows = [("ips", f"10.{k % 2}.1.{k}", i, rng.randrange(1, 4), 10) for k in range(9) for i in range(120) if rng.random() < 0.5]
    keys = spark.createDataFrame(rows, "stream string, key string, interval_no long, hits long, bytes long")
    s = K.with_scores(K.key_state(K.with_silent(K.retention_islands(keys, 5, 60), 5, 60)))
    s = spark.createDataFrame(s.collect(), s.schema)
    out = K.ip_group_history(s, K.ip_groups(s, 2, 25))
    assert "RangeFrame, -80" not in _plan(out)
    kept = {}
    for r in s.collect():
        kept.setdefault((r.key.rsplit(".", 2)[0] + ".", r.interval_no), []).append((r.key, r.island_start))
    hits = {(r.key, r.island_start, r.interval_no): r.hits for r in s.collect()}
    got = out.collect()
    assert len(got) > 100
    for g in got:
        members = kept[g.ip_prefix, g.interval_no]
        assert g.history == [sum(hits.get((*m, at), 0) for m in members) for at in range(g.interval_no - g.depth, g.interval_no)]
