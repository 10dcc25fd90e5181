import random

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import change as C
from trafficlens.operators import keys as K

#: Three pairs of intervals with known scores.
GOLDEN = [
    ((1000, 1048576, 10, 100, 300), (1250, 1310720, 20, 175, 525), {}, {}, 30.25, "errs"),
    (
        (1000, 1048576, 0, 50, 600), (2000, 2097152, 0, 100, 1200),
        {"words": {"catalog": 80, "search": 20}, "refs": {"home": 70, "docs": 30}, "ips": {"192.0.2": 100}, "wave": {"checkout": 30, "login": 10}},
        {"words": {"catalog": 160, "search": 40}, "refs": {"home": 140, "docs": 60}, "ips": {"192.0.2": 200}, "wave": {"checkout": 60, "login": 20}},
        67.8976, "lines",
    ),
    (
        (1000, 1048576, 10, 100, 500), (1000, 1048576, 10, 100, 500),
        {"words": {"catalog": 80, "search": 20}, "refs": {"home": 70, "docs": 30}, "ips": {"192.0.2": 100}, "wave": {"checkout": 90, "login": 10}},
        {"words": {"catalog": 20, "search": 80}, "refs": {"home": 60, "docs": 40}, "ips": {"192.0.2": 100}, "wave": {"checkout": 10, "login": 90}},
        95.187078, "peak balance",
    ),
]


@pytest.mark.parametrize("a,b,ka,kb,score,primary", GOLDEN)
def test_golden_scores(spark, a, b, ka, kb, score, primary):
    shape = spark.createDataFrame([(i, x[0], x[1], x[2], x[1] / x[0], 100 * x[3] / x[0], 100 * x[4] / x[0]) for i, x in enumerate((a, b))], "interval_no long, n_lines long, bytes long, errors long, mean_bytes double, marked_pct double, b16_pct double")
    rows = [(p, k, i, n) for i, side in enumerate((ka, kb)) for p, d in side.items() for k, n in d.items()]
    keys = spark.createDataFrame(rows, "stream string, key string, interval_no long, hits long")
    d = C.distribution_distance(keys).withColumnRenamed("stream", "part")
    got = {r.interval_no: r for r in C.change_scores(shape, d).collect()}
    assert got[0].score is None and got[0].primary is None
    assert abs(got[1].score - score) < 1e-6 and got[1].primary == primary
    assert len(got[1].components) == 8


def test_alerts_follow_a_state_machine(spark):
    rng = random.Random(9)
    values = [rng.choice([0, 1, 5]) for _ in range(200)]
    lanes = spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], "lane string, interval_no long, value long")
    rules = spark.createDataFrame([("x", "above", 3), ("x", "below", 1)], "lane string, direction string, threshold long")
    states = C.alert_states(rules, lanes, 2)
    got = sorted((r.direction, r.interval_no, r.event) for r in C.alert_transitions(states).collect())
    want = []
    for direction, bound in (("above", 3), ("below", 1)):
        active, last, streak = False, None, 0
        for i, v in enumerate(values):
            hit = v >= bound if direction == "above" else v < bound
            streak = streak + 1 if hit == last else 1
            last = hit
            if streak >= 2 and hit != active:
                active = hit
                want.append((direction, i, "triggered" if hit else "recovered"))
    assert got == sorted(want)


def test_alert_rules(spark):
    rules = spark.createDataFrame([("a", "above", 5), ("a", "below", 6), ("b", "below", 0), ("c", "above", -1), ("d", "below", 2)], "lane string, direction string, threshold long")
    good, bad = C.check_alert_rules(rules)
    assert sorted(r.lane for r in good.collect()) == ["a", "d"]
    assert sorted(r.reason for r in bad.collect()) == ["below 1", "below exceeds above", "negative"]


def test_peaks_fill_hold_and_retire(spark):
    hits = [("words", k, i) for k in "abc" for i in range(3)] + [("words", "d", i) for i in range(3, 12)]
    keys = spark.createDataFrame([(*h, 1) for h in hits], "stream string, key string, interval_no long, hits long")
    cand = spark.createDataFrame([("words", "a", 0, 5.0), ("words", "b", 0, 9.0), ("words", "c", 0, 5.0), ("words", "d", 3, 99.0)] + [("words", "d", i, 99.0) for i in range(4, 12)], "stream string, key string, interval_no long, strength double")
    got: dict = {}
    for r in C.peak_lifecycle(keys, cand, limit=2, grace=4).collect():
        got.setdefault(r.interval_no, []).append((r.key, r.contention))
    assert sorted(got[0]) == [("a", 1), ("b", 1)]  # c ties with a and comes later
    assert sorted(got[3]) == [("a", 1), ("b", 1)]  # a strong newcomer displaces nobody
    assert sorted(k for k, _ in got[6]) == ["d"]  # a and b have retired


def test_agent_distance_and_delta(spark):
    rows = [(0, "1.1.1.1", 0, "a b c d e f"), (1, "1.1.1.1", 0, "a b c d"), (2, "1.1.1.1", 1, "a b c d e f"), (3, "1.1.1.1", 1, ""), (4, "2.2.2.2", 1, "x")]
    df = spark.createDataFrame([(i, ip, n, ua, ua.split()) for i, ip, n, ua in rows], "line_id long, ip string, interval_no long, user_agent string, ua_tokens array<string>")
    d = K.agent_distance(df)
    got = {r.line_id: r.distance for r in d.collect()}
    assert got == {1: round(2 / 6, 6), 3: 2.0}
    delta = {(r.ip, r.interval_no): r.agent_delta for r in K.agent_delta(df, d).collect()}
    first = (0 + 2 / 6) / 3
    assert abs(delta["1.1.1.1", 0] - first) < 1e-5 and abs(delta["1.1.1.1", 1] - (first + 2.0) / 3) < 1e-5 and delta["2.2.2.2", 1] == 0


def test_key_state_follows_a_zero_filled_history(spark):
    rng = random.Random(4)
    rows = [("words", "k", i, rng.randrange(1, 9)) for i in range(120) if rng.random() < 0.7]
    keys = spark.createDataFrame(rows, "stream string, key string, interval_no long, hits long")
    got = {r.interval_no: r for r in K.with_scores(K.key_state(K.retention_islands(keys, 0))).collect()}
    count = {i: n for _, _, i, n in rows}
    for i in count:
        start = got[i].island_start
        history = [count.get(j, 0) for j in range(max(start, i - 80), i)]
        assert got[i].depth == len(history) and got[i].history_total == sum(history) and got[i].prime_flux == count[i] + sum(history[-3:])
        if len(history) > 1:
            mean = sum(history) / len(history)
            spread = (sum((x - mean) ** 2 for x in history) / len(history)) ** 0.5
            assert abs(got[i].burst - spread / mean * len(history) / 80) < 1e-5
    line = K.key_history(K.retention_islands(keys, 0), F.lit(100)).first()
    assert line.history == [count.get(j, 0) for j in range(max(got[max(k for k in count if k < 100)].island_start, 20), 100)]


def token_distance(a, b):
    if not a or not b:
        return 2.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] / len(a)


def test_agent_distance_reaches_burst_strength_and_displays(spark):
    rng = random.Random(3)
    agents = ["a b c d e", "a b x", "q", "a b c d e f g h", ""]
    lines = []
    for i in range(500):
        ua = rng.choice(agents)
        lines.append((i, f"10.{rng.randrange(2)}.0.{rng.randrange(3)}", i // 8 + (40 if i > 300 else 0), ua, ua.split(), 1, "200"))
    df = spark.createDataFrame(lines, "line_id long, ip string, interval_no long, user_agent string, ua_tokens array<string>, bytes long, status string")
    hits = K.key_hits(K.with_agent_distance(df), {"words": F.col("ua_tokens"), "ips": F.array("ip")})
    state = K.with_scores(K.with_agent_delta(K.key_state(K.retention_islands(K.key_intervals(hits)))))
    got = {(r.stream, r.key, r.interval_no): r for r in state.collect()}
    keep = {"words": 1, "ips": 2}
    delta, first, seen, count, counts = {}, {}, {}, {}, {}
    for _, ip, now, ua, tokens, _, _ in lines:
        known = ip in first and now - seen["ips", ip] <= keep["ips"]
        d = token_distance(first[ip][1], tokens) if known and first[ip][0] != ua else 0.0
        if not known:
            first[ip] = (ua, tokens)
        for key in [("ips", ip), *(("words", t) for t in tokens)]:
            if key not in seen or now - seen[key] > keep[key[0]]:
                counts[key], count[key], delta[key] = (now, {}), 1, 0.0
            else:
                count[key] = 1 if seen[key] != now else count[key] + 1
                delta[key] = (delta[key] * count[key] + d) / (count[key] + 1)
            seen[key] = now
            counts[key][1][now] = counts[key][1].get(now, 0) + 1
            start, history = counts[key][0], [counts[key][1].get(i, 0) for i in range(max(counts[key][0], now - 80), now)]
            r = got[(*key, now)]
            if r.hits == count[key]:
                assert abs(r.agent_delta - delta[key]) < 1e-5 and r.island_start == start
                mean = sum(history) / len(history) if history else 0
                spread = (sum((x - mean) ** 2 for x in history) / len(history)) ** 0.5 if history else 0
                assert abs(r.strength - (mean * (1 + delta[key]) if history else r.hits)) < 1e-4
                assert abs(r.burst - (spread / mean * (1 + delta[key]) * len(history) / 80 if len(history) > 1 else 0)) < 1e-4
    assert any(r.agent_delta > 0.1 for r in got.values())
    none = spark.createDataFrame([], "ip string, interval_no long")
    ips = {k[1:]: r for k, r in got.items() if k[0] == "ips"}
    for r in K.rank_ips_display(state, none).collect():
        x = ips[r.key, r.interval_no]
        assert r.value == x.score + (int(x.burst * 100) + int(x.agent_delta * 10) if x.prime_flux > 8 else 0)
    histories = {(r.ip_prefix, r.interval_no): r.history for r in K.ip_group_history(state, K.ip_groups(state, 2)).collect()}
    groups = K.ip_groups(state, 2).collect()
    assert groups and len(histories) == len(groups)
    for g in groups:
        own = [x for (ip, i), x in ips.items() if i == g.interval_no and ip.startswith(g.ip_prefix)]
        assert abs(g.agent_delta - sum(x.agent_delta for x in own) / len(own)) < 1e-5
        assert histories[g.ip_prefix, g.interval_no] == [sum(ips[x.key, i].hits for x in own if i >= x.island_start and (x.key, i) in ips) for i in range(g.interval_no - g.depth, g.interval_no)]


def test_promotion_bounds_are_those_of_all_compete_lanes(spark):
    rng = random.Random(8)
    names = ["errors", "net1", "idle"]
    counts = {n: [rng.randrange(0, 30) if n != "idle" and rng.random() < 0.8 else 0 for _ in range(120)] for n in names}
    lanes = spark.createDataFrame([(n, i, x) for n in names for i, x in enumerate(counts[n]) if x] + [("bots", i, 500) for i in range(120)], "name string, interval_no long, hits long")
    totals = spark.createDataFrame([(i, 60) for i in range(120)], "interval_no long, n_lines long")
    maxima = C.lane_maxima(lanes, names, totals)
    peaks = [[max(counts[n][max(0, i - 80) : i], default=0) for n in names] for i in range(120)]
    got = {r.interval_no: r for r in maxima.collect()}
    assert len(got) == 120
    for i, r in got.items():
        recent = [max(p) for p in peaks[max(0, i - 2) : i + 1]]
        assert r.top == max(counts[n][i] for n in names) and abs(r.bound - sum(peaks[i]) / 3) < 1e-9 and abs(r.line_mean - sum(recent) / len(recent)) < 1e-9
    bots = [(i, f"bot{rng.randrange(40)}", rng.randrange(1, 30)) for i in range(120) for _ in range(3)]
    bots = {(i, k): n for i, k, n in bots}
    want, done = [], set()
    for i in range(120):
        own = sorted(((-n, k) for (j, k), n in bots.items() if j == i and k not in done))
        left = -sum(n for n, _ in own)
        if got[i].top >= left:
            continue
        for place, (n, k) in enumerate(own[: 3 if i == 0 else 1]):
            if -n < (got[i].bound if place == 0 or got[i].bound else left // 4):
                break
            want.append((k, i + 1, -n))
            done.add(k)
            left += n
    frame = spark.createDataFrame([(i, k, n) for (i, k), n in bots.items()], "interval_no long, key string, hits long")
    assert len(want) > 5
    for span in (1_000, 7):  # promoted names are carried from span to span
        assert sorted(map(tuple, C.promote_bots(frame, maxima, span=span).collect())) == sorted(want)
    assert C.promote_bots(frame.where("hits > 1000"), maxima).count() == 0
    ips = spark.createDataFrame([("ips", f"10.0.0.{i % 7}", i, 6, n, i) for i in range(120) for n in [rng.randrange(1, 40)]], "stream string, key string, interval_no long, depth long, hits long, first_line_id long")
    marked = spark.createDataFrame([], "ip string, interval_no long, mark string")
    promoted = {r.interval_no: r.hits for r in K.promote_ip(ips, marked, totals, maxima).collect()}
    assert promoted == {r.interval_no: r.hits for r in ips.collect() if r.hits >= got[r.interval_no].line_mean and r.hits >= 6} and 0 < len(promoted) < 119


def test_w17_promotes_only_where_every_compete_lane_has_fewer_hits(spark):
    import __spark_entry__
    from trafficlens.operators import rules as R
    from trafficlens.plans import requests as Q
    from trafficlens.sources.tables_view import hourly_requests

    sf = "/root/testdata/sf0.001"
    best = {r.interval_no: r.n for r in Q.lanes(spark, sf).where("name in ('errors', 'signups', 'net1', 'host', 'clicks')").groupBy("interval_no").agg(F.max("hits").alias("n")).collect()}
    bots = {r.interval_no: r.n for r in R.bot_keys(hourly_requests(spark, sf)).groupBy("interval_no").agg(F.count("*").alias("n")).collect()}
    for r in __spark_entry__.queries()["w17_promote_bots"](spark, sf).collect():
        assert best.get(r.valid_from - 1, 0) < bots[r.valid_from - 1]


def test_w4_lists_every_key_with_the_history_before_its_latest_interval(spark):
    import __spark_entry__
    from trafficlens.plans.keys import islands

    sf, want = "/root/testdata/sf0.001", {}
    rows = sorted((r.stream, r.key, r.interval_no, r.island_start, r.hits) for r in islands(spark, sf).collect())
    for stream, key, now, start, hits in rows:
        counts = want.setdefault((stream, key), (now, start, {}))[2] | {now: hits}
        want[stream, key] = (now, start, counts)
    got = {(r.stream, r.key): r.history for r in __spark_entry__.queries()["w4_key_history"](spark, sf).collect()}
    assert got == {k: ",".join(str(c.get(i, 0)) for i in range(max(start, now - 80), now)) for k, (now, start, c) in want.items()}


def test_lines_under_rules_meet_no_line_twice(spark):
    from trafficlens.operators import rules as R

    rng = random.Random(6)
    changes = {i: (rng.choice(["add", "remove"]), rng.choice("ab")) for i in rng.sample(range(600), 40)}
    lines = [(rng.choice("abc"), i) for i in range(600)]
    want, state = [], {}
    for name, i in lines:
        if i in changes:
            state[changes[i][1]] = changes[i][0]
        want += [(name, i)] if state.get(name) == "add" else []
    a, b = spark.createDataFrame(lines, "name string, line_id long"), spark.createDataFrame([(i, *c) for i, c in changes.items()], "line_id long, action string, name string")
    for width in (7, 100_000):
        out = R.lines_under_rules(a, b, width)
        assert sorted(map(tuple, out.collect())) == sorted(want)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "line_id >=" not in plan and ">= valid_from" not in plan


def test_silent_keys_stay_ranked_until_their_time_is_over(spark):
    from trafficlens.operators import keys as K

    hits = [("words", "a", 0, 5), ("words", "b", 0, 1), ("words", "b", 1, 1), ("ips", "10.1.1.1", 0, 4), ("words", "a", 4, 2), ("words", "c", 6, 1)]
    df = spark.createDataFrame([(s, k, i, n, n * 10) for s, k, i, n in hits], "stream string, key string, interval_no long, hits long, bytes long")
    # words are kept for one quiet interval, addresses for two
    rows = K.with_scores(K.key_state(K.with_silent(K.retention_islands(df, 5, 60))))
    got = {(r.stream, r.key, r.interval_no): (r.hits, r.score) for r in rows.collect()}
    assert got == {
        ("words", "a", 0): (5, 10), ("words", "a", 1): (0, 5), ("words", "a", 4): (2, 4), ("words", "a", 5): (0, 2), ("words", "b", 0): (1, 2), ("words", "b", 1): (1, 3), ("words", "b", 2): (0, 2),
        ("ips", "10.1.1.1", 0): (4, 8), ("ips", "10.1.1.1", 1): (0, 4), ("ips", "10.1.1.1", 2): (0, 4), ("words", "c", 6): (1, 2),
    }
    top = {r.interval_no: r.key for r in K.rank_keys(rows.where("stream = 'words'"), 1).collect()}
    assert top[1] == "a"  # silent, and yet first


def test_agents_of_very_many_tokens(spark):
    base = [f"t{i}" for i in range(700)]
    other = base[:300] + ["new"] + base[350:]
    rows = [(0, "1.1.1.1", 0, " ".join(base), base), (1, "1.1.1.1", 0, " ".join(other), other), (2, "1.1.1.1", 0, "", [])]
    df = spark.createDataFrame(rows, "line_id long, ip string, interval_no long, user_agent string, ua_tokens array<string>")
    assert {r.line_id: r.distance for r in K.with_agent_distance(df).collect()} == {0: 0.0, 1: round(50 / 700, 6), 2: 2.0}


def test_components_that_tie_are_ordered_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from trafficlens.plans.change import _scores

    rows = []
    for i, (n, marked) in enumerate((n, marked) for n in range(12, 60) for marked in range(3)):
        # three times as many b16 lines as marked ones come: both components are equal, and places decide
        for k, (m, b) in enumerate(((marked, 0), (marked + 1, 3))):
            rows.append((3 * i + k, n, 1000, 0, 1000 / n, 100 * m / n, 100 * b / n))
    names = ["interval_no", "n_lines", "bytes", "errors", "mean_bytes", "marked_pct", "b16_pct"]
    got = C.change_scores(spark.createDataFrame(rows, "interval_no long, n_lines long, bytes long, errors long, mean_bytes double, marked_pct double, b16_pct double"))
    values = ", ".join(map(str, rows))
    before = ", ".join(f"lag({c}) OVER (ORDER BY interval_no) AS {c}0" for c in names[1:])
    sql = f"WITH sh0({', '.join(names)}) AS (VALUES {values}), sh AS (SELECT interval_no, n_lines, bytes, errors, CAST(mean_bytes AS DOUBLE) AS mean_bytes, CAST(marked_pct AS DOUBLE) AS marked_pct, CAST(b16_pct AS DOUBLE) AS b16_pct FROM sh0), pr AS (SELECT *, {before} FROM sh)"
    want = duckdb.sql(sql + _scores("", "pr") + ' SELECT interval_no, "primary" FROM cs').fetchall()
    assert sorted(map(tuple, got.select("interval_no", "primary").collect())) == sorted(want)
