"""Peak candidates, peak lists and the inputs of the change score against a replay of one interval after the other."""

import random

from trafficlens.functions import values as V
from trafficlens.operators import change as C
from trafficlens.operators import keys as K

KEYS = "stream string, key string, interval_no long, hits long"


def replay(hits, lines, limit, grace, push=5, depth=80, flux=3):
    """(candidates, members after each close, contention, change inputs) of {(stream, key): {interval: hits}}, minute by minute."""
    keep = dict(zip(K.STREAMS, (t // 60 for t in V.RETENTION[push]), strict=True))
    known, peaks, empty = {}, {s: [] for s in K.STREAMS}, {}
    candidates, members, contention, inputs = set(), {}, {}, {}
    past_lines, tops = [], []
    for now, n_lines in enumerate(lines):
        for (stream, key), at in hits.items():
            if now in at:
                last, history = known.get((stream, key), (None, []))
                if last is not None and now - last > keep[stream]:
                    history = []
                known[stream, key] = (now, history)
        for stream in K.STREAMS:
            count = {k: hits[s, k].get(now, 0) for s, k in hits if s == stream}
            inputs[stream, now] = {k: count[k] for k in peaks[stream] if count[k]}
            if stream == "words":  # retained until a hit comes too late
                score = {k: count[k] + count[k] + sum(h[-flux:]) for (s, k), (last, h) in known.items() if s == stream and now - last <= keep[stream]}
                first = sorted(score, key=lambda k: (-score[k], k))[:25]
                inputs["wave", now] = {k: count[k] for k in first if k not in peaks[stream] and count[k]}
        tops.append(max(past_lines[-depth:], default=0))
        past_lines.append(n_lines)
        line_mean, mean5 = sum(tops[-3:]) / len(tops[-3:]), sum(past_lines[-5:]) / len(past_lines[-5:])
        denominator = mean5 / 10 if now == 0 else (sum(tops[-flux:]) + 2 * mean5) / ((flux + 2) * 10)
        for stream in K.STREAMS:
            wanted = []
            for (s, key), (last, history) in list(known.items()):
                if s != stream:
                    continue
                count = hits[s, key].get(now, 0)
                member = key in peaks[stream]
                stale = now - last > keep[stream] - 1
                if stale and not member:
                    del known[s, key]
                    continue
                history = (history + [count])[-depth:]
                known[s, key] = (last, history)
                if member:
                    empty[s, key] = 0 if count else empty[s, key] + 1
                    if empty[s, key] >= grace:
                        peaks[stream].remove(key)
                        del known[s, key]
                    continue
                if len(history) < grace:
                    continue
                mean = sum(history) / len(history)
                if stream == "ips":
                    spread = (sum((x - mean) ** 2 for x in history) / len(history)) ** 0.5
                    burst = 0 if len(history) <= 1 or not mean else spread / mean * len(history) / 80
                    strength, able = float(count), count > 10 and burst >= 1 or count > line_mean / 10
                else:
                    strength = mean
                    able = mean / denominator >= 1
                if able:
                    candidates.add((stream, key, now))
                    wanted.append((-round(strength, 6), key))
            free = max(0, limit - len(peaks[stream]))
            for _, key in sorted(wanted)[:free]:
                peaks[stream].append(key)
                empty[stream, key] = 0
            contention[stream, now] = len(wanted) - min(free, len(wanted))
            members[stream, now] = sorted(peaks[stream])
    return candidates, members, contention, inputs


def traffic(seed, n=70):
    """Keys that come and go, some steady, some in bursts; few levels, so that strengths tie."""
    rng = random.Random(seed)
    hits = {}
    for stream in K.STREAMS:
        for k in range(9):
            at, now = {}, rng.randrange(20)
            while now < n:
                for _ in range(rng.randrange(1, 25)):
                    if now < n:
                        at[now] = rng.choice([1, 2, 2, 4, 30])
                    now += rng.choice([1, 1, 1, 2, 3])
                now += rng.randrange(2, 30)
            hits[stream, f"k{k}"] = at
    return hits, [rng.choice([20, 40, 60]) for _ in range(n)]


def test_peaks_against_a_replay(spark):
    for seed, span in ((1, 10_000), (2, 7)):
        hits, lines = traffic(seed)
        limit, grace = 3, 4
        want_candidates, want_members, want_contention, want_inputs = replay(hits, lines, limit, grace)
        keys = spark.createDataFrame([(s, k, i, n) for (s, k), at in hits.items() for i, n in at.items()], KEYS)
        totals = spark.createDataFrame(list(enumerate(lines)), "interval_no long, n_lines long")
        islands = K.retention_islands(keys.selectExpr("*", "0L as bytes", "interval_no as first_line_id"), 5, 60)
        closed = K.closed_state(K.with_silent(islands, 5, 60, closing=True))
        candidates = K.peak_candidates(closed, K.norm_denominator(totals), K.line_means(totals), grace)
        got = {(r.stream, r.key, r.interval_no): r.strength for r in candidates.collect()}
        # members are judged too, and neither enter again nor count as refused
        assert want_candidates <= set(got)
        assert all(k in want_members[s, i] or k in want_members[s, i - 1] for s, k, i in set(got) - want_candidates)
        members: dict = {}
        for r in C.peak_lifecycle(keys, candidates, limit, grace, span).collect():
            members.setdefault((r.stream, r.interval_no), []).append((r.key, r.contention))
        assert {at: sorted(k for k, _ in m) for at, m in members.items()} == {at: m for at, m in want_members.items() if m}
        assert all(c == want_contention[at] for at, m in members.items() for _, c in m)
        assert any(want_contention.values()) and len({tuple(m) for m in want_members.values()}) > 10

        spells, last = C.peak_spells(keys, candidates, limit, grace, span), spark.createDataFrame([(len(lines) - 1,)], "last_no long")
        ranked = K.rank_keys(K.with_scores(K.key_state(K.with_silent(islands, 5, 60))))
        inputs: dict = {}
        for r in C.change_inputs(ranked, keys, C.members_before(spells, last)).collect():
            inputs.setdefault((r.stream, r.interval_no), {})[r.key] = r.hits
        assert inputs == {at: m for at, m in want_inputs.items() if m} and any(s == "wave" for s, _ in inputs)


def test_no_candidates(spark):
    none = spark.createDataFrame([], KEYS)
    assert not C.peak_lifecycle(none, none.selectExpr("stream", "key", "interval_no", "1.0D as strength")).count()
