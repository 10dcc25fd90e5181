import re

from pyspark.sql import functions as F

from trafficlens.functions import text as T
from trafficlens.functions import values as V
from trafficlens.operators import rules as R
from trafficlens.sources import access_log as A

GOOD = '10.1.2.3 - - [05/Mar/2024:10:11:12 +0100] "GET /a?b=1 HTTP/1.1" 200 512 "-" "Mozilla/5.0 (X11; Linux) Foo"'


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_id long, line string")


def test_parse_good_lines(spark):
    quoted = GOOD.replace("Foo", 'say "hi" Foo')
    rows = {r.line_id: r for r in A.parse_requests(lines(spark, GOOD, GOOD + ' "-"', GOOD + "   ", quoted, GOOD.replace("Mozilla/5.0 (X11; Linux) Foo", ""))).collect()}
    assert len(rows) == 5
    assert (rows[0].ip, rows[0].ip_prefix, rows[0].status, rows[0].bytes, rows[0].referer) == ("10.1.2.3", "10.1.", "200", 512, "-")
    assert str(rows[0].ts) == "2024-03-05 10:11:12"
    assert rows[1].user_agent == rows[0].user_agent == rows[2].user_agent == "Mozilla/5.0 (X11; Linux) Foo"
    assert rows[3].user_agent.endswith('say "hi" Foo')
    assert rows[4].user_agent == "" and rows[4].ua_tokens == []


def test_reject_reasons(spark):
    bad = ["", "nospace", GOOD.replace("10.1.2.3", "localhost"), GOOD.replace(" 512 ", " - "), GOOD.replace('"-" ', ""), GOOD.replace("Mar", "Foo"), "!!! add x"]
    got = {r.line_id: r.reason for r in A.parse_rejects(lines(spark, *bad)).collect()}
    assert got == {0: "no_space", 1: "no_space", 2: "ip", 3: "bad_bytes", 4: "quotes", 5: "time"}
    assert [r.command for r in A.command_lines(lines(spark, *bad)).collect()] == ["add x"]


def test_offset_is_honoured_on_request(spark):
    r = lines(spark, GOOD).select(T.parse_time(F.col("line")).alias("a"), T.parse_time(F.col("line"), True).alias("b")).first()
    assert (r.a - r.b).total_seconds() == 3600


def test_tokens_and_bands(spark):
    df = spark.createDataFrame([("GET /x/abc?q=12 HTTP/1.1", "ab GoodBot/2 1.2E3 Chrome", "http://h.org/pa/th"), ("GET / HTTP/1.1", "", "-")], "request string, ua string, referer string")
    ua = T.agent_tokens(F.col("ua"))
    rows = df.select(T.word_tokens(ua, F.col("request")).alias("w"), T.referer_tokens(F.col("referer")).alias("r"), T.bot_name(ua).alias("b"), T.bot_like(F.col("ua")).alias("l")).collect()
    assert rows[0].w == ["GoodBot", "abc", "q=12"] and rows[0].r == ["h.org"] and rows[0].b == "GoodBot" and rows[0].l
    assert rows[1].w == ["--filtered--"] and rows[1].r == ["--empty--"] and rows[1].b is None
    sizes = spark.createDataFrame([(n,) for n in (0, 99, 100, 1023, 1024, 1048575, 1048576)], "n long").select(V.size_band(F.col("n")).alias("b")).collect()
    assert [r.b for r in sizes] == ["<100B", "<100B", "100–300B", "700B–1K", "1–10K", "500K–1M", ">1M"]
    text = spark.createDataFrame([(7,), (12345,), (2_340_000,), (99_999_999,)], "n long").select(V.format_count(F.col("n")).alias("t")).collect()
    assert [r.t for r in text] == ["   7", " 12K", " 2.3M", "----"]


def test_rules_are_checked(spark):
    rules, bad = R.rules_from_rows(spark, [("a", "compete", "line", ["x"]), ("a", "compete", "line", ["y"]), (None, "compete", "line", ["x"]), ("c", "compete", "nope", ["x"]), ("d", "compete", "regex", ["(x"]), ("e", "observe", "line", []), ("f", "compete", "line", ["10.1.2."])])
    assert {r.name: r.scope for r in rules.collect()} == {"a": "line", "f": "ips"}
    assert sorted(r.reason for r in bad.collect()) == ["duplicate name", "empty name", "empty pattern", "regex", "scope"]


def test_claims_memory_and_marks_follow_a_line_by_line_model(spark):
    import random

    rng = random.Random(3)
    rules = [("r1", "compete", "line", ["aa"]), ("r2", "compete", "words", ["bb"]), ("bots", "bots", "bots", []), ("o", "observe", "line", ["cc"])]
    data = []
    for i in range(400):
        bits = [w for w in ("aa", "bb", "cc", "Xbot") if rng.random() < 0.15]
        data.append((i, f"10.1.1.{rng.randrange(6)}", " ".join(bits)))
    df = spark.createDataFrame([(i, ip, t, "200", 1, "-", t, t, 0) for i, ip, t in data], "line_id long, ip string, request string, status string, bytes long, referer string, user_agent string, line string, interval_no long")
    known = R.with_memory(R.claim_lines(R.match_rules(A.with_derived(df), R.rules_from_rows(spark, rules)[0])))
    got = {r.line_id: (r.claim, r.mark) for r in R.mark_lines(known).collect()}
    related = {(r.line_id, r.name) for r in R.remembered_hits(known).collect()}
    seen, want, want_related = {"r1": set(), "r2": set()}, {}, set()
    for i, ip, t in data:
        claim = "r1" if "aa" in t else "r2" if "bb" in t else "bots" if "bot" in t else None
        tag = next((r for r in ("r1", "r2") if ip in seen[r]), None)
        for r in ("r1", "r2"):
            if r == claim:
                break
            if ip in seen[r]:
                want_related.add((i, r))
        want[i] = (claim, tag or claim or ("o" if "cc" in t else None))
        if claim in seen:
            seen[claim].add(ip)
    assert got == want
    assert related == want_related


def test_empty_tables(spark):
    none = spark.createDataFrame([], "line_id long, line string")
    assert A.parse_requests(none).count() == 0 and A.parse_rejects(none).count() == 0


def test_large_formats(spark):
    df = spark.createDataFrame([(n,) for n in (7, 999, 1000, 999_999, 2_340_000, 45_000_000, 7_100_000_000, 88_000_000_000, 3 * 10**12, 2**60)], "n long")
    assert [r.t for r in df.select(V.format_large_count(F.col("n")).alias("t")).collect()] == ["7", "999", "1K", "999K", "2.3M", "45M", "7.1B", "88B", "3.0T", "1152921T+"]
    assert [r.t for r in df.select(V.format_bytes(F.col("n")).alias("t")).collect()][-1] == " 1E"


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    want = []
    for k, size in enumerate((5, 4000, 40, 900)):  # Spark reads the largest file first
        text = [f"file {k} line {i} " + "x" * (i % 50) for i in range(size)]
        (tmp_path / f"part-{k}.log").write_text("\n".join(text) + "\n")
        want += text
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        got = A.read_access_log(spark, str(tmp_path)).orderBy("line_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line for r in got] == want and [r.line_id for r in got] == list(range(len(want)))


def test_rule_files_of_several_parts(spark, tmp_path):
    rows = [("regex", "(a(b(c)d)e)"), ("expr", "status = '500' and bytes > 10"), ("regex", "(x"), ("expr", "status = ("), ("line", "GET"), ("words", "bot")]
    spark.createDataFrame([(i, f"r{i}", "observe", s, [p]) for i, (s, p) in enumerate(rows)], "i int, name string, lane string, scope string, patterns array<string>").repartitionByRange(3, "i").drop("i").write.json(str(tmp_path / "rules"))
    rules, bad = R.read_rules(spark, str(tmp_path / "rules"))
    assert [r.name for r in rules.orderBy("rank").collect()] == ["r0", "r1", "r4", "r5"]
    assert {r.name: r.reason for r in bad.collect()} == {"r2": "regex", "r3": "expr"}


def test_literal_rules_equal_the_table_form(spark, monkeypatch):
    texts = [GOOD, GOOD.replace("200 512", "500 99"), GOOD.replace("10.1.2.3", "10.1.22.3").replace("Foo", "Xbot"), GOOD.replace("/a?b=1", "/abcde")]
    rules, _ = R.rules_from_rows(spark, [("e", "compete", "code", ["500"]), ("p", "compete", "ips", ["10.1.2.", "10.1."]), ("h", "observe", "ips", ["10.1.2.3"]), ("b", "bots", "bots", []), ("w", "observe", "words", ["Foo", "zzz"]), ("r", "observe", "regex", ["a(b(c)d)e"]), ("x", "observe", "expr", ["bytes > 100 and referer = '-'"]), ("s", "observe", "starts", ["10.1.2.3 "])])
    rules = rules.withColumn("valid_from", F.when(F.col("name") == "p", 1).otherwise(0).cast("long")).withColumn("valid_to", F.when(F.col("name") == "w", 3).cast("long"))
    requests = A.parse_requests(lines(spark, *texts))
    get = lambda: {r.line_id: [h.name for h in r.hits] for r in R.match_rules(requests, rules).collect()}
    want = get()
    assert want == {0: ["h", "w", "x", "s"], 1: ["e", "p", "h", "w", "s"], 2: ["p", "b", "x"], 3: ["p", "h", "r", "x", "s"]}
    monkeypatch.setattr(R, "INLINE_RULES", 0)
    assert get() == want


def test_a_regex_rule_counts_addresses_until_another_key_turns_it(spark):
    import random

    rng = random.Random(8)
    ips = ["1.1.1.1", "1.1.1.2", "2.2.2.2"]
    for turn_from in (0, 25, 1000):
        lines = []
        for i in range(60):
            ip = rng.choice(ips)
            keys = [ip] if rng.random() < 0.4 else []
            if i >= turn_from and rng.random() < 0.4:
                keys = [rng.choice([*ips, "word"]) for _ in range(rng.choice([1, 2]))]
            lines.append((i, i // 10, ip, 5, " ".join(f"<{k}>" for k in keys)))
        # the same, line by line
        want, by_key, counts = [], False, {}
        for i, n, ip, _, line in lines:
            keys = re.findall("<([^>]*)>", line)
            if keys and not by_key and keys[0] != ip:
                by_key = True
            for k in keys if by_key else keys[:1]:
                want.append((i, n, "key" if by_key else "address", k))
            if not keys and ip in counts:
                want.append((i, n, "related", ip))
            for k in keys if by_key else [ip] * bool(keys):
                counts[k] = counts.get(k, 0) + 1
        df = spark.createDataFrame(lines, "line_id long, interval_no long, ip string, bytes long, line string")
        got = [(r.line_id, r.interval_no, r.kind, r.key) for r in R.regex_lane(df, "own", "<([^>]*)>").collect()]
        assert sorted(got) == sorted(want)
        kinds = {k for _, _, k, _ in want}
        assert "related" in kinds and ("key" in kinds) == (turn_from < 1000) and ("address" in kinds or turn_from == 0)
