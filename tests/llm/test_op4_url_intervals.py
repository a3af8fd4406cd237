import datetime as dt
import random

from pyspark.sql import functions as F

from runledger.llm.url_intervals import intervals, judge

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)


def brute_active(log, name, pattern, day):
    days = {}
    for n, p, action, d in log:
        if n == name and p is not None and p.lower() == pattern and d is not None and d <= day and action in ("add", "remove"):
            days.setdefault(d, set()).add(action)
    return bool(days) and "remove" not in days[max(days)]


def test_judgements_equal_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "B.org", "com"]
    log = [
        (rng.choice(["spam", "adult"]), rng.choice([*hosts, "a.com/p", "x.a.com/p/q"]), rng.choice(["add", "remove"]), DAY(rng.randint(0, 30)))
        for _ in range(60)
    ] + [("spam", None, "add", DAY(1)), ("spam", "a.com", "other", DAY(1)), ("spam", "b.org", "add", None)]
    urls = [
        "http://" + rng.choice(["", "u:p@"]) + rng.choice(hosts) + rng.choice(["", ":80"]) + rng.choice(["", "/", "/p", "/p/q/r?x=/a", "//p//q", "#f", "?q"])
        for _ in range(150)
    ] + [None, "", "not a url", "mailto:x@a.com"]
    caps = [(i % 140, u, None if i % 25 == 0 else DAY(rng.randint(0, 35))) for i, u in enumerate(urls)]
    entries = spark.createDataFrame(log, "list_name string, pattern string, action string, day date")
    captures = spark.createDataFrame(caps, "capture_id bigint, url string, fetched date").repartition(3)
    got = sorted(tuple(r) for r in judge(captures, entries).collect())

    def want(cap):
        i, url, day = cap
        found = []
        if url and "://" in url and day:
            rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
            host, _, path = rest.partition("/")
            host = host.split("@")[-1].split(":")[0].lower()
            labels, parts = host.split("."), [p for p in path.lower().split("/") if p]
            names = [".".join(labels[k:]) for k in range(len(labels))]
            names += [host + "/" + "/".join(parts[: k + 1]) for k in range(len(parts))]
            found = sorted(f"{n}:{p}" for n in ("spam", "adult") for p in set(names) if brute_active(log, n, p, day))
        return (i, len(found), ",".join(found), bool(found))

    assert got == sorted(map(want, caps))
    assert any(r[1] > 1 for r in got)


def test_intervals(spark):
    log = [("l", "p", a, DAY(d)) for a, d in (("remove", 0), ("add", 1), ("add", 3), ("remove", 5), ("add", 7), ("remove", 7), ("add", 9))]
    out = intervals(spark.createDataFrame(log, "list_name string, pattern string, action string, day date"))
    assert sorted((r["valid_from"], r["valid_to"]) for r in out.collect()) == [(DAY(1), DAY(5)), (DAY(9), None)]


def test_empty_tables(spark):
    entries = spark.createDataFrame([], "list_name string, pattern string, action string, day date")
    captures = spark.createDataFrame([(1, "http://a.com/", DAY(0))], "capture_id bigint, url string, fetched date")
    assert [tuple(r) for r in judge(captures, entries).collect()] == [(1, 0, "", False)]
    assert judge(captures.limit(0), entries).count() == 0


def test_very_long_urls_and_clashing_columns(spark):
    deep, wide = "/".join(f"d{i}" for i in range(20_000)), ".".join(f"h{i}" for i in range(20_000))
    log = [("l", "a.com/d0/d1", "add", DAY(0)), ("l", "h19998.h19999", "add", DAY(0)), ("l", "h0.h1", "add", DAY(0)), ("m", "A.com/d0/d1/d2", "add", DAY(1))]
    urls = [f"http://a.com/{deep}", f"http://{wide}/x", f"http://a.com//d0/?{deep}", "http://x.a.com/d0/d1/d2"]
    entries = spark.createDataFrame(log, "list_name string, pattern string, action string, day date")
    captures = spark.createDataFrame([(i, u, DAY(2)) for i, u in enumerate(urls)], "capture_id bigint, url string, fetched date")
    clashing = ["rid", "pattern", "spans", "found", "active", "day", "blocked", "n_active"]
    captures = captures.withColumns({c: F.lit(c) for c in clashing})
    entries = entries.withColumns({c: F.lit(c) for c in ("on", "was", "spans", "valid_to", "valid_from", "url", "rid")})
    assert sorted(tuple(r) for r in judge(captures, entries).collect()) == [
        (0, 2, "l:a.com/d0/d1,m:a.com/d0/d1/d2", True),
        (1, 1, "l:h19998.h19999", True),
        (2, 0, "", False),
        (3, 0, "", False),
    ]
