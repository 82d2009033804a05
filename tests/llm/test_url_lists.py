import datetime as dt

from loomspark.llm import url_lists

DAY = dt.datetime(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


EVENTS = [("host", "A.example.com", "add", day(10)), ("host", "a.example.com", "remove", day(20)),
          ("host", "a.example.com", "add", day(30)), ("domain", "example.org", "add", day(5)),
          ("prefix", "b.net/x/y", "add", day(0)), ("prefix", "b.net/x/y", "remove", day(0)),
          ("prefix", "b.net/p", "add", day(1)), ("prefix", "b.net/p", "add", day(1)),
          ("host", None, "add", day(1)), ("host", "c.io", None, day(1)), ("host", "c.io", "add", None),
          ("odd", "c.io", "add", day(1)), ("domain", "org", "add", day(50)), ("domain", "org", "remove", day(60))]
CAPTURES = [(1, "http://a.example.com/", day(9)), (2, "https://u:p@A.Example.com:80/z", day(10)),
            (3, "http://a.example.com", day(20)), (4, "http://a.example.com", day(19)),
            (5, "http://a.example.com", day(400)), (6, "http://x.y.example.org/q", day(55)),
            (7, "http://b.net/x/y/z", day(3)), (8, "http://B.net/p/q?x#y", day(3)), (9, "http://b.net/pp", day(3)),
            (10, None, day(3)), (11, "", day(3)), (12, "not a url", day(3)), (13, "http://c.io/", day(3)),
            (14, "http://a.example.com", None), (15, "http://b.net./p" + "/s" * 5000, day(3)),
            (None, "http://b.net/p", day(3)), (8, "http://B.net/p/q?x#y", day(3))]


def brute(url, at):
    import re
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)([^?#]*)", url or "")
    if not m or not m[1].strip(".") or at is None:
        return ""
    host = m[1].lower().rstrip(".")
    path = [s for s in re.sub(r"^[^/]*", "", m[2]).lower().split("/") if s]
    found = set()
    good = [e for e in EVENTS if None not in e and e[0] in url_lists.KINDS]
    for kind, value in {(k, v.lower()) for k, v, _, _ in good}:
        past = sorted((t, a) for k, v, a, t in good if (k, v.lower()) == (kind, value) and t <= at)
        if not past or past[-1][1] != "add":
            continue
        if kind == "host" and host == value or kind == "domain" and ("." + host).endswith("." + value) \
                or kind == "prefix" and ([host] + path)[:value.count("/") + 1] == value.split("/"):
            found.add(f"{kind}:{value}")
    return ",".join(sorted(found))


def test_entries_as_of_fetch_time(spark):
    ev = spark.createDataFrame(EVENTS, "kind string, value string, action string, at timestamp")
    caps = spark.createDataFrame([(*c, "k", 1) for c in CAPTURES],
                                 "page_id long, url string, fetched_at timestamp, key string, URL int")
    out = url_lists.evaluate(caps, ev).collect()
    want = sorted([(i, brute(u, t)) for i, u, t in CAPTURES], key=repr)
    assert sorted([(r.page_id, r.entries) for r in out], key=repr) == want
    assert all(r.blocked == bool(r.entries) and r.n_active == len([x for x in r.entries.split(",") if x]) for r in out)
    assert dict((r.page_id, r.entries) for r in out)[6] == "domain:example.org,domain:org"


def test_empty_tables(spark):
    ev = spark.createDataFrame([], "kind string, value string, action string, at timestamp")
    caps = spark.createDataFrame(CAPTURES[:2], "page_id long, url string, fetched_at timestamp")
    assert not url_lists.evaluate(caps, ev).where("blocked").count()
    assert url_lists.evaluate(caps.limit(0), ev).count() == 0


def test_plan_has_no_python(spark):
    ev = spark.createDataFrame(EVENTS, "kind string, value string, action string, at timestamp")
    caps = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_at timestamp")
    plan = url_lists.evaluate(caps, ev)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_ipv6_hosts(spark):
    events = [("host", "[::1]", "add", day(0)), ("prefix", "[2001:DB8::2]/a/b", "add", day(0)), ("domain", "1]", "add", day(0)),
              ("host", "[", "add", day(0)), ("domain", "[::ffff:1.2.3.4]", "add", day(0))]
    urls = ["https://[::1]/", "http://u@[::1]:8080/x", "http://[::2]/", "http://[2001:db8::2]:80/A/b/c", "http://[2001:db8::2]/a",
            "http://[::ffff:1.2.3.4]/", "http://[broken/a"]
    ev = spark.createDataFrame(events, "kind string, value string, action string, at timestamp")
    caps = spark.createDataFrame([(i, u, day(1)) for i, u in enumerate(urls)], "page_id long, url string, fetched_at timestamp")
    got = {r.page_id: (r.host, r.entries) for r in url_lists.evaluate(caps, ev).collect()}
    assert got == {0: ("[::1]", "host:[::1]"), 1: ("[::1]", "host:[::1]"), 2: ("[::2]", ""),
                   3: ("[2001:db8::2]", "prefix:[2001:db8::2]/a/b"), 4: ("[2001:db8::2]", ""),
                   5: ("[::ffff:1.2.3.4]", "domain:[::ffff:1.2.3.4]"), 6: ("[broken", "")}
