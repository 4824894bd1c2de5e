import datetime as dt
import random

from paperlake.llm import url_filter as uf

DAY = dt.date(2024, 1, 1)


def on(n):
    return DAY + dt.timedelta(days=n)


def plain_intervals(entries):
    found = {}
    for key in {(x or "", r.lower()) for x, r, a, t in entries if r is not None and t is not None and a in ("add", "remove")}:
        events = sorted({(t, a == "remove") for x, r, a, t in entries if (x or "", (r or "").lower()) == key and t is not None and a in ("add", "remove")})
        state, start, spans = False, None, []
        last = {}
        for t, off in events:
            last[t] = not off
        for t in sorted(last):
            if last[t] and not state:
                start = t
            if not last[t] and state:
                spans.append((start, t))
            state = last[t]
        if state:
            spans.append((start, None))
        found[key] = spans
    return found


def rules_of(url):
    rest = url.split("://", 1)[-1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:cut].split("@")[-1].split(":")[0].rstrip(".").lower()
    path = rest[cut:].split("?")[0].split("#")[0]
    labels, parts = host.split("."), [p for p in path.split("/") if p]
    return host, {".".join(labels[i:]) for i in range(len(labels))} | {
        (host + "/" + "/".join(parts[: i + 1])).lower() for i in range(len(parts))
    }


def test_matches_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.example.com", "b.example.com", "Example.COM", "x.y.z.org", "hot.net", "hot.net.", "u:p@hot.net:80"]
    urls = [
        f"{rng.choice(['http://', 'https://', ''])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/A/b?x=1', '/a/b/c#t', '?q=/a'])}" for _ in range(300)
    ]
    pages = [(i, u, on(rng.randint(0, 50))) for i, u in enumerate(urls)] + [
        (900, None, on(1)), (901, "", on(1)), (902, "http://hot.net/a", None), (3, urls[3], on(3)), (3, urls[3], on(3))
    ]
    rules = ["example.com", "a.example.com", "org", "z.org", "hot.net/a", "HOT.net", "x.y.z.org/A/b", "ample.com"]
    entries = [
        (
            rng.choice(["ads", "spam", None]),
            rng.choice(rules),
            rng.choice(["add", "add", "remove", "note"]),
            on(rng.randint(0, 50)),
        ) for _ in range(60)
    ]
    entries += [(None, None, "add", on(0)), ("ads", "org", None, on(0)), ("ads", "org", "add", None)]
    captures = spark.createDataFrame(pages, "page_id long, url string, fetched_at date")
    listed = spark.createDataFrame(entries, "list string, rule string, action string, at date")
    spans = plain_intervals(entries)
    got = sorted(
        ((r.page_id, r.fetched_at, r.n_active, r.blocked, r.first_rule, r.since) for r in uf.filter_captures(captures, listed).collect()),
        key=str,
    )
    want = []
    for i, u, t in pages:
        hits = []
        if u and t:
            hits = [(rule, a) for (x, rule), s in spans.items() if rule in rules_of(u)[1] for a, b in s if a <= t and (b is None or t < b)]
        want.append((i, t, len(hits), bool(hits), *(min(hits) if hits else (None, None))))
    assert got == sorted(want, key=str)
    assert any(r[3] for r in got) and not all(r[3] for r in got)


def test_empty_and_clashing(spark):
    listed = spark.createDataFrame([("l", "a.b", "add", DAY)], "list string, rule string, action string, at date")
    captures = spark.createDataFrame([(1, "http://a.b/", DAY, "x")], "page_id long, url string, fetched_at date, rule string")
    assert uf.filter_captures(captures.limit(0), listed).count() == 0
    assert uf.filter_captures(captures, listed.limit(0)).first().blocked is False
    assert uf.filter_captures(captures, listed).first().first_rule == "a.b"


def test_query_is_native(spark, capsys):
    df = uf.query(spark, "/root/testdata/sf0.001")
    assert df.where("blocked").count() > 0 and df.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    df.explain()
    assert "Python" not in capsys.readouterr().out


def test_a_url_of_a_megabyte(spark):
    """Hundreds of thousands of path parts and labels: only the sizes that the list has are written out."""
    host = "a." * 100_000 + "example.com"
    pages = [(1, "http://x.org/" + "p/" * 500_000, on(5)), (2, f"http://{host}/q/r", on(5)), (3, "http://x.org/" + "p" * 1_000_000, on(5))]
    entries = [(None, "x.org/p/p/p", "add", on(1)), (None, "example.com", "add", on(2)), (None, "/".join(["x.org", *"p" * 1000]), "add", on(3))]
    got = uf.filter_captures(
        spark.createDataFrame(pages, "page_id long, url string, fetched_at date"),
        spark.createDataFrame(entries, "list string, rule string, action string, at date"),
    ).collect()
    assert {r.page_id: (r.n_active, r.first_rule) for r in got} == {1: (2, "x.org/p/p/p"), 2: (1, "example.com"), 3: (0, None)}
