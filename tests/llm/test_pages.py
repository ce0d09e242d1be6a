import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import revisits
from runlens.llm import url_trust as u
from runlens.llm.main_text import extract, main_text

PAGES = "page_id long, url string, html string, host string, verdict string, score string"


def pages(spark, rows):
    return spark.createDataFrame([(i, url, html, "h", "v", "s") for i, url, html in rows], PAGES)


URLS = [(1, "http://A.Example.org/es/x?q#f", "example.org/es/", "block"), (2, "https://example.org/en/15", "example.org/en/1", "block"),
        (3, "http://example.org/fr/", "org/", "allow"), (4, "x://other.org", None, "allow"), (5, "ftp://m.site.com/de/", "com/de/", "block"),
        (6, "http://com/fr/1", "com/fr/", "allow"), (7, "http://notexample.org/es/", "org/", "allow"), (8, None, None, "allow"),
        (9, "no scheme/fr/", None, "allow"), (10, "", None, "allow"), (11, "http://?x", None, "allow"),
        (11, "http://?x", None, "allow"), (None, "http://a.b.org/\n/x", "org/", "allow")]


def test_rules(spark):
    got = u.judge_urls(pages(spark, [(i, url, None) for i, url, *_ in URLS])).collect()
    want = [(i, rule, verdict) for i, _, rule, verdict in URLS]
    assert sorted(map(str, [(r.page_id, r.rule, r.verdict) for r in got])) == sorted(map(str, want))
    parts = {r.page_id: (r.host, r.path) for r in got}
    assert parts[1] == ("a.example.org", "/es/x") and parts[4] == ("other.org", "") and parts[8] == parts[9] == ("", "")
    assert parts[None] == ("a.b.org", "/\n/x") and parts[11] == ("", "")


def solved(edges, seeds, damping=0.85):
    """Personalised PageRank by a linear solve: what arrives at hosts without links goes back to the seeds."""
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    seed = np.array([seeds.get(h, 0.0) for h in hosts])
    step = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in edges.items():
        step[at[b], at[a]] += n
    total = step.sum(0)
    step = np.where(total > 0, step / np.where(total > 0, total, 1), seed[:, None])
    found = np.linalg.solve(np.eye(len(hosts)) - damping * step, (1 - damping) * seed)
    return dict(zip(hosts, found))


def ranked(spark, monkeypatch, edges, seeds):
    """(scores of the operator, rounds it took)."""
    rounds, real = [], u.settle
    monkeypatch.setattr(u, "settle", lambda df, label: rounds.append(label) or real(df, label))
    table = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, weight long")
    start = spark.createDataFrame(list(seeds.items()), "host string, mass double")
    got = {r.host: r.score for r in u.propagate(spark, table, start).collect()}
    return got, u.ROUNDS * (rounds.count("scores") - 1)


def farm():
    """A seed with 1,000 links to hosts without links and one to a pair that link each other."""
    edges = {("seed", f"end{i}"): 1 for i in range(1000)} | {("seed", "a"): 1, ("a", "b"): 1, ("b", "a"): 1}
    return edges, {"seed": 1.0}


def random_graph(seed):
    draw = random.Random(seed)
    edges = {(f"h{draw.randrange(40)}", f"h{draw.randrange(60)}"): draw.randint(1, 4) for _ in range(120)}
    return {e: n for e, n in edges.items() if e[0] != e[1]}, {"h1": 0.5, "h2": 0.25, "alone": 0.25}


@pytest.mark.parametrize("graph", [farm(), random_graph(1), ({(f"h{i}", f"h{i + 1}"): 1 for i in range(30)}, {"h0": 1.0})])
def test_scores_solve_the_equations(spark, monkeypatch, graph):
    got, rounds = ranked(spark, monkeypatch, *graph)
    want = solved(*graph)
    assert rounds <= 120 and sum(got.values()) == pytest.approx(1)
    assert all(got.get(h, 0.0) == pytest.approx(v, abs=1e-7) for h, v in want.items())
    assert {h for h, v in want.items() if v > 1e-12} <= set(got)
    if "end0" in got:
        assert got["a"] + got["b"] < 0.01


def test_trust_and_distrust_spread_over_links(spark):
    link = '<a href="http://{}/x">a</a><A HREF=//{}/y>'.format
    rows = [(1, "http://good.org/", link("near.net", "far.net")), (2, "http://near.net/", link("far.net", "far.net")),
            (3, "http://spam.net/", link("bad.com", "bad.com")), (4, "http://bad.com/de/1", link("spam.net", "Near.NET")),
            (5, "http://far.net/", link("good.org", "far.net")), (6, "http://lone.net/", None)]
    edges = {("good.org", "near.net"): 1, ("good.org", "far.net"): 1, ("near.net", "far.net"): 1, ("spam.net", "bad.com"): 1,
             ("bad.com", "spam.net"): 1, ("bad.com", "near.net"): 1, ("far.net", "good.org"): 1}
    table = pages(spark, rows)
    assert {(r.src, r.dst): r.weight for r in u.host_edges(table).collect()} == edges
    got = {r.host: r for r in u.judge_urls(table).collect()}
    trust = solved(edges, {"good.org": 1.0})
    distrust = solved({(b, a): n for (a, b), n in edges.items()}, {"bad.com": 1.0})
    for host, r in got.items():
        assert r.trust == pytest.approx(trust.get(host, 0.0), abs=1e-6)
        assert r.distrust == pytest.approx(distrust.get(host, 0.0), abs=1e-6)
    assert {h: r.verdict for h, r in got.items()} == {"good.org": "allow", "near.net": "allow", "far.net": "allow",
                                                      "spam.net": "block", "bad.com": "block", "lone.net": "allow"}


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    """60 hosts in a row link to the one before, the first of them to a blocked page."""
    hosts = ["bad.com", *[f"h{i}.net" for i in range(60)]]
    rows = [(0, "http://bad.com/de/1", None)] + [
        (i, f"http://{host}/", f"<a href=http://{hosts[i - 1]}/de/1>x</a>") for i, host in enumerate(hosts) if i]
    got = {r.host: r for r in u.judge_urls(pages(spark, rows)).collect()}
    want = solved({(a, b): 1 for a, b in zip(hosts, hosts[1:])}, {"bad.com": 1.0})
    for host in hosts:
        assert got[host].verdict == "block" and got[host].distrust == pytest.approx(want[host], abs=1e-7)


def test_no_pages(spark):
    empty = spark.createDataFrame([], PAGES)
    assert u.judge_urls(empty).count() == extract(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav><!-- <p>gone</p> -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy &amp; save a lot of money with this offer today.</div>
<article><header><h1>The  title &amp; more</h1></header><p>A first&nbsp;paragraph, <b>bold <i>text</b> that is long enough to count.<br>
Second line.<p>Short.</p><form><p>Your mail</p></form><aside>Beside</aside><p>x &lt;y&gt; &copy; &#233;</p>
<div id="comments"><p>A reader says something that is rather long, but is not part of the text at all.</p></div></article>
<div class="sidebarLeft"><p>Also here</p></div><footer>&copy; me</footer></body></html>"""
TEXT = "The title & more\nA first paragraph, bold text that is long enough to count. Second line.\nShort.\nx <y> © é"


def test_article():
    assert main_text(PAGE) == TEXT


def test_without_article_element():
    body = "".join(f"<p>Paragraph {i} with a good number of characters in it, as a text has.</p>" for i in range(6))
    page = (f"<html><body><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><div class=content><h2>Head</h2>{body}"
            "<p>End.</p></div><p><a href=z>About us</a></p></body>")
    want = ["Head", *[f"Paragraph {i} with a good number of characters in it, as a text has." for i in range(6)], "End."]
    assert main_text(page).split("\n") == want


@pytest.mark.parametrize("page, text", [("", ""), ("<p", ""), ("<nav>only a menu", ""), ("plain  text", "plain text"), (
    "<article><p>cut off", "cut off"), ("<!-- never closed <p>x</p>", ""), ("<script>x", ""), ("a<br/>b<img alt='>'>c", "a bc"),
    ("<article><p>" + "long " * 50000 + "</article>", ("long " * 50000).strip()), ("<p title=\"a'>b</p>" + "z" * 100, "b\n" + "z" * 100)])
def test_odd_markup(page, text):
    assert main_text(page) == text


def test_extract(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, None, "")]
    got = sorted([tuple(r) for r in extract(pages(spark, rows)).collect()], key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, None, "", 0)], key=str)


RECORDS = ("record_id long, type string, url string, date timestamp, status int, headers map<string,string>, "
           "payload_digest string, stored string, kind string")


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def records(spark, rows):
    return spark.createDataFrame([(i, kind, url, None if m is None else at(m), status, headers, digest, "s", "k")
                                  for i, kind, url, m, status, headers, digest in rows], RECORDS)


def test_canonical_url(spark):
    urls = {"HTTP://www.A.org:80/x/?utm_source=1&b=2#f": "a.org/x?b=2", "https://a.org/x/?b=2&utm_a=c": "a.org/x?b=2",
            "https://a.org": "a.org", "http://a.org:8080/?utm_x=1": "a.org:8080", "nothing": None, None: None}
    df = spark.createDataFrame([(x,) for x in urls], "url string").select("url", revisits.canonical_url(F.col("url")).alias("c"))
    assert {r.url: r.c for r in df.collect()} == urls


def test_revisits(spark):
    rows = [(1, "response", "http://a.org/", 10, 200, {"ETag": '"x"', "Server": "s", "Date": "d1"}, "p1"),
            (2, "revisit", "https://www.a.org", 20, 304, {"etag": 'W/"x"', "date": "d2", "server": "edge"}, None),
            (3, "revisit", "http://a.org", 10, 304, {"ETag": '"x"'}, None), (4, "revisit", "http://a.org", 5, 304, None, None),
            (5, "response", "http://a.org/", 30, 200, {"Last-Modified": "m"}, "p5"),
            (6, "revisit", "http://a.org/", 31, 304, {"ETag": '"x"'}, None), (7, "revisit", "http://a.org/", 32, 304, None, None),
            (8, "revisit", "http://a.org/", 33, 304, {"last-modified": "n"}, None),
            (9, "response", "http://a.org/", 34, 404, None, "p9"), (10, "revisit", "http://a.org/", 35, 304, {"last-modified": "m"}, None),
            (11, "revisit", None, 40, 304, None, None), (12, "response", None, 1, 200, None, "p"), (13, "revisit", "http://a.org/", None, 304, None, None),
            (14, "metadata", "http://a.org/", 50, None, None, None), (10, "revisit", "http://a.org/", 35, 304, {"last-modified": "m"}, None)]
    got = revisits.resolve_revisits(records(spark, rows))
    by = {r.record_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert {i: (r.resolution, r.source_id) for i, r in by.items()} == {
        1: ("full", 1), 2: ("resolved", 1), 3: ("orphan", None), 4: ("orphan", None), 5: ("full", 5), 6: ("mismatch", 5),
        7: ("resolved", 5), 8: ("mismatch", 5), 9: ("full", 9), 10: ("resolved", 5), 11: ("orphan", None), 12: ("full", 12),
        13: ("orphan", None), 14: ("other", None)}
    assert (by[2].status, by[2].payload_digest) == (200, "p1")
    assert by[2].headers == {"etag": 'W/"x"', "server": "s", "date": "d2"}
    payloads = spark.createDataFrame([(1, "body")], "record_id long, payload string")
    assert {r.record_id for r in revisits.with_payload(got, payloads).collect() if r.payload} == {1, 2}
    assert revisits.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_hot_url_over_many_parts(spark):
    rows = []
    for i in range(600):
        url = "http://hot.org/" if i % 3 == 0 else f"http://u{i % 40}.org/"
        full = i % 5 == 0
        rows.append((i, "response" if full else "revisit", url, i, 200 if full else 304, {}, f"p{i}" if full else None))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.record_id: r.source_id for r in revisits.resolve_revisits(records(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last, want = {}, {}
    for i, kind, url, *_ in rows:
        if kind == "response":
            last[url] = i
        want[i] = last.get(url)
    assert got == want
