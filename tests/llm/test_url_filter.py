from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
import pandas as pd

from viewtrail.llm import url_filter as uf


def brute(rows: list[tuple]) -> dict[int, tuple]:
    """Hosts and rules by Python's strings, ranks by plain loops."""
    own, links, pages, seen = {}, set(), defaultdict(int), defaultdict(lambda: {"allow": 0, "block": 0})
    for page, url, html in rows:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), v == "block", h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, False, None, None))
        own[page] = host, path, *best[2:]
        pages[host] += 1
        if best[3]:
            seen[host][best[3]] += 1
        for m in re.finditer(uf.LINK, html or ""):
            links.add((host, "".join(c.lower() if c.isascii() else c for c in m[1])))
    links = {(a, b) for a, b in links if a and a != b}

    def spread(verdict, edges):
        ways = defaultdict(list)
        for a, b in edges:
            ways[a].append(b)
        now = {h: uf.SEED * n[verdict] // pages[h] for h, n in seen.items()}
        total = defaultdict(int, now)
        for _ in range(uf.ROUNDS):
            sent = defaultdict(int)
            for h, x in now.items():
                for b in ways[h]:
                    sent[b] += x * uf.DAMPING // (100 * len(ways[h]))
            for h, x in sent.items():
                total[h] += x
            now = sent
        return total

    trust, distrust = spread("allow", links), spread("block", {(b, a) for a, b in links})
    return {p: (h, path, rule, v or ("block" if distrust[h] - trust[h] >= uf.EXCESS else "allow")) for p, (h, path, rule, v) in own.items()}


def web(seed: int, n: int = 300) -> list[tuple]:
    rng = random.Random(seed)
    hosts = [f"{a}.{b}" for a in ("a", "b", "c", "hub", "deep.er") for b in ("example.com", "example.net", "example.org", "site.io", "net")] + ["org", "net", "EXAMPLE.com", "x.Io"]
    rows = []
    for page in range(n):
        url = f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['/en/1', '/de/2', '/fr/3?x=/de/', '/', '', '?q', '#f', '/de', '/en/a#b?c'])}"
        html = " ".join(f'<a class=x href="{rng.choice(["https:", "http:", "HTTP:", ""])}//{rng.choice(hosts)}/{rng.randrange(9)}">' for _ in range(rng.randrange(4))) + "<a href='/here'><a href=mailto:x>"
        rows.append((page, url, html))
    return rows


def test_verdicts_against_loops_and_sql(spark):
    for seed in (1, 2):
        rows = web(seed) + [(1000, None, None), (1001, "", ""), (1002, "no host/de/", "<a href=//a.net>"), (1003, "x://y://z/en/", None), (1004, "://", "")]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.judge(pages).collect()}
        want = brute(rows)
        assert got == want
        assert {v[3] for v in want.values() if v[2] is None} == {"allow", "block"}, "the method has nothing to say here"
        con = duckdb.connect()
        con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
        assert {r[0]: r[1:] for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({uf.ORACLE})").fetchall()} == want


def test_distrust_runs_against_links(spark):
    """A host that links to blocked ones is distrusted, one that they link to isn't."""
    rows = [(1, "http://bad.net/", '<a href="//victim.io">'), (2, "http://liar.io/", '<a href="//bad.net/">'), (3, "http://victim.io/", ""), (4, "http://friend.io/", ""), (5, "http://good.org/fr/", '<a href="//friend.io">')]
    got = {r["page_id"]: r for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i]["verdict"] for i in range(1, 6)] == ["block", "block", "allow", "allow", "allow"]
    assert got[2]["distrust"] == 850_000 and got[4]["trust"] == 850_000 and got[3]["distrust"] == 0


def test_ties_repeats_empty_and_clashes(spark):
    rules = [("allow", "a.io", "/x"), ("block", "a.io", "/x"), ("allow", "io", "/")]
    rows = [(7, "q://s.a.io/x", None, 1, "v"), (7, "q://s.a.io/x", None, 1, "v"), (None, "q://s.a.io/y", None, 1, "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int, verdict string")
    got = sorted((r["page_id"] or 0, r["rule"], r["verdict"]) for r in uf.judge(pages, rules).collect())
    assert got == [(0, "io/", "allow"), (7, "a.io/x", "block"), (7, "a.io/x", "block")]
    assert uf.judge(pages.filter("false"), rules).collect() == []


def test_long_html_is_read_whole(spark):
    far = "x " * 400_000 + '<a href="//bad.net/">'
    rows = [(1, "http://bad.net/", None), (2, "http://liar.io/", far)]
    got = {r["page_id"]: r["verdict"] for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block"}
