"""Rules against plain Python, scores against dense power iteration."""

import random
import re
from collections import Counter, defaultdict

import pytest

from turnsift.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, host string, path string, rule string, trust string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "p", "r", "t") for r in rows], SCHEMA)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path, rules=U.RULES):
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def pagerank(seeds, edges, rounds=U.ROUNDS, d=U.DAMPING):
    total = sum(seeds.values())
    seeds = {h: w / total for h, w in seeds.items()}
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    score = dict(seeds)
    for _ in range(rounds):
        new = defaultdict(float, {h: (1 - d) * s for h, s in seeds.items()})
        for (a, b), w in edges.items():
            new[b] += d * score.get(a, 0) * w / out[a]
        score = new
    total = sum(score.values())
    return {h: s / total for h, s in score.items()}


def model(rows):
    pages = [(i, *parts(u)) for i, u, _ in rows]
    counts = Counter(h for _, h, _ in pages if h)
    edges = Counter()
    for _, url, html in rows:
        own = parts(url)[0]
        for link in re.findall(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*([^"'\s>]+)""", html or ""):
            to = parts("http:" + link if link.startswith("//") else link)[0]
            if own and to and own != to:
                edges[own, to] += 1
    for host, n in counts.items():
        labels = host.split(".")
        if len(labels) > U.SITE_LABELS:
            site = ".".join(labels[-U.SITE_LABELS :])
            edges[host, site] += n
            edges[site, host] += n
    seeds = {"allow": {}, "block": {}}
    for verdict, into in seeds.items():
        ruled = Counter(h for _, h, p in pages if h and rule_of(h, p)[1] == verdict)
        into.update({h: n for h, n in ruled.items() if 2 * n > counts[h]})
    trust = pagerank(seeds["allow"], edges) if seeds["allow"] else {}
    back = Counter({(b, a): w for (a, b), w in edges.items()})
    distrust = pagerank(seeds["block"], back) if seeds["block"] else {}
    out = []
    for i, host, path in pages:
        rule, verdict = rule_of(host, path)
        t, d = (round(x.get(host, 0.0), 12) if host else 0.0 for x in (trust, distrust))
        out.append((i, host, path, rule, verdict or ("block" if d > U.MOST_DISTRUST * (t + d) else "allow"), t, d))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    hosts = ["example.com", "WWW.example.com", "a.example.com", "x.net", "m.y.x.net", "b.y.x.net", "good.org", "bad.org", "sub.deep.bad.org", "w.info"]
    out = []
    for i in range(400):
        host = rng.choice(hosts[:2] + hosts if i % 3 else ["x.net"])
        path = rng.choice(["", "/", "/en/1", "/es/2", "/fr/", "/de/x?y=/es/", "#/en/"])
        to = [rng.choice(["http://", "//", "HTTPS://"]) + rng.choice(hosts) + "/p" for _ in range(rng.randrange(4))]
        html = " ".join(f'<a HREF = "{t}">' if rng.random() < 0.7 else f"<img src='{t}'>" for t in to) + '<a href="/local"><a href="mailto:x@y">'
        out.append((i, f"http://{host}{path}", html))
    out += [(600 + i, "http://evil.net" + ["/es/", "/fr/x", "/de/"][i % 3], "<a href='http://w.info/'>") for i in range(9)]
    out += [(700, "http://links.org/", "<a href='http://evil.net/'>")]
    return out + [(900, None, "<a href='http://x.net'>"), (901, "no scheme", None), (902, "http://", None), (903, "http://Ä.NET/es/", ""),
                  (904, "http://a.net/fr/://b.com/", None), (None, "http://x.net/es/", None), (5, "http://x.net/en/1", ""), (905, "x://com", None), (906, "x://y.com/\nz", None)]


def test_pages(spark, rows):
    got = U.judge(frame(spark, rows).repartition(5)).collect()
    want = model(rows)
    key = lambda r: repr(r[:5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-9)
    assert {"allow", "block"} == {g.verdict for g in got if g.rule is None}


def test_rules_table(spark):
    rules = [("block", "a.b", "/x"), ("allow", "b", "/x/y"), ("block", "c", "")]
    pages = [(i, u, None) for i, u in enumerate(["q://a.b/x/y", "q://a.b/x/z", "q://z.b/x/y", "q://c", "q://ab/x/y", "q://q.c/"])]
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(frame(spark, pages), table).collect()}
    assert got == {i: (rule_of(*parts(u), rules)[0], rule_of(*parts(u), rules)[1] or "allow") for i, u, _ in pages}
    assert got[0][0] == "a.b/x" or got[0][0] == "b/x/y"


def test_no_links_and_empty(spark):
    pages = frame(spark, [(1, "http://q.org/", None), (2, "http://z.net/es/", "")])
    assert {r.page_id: r.verdict for r in U.judge(pages).collect()} == {1: "allow", 2: "block"}
    assert U.judge(pages.limit(0)).count() == 0


def test_every_ruled_host_seeds_its_domains(spark, tmp_path):
    urls = ["http://a.s.net/es/1", "http://a.s.net/en/2", "http://a.s.net/en/3", "http://b.s.net/en/4", "http://c.t.net/en/5",
            "http://d.s.org/en/6", "http://e.s.com/en/7", "http://.net./en/8"]
    frame(spark, [(i, u, None) for i, u in enumerate(urls)]).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in U.op2_url_filter(spark, str(tmp_path)).collect()}
    assert [got[i].verdict for i in range(8)] == ["block"] * 5 + ["allow"] * 3
    edges = {("a.s.net", "s.net"): 3, ("b.s.net", "s.net"): 1, ("s.net", "net"): 4, ("c.t.net", "t.net"): 1, ("t.net", "net"): 1,
             ("d.s.org", "s.org"): 1, ("s.org", "org"): 1, ("e.s.com", "s.com"): 1, ("s.com", "com"): 1, (".net.", "net."): 1}
    both = edges | {(b, a): w for (a, b), w in edges.items()}
    for kind, seeds in (("distrust", {"a.s.net": 1}), ("trust", {"e.s.com": 1})):
        want = pagerank(seeds, both)
        assert [got[i][kind] for i in range(8)] == pytest.approx([want.get(got[i].host, 0.0) for i in range(8)], abs=1e-9)
