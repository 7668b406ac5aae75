import random

import pytest

from quillon.llm import urls

PAGES = "page_id long, url string, html string, host string, rule string, row int, key string"
LINK = '<html><head><LINK href="%s" rel="canonical"></head>'
SENT = "<meta http-equiv=refresh content='0; URL=%s'>"


def host_path(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:end]


def name(u):
    """Key of a plain url without query."""
    h, p = host_path(u)
    for x in ("www.", "m."):
        if h.startswith(x):
            h = h[len(x) :]
            break
    return h + p.rstrip("/")


def brute(pages, rules, links):
    out = {}
    for i, u in pages:
        h, p = host_path(u)
        fit = [(len(a + b), len(a), ok, a + b) for a, b, ok in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fit, default=None)
        out[i] = [h, p, best and best[3], best and best[2]]
    bad = {name(u) for i, u in pages if out[i][3] is False}
    more = True
    while more:
        more = {y for a, b in links for x, y in ((name(a), name(b)), (name(b), name(a))) if x in bad and y not in bad}
        bad |= more
    return {i: (*out[i][:3], ("allow" if out[i][3] else "block") if out[i][2] else ("block" if name(u) in bad and u and "://" in u else "allow")) for i, u in pages}


def run(spark, pages, rules=urls.RULES, redirects=None):
    df = spark.createDataFrame([(*p, "x", "y", 7, "z") for p in pages], PAGES)
    got = urls.judge(df, spark.createDataFrame(rules, "host string, path string, allow boolean"), redirects).collect()
    return sorted(((r.page_id, (r.host, r.path, r.rule, r.verdict)) for r in got), key=lambda x: (x[0] is None, x))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_brute_force(spark, seed):
    r = random.Random(seed)
    hosts = ["a.org", "Example.org", "x.example.org", "b.com", "www.b.com", "m.c.net", "c.net", "d.net", "org", "xorg", "e.net"]
    some = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(['', '/', '/es/1', '/en/1', '/en/12', '/fr/2', '/de/3', '/p', '/q/'])}" for _ in range(120)]
    pages, links = [], []
    for i, u in enumerate(some):
        html = None
        if r.random() < 0.5:
            v = r.choice(some)
            html = r.choice([LINK, SENT]) % v + "x" * r.randrange(50)
            links.append((u, v))
        pages.append((i, u, html))
    moved = [(r.choice(some), r.choice(some)) for _ in range(10)]
    got = run(spark, pages, redirects=spark.createDataFrame([*moved, (None, some[0])], "source string, target string"))
    assert dict(got) == brute([(i, u) for i, u, _ in pages], urls.RULES, links + moved)


def test_aliases_carry_blocks_over_chains_but_not_over_an_explicit_allow(spark):
    chain = [(i, f"http://s{i}.net/a", LINK % f"https://www.s{i + 1}.net/a/?utm_source=x#top") for i in range(20)]
    pages = [*chain, (20, "http://s20.net/a", SENT % "//bad.com/de/1"), (21, "https://bad.com/de/1", None), (22, "http://good.com/fr/1", LINK % "http://s3.net/a"), (23, "http://s3.net/b", ""), (24, "http://S5.net/a?ref=y", LINK % "../b")]
    got = dict(run(spark, pages))
    assert all(got[i][3] == "block" for i in (*range(22), 24)) and got[22][2:] == ("com/fr/", "allow") and got[23][3] == "allow"


def test_hub_of_many_aliases(spark):
    pages = [(i, f"http://h{i}.net/", LINK % "http://hub.com/de/x") for i in range(3000)] + [(-1, "http://hub.com/de/x", None)]
    assert {v[3] for _, v in run(spark, pages)} == {"block"}


def test_nulls_repeats_long_and_empty(spark):
    long = "http://a.net/" + "p" * 100_000
    pages = [(1, None, None), (1, None, None), (None, "nothing", "<link rel=canonical href=http://b.com/de/>"), (2, long, "y" * 3_000_000 + LINK % "http://b.com/de/x"), (3, "http://b.com/de/x", ""), (4, "x://", None), (5, "http://A.ORG?q=/://#", None)]
    got = run(spark, pages)
    assert [x for x in got if x[0] == 1] == [(1, ("", "", None, "allow"))] * 2
    rest = dict(got)
    assert rest[None][3] == "allow" and rest[2][3] == "block" and rest[4] == ("", "", None, "allow") and rest[5] == ("a.org", "", None, "allow")
    assert run(spark, []) == []
    assert run(spark, pages[-1:], rules=[]) == [(5, ("a.org", "", None, "allow"))]
    assert run(spark, [(1, "http://a.b.c/d/e", None)], rules=[("b.c", "/d/", False), ("a.b.c", "/d", True), (None, "/", False), ("c", "/d/e/", False)])[0][1][2:] == ("a.b.c/d", "allow")
    assert run(spark, [(1, "http://a.b/xy", None)], rules=[("a.b", "/x", False), ("b", "/xy", True), ("a.b", "/xy", False), ("a.b", "/xy", True)])[0][1][2:] == ("a.b/xy", "allow")
