"""Parts and explicit rules by hand, mined rules against counting."""

from collections import Counter
from itertools import combinations

import pytest

from wayledger.llm import urls
from wayledger.llm.catalog import URL_RULES

CASES = [
    ("https://WWW.Example.ORG/en/1?x=/es/", "www.example.org", "/en/1", "example.org/en/1", "block"),
    ("http://example.org/es/a#t", "example.org", "/es/a", "example.org/es/", "block"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://a.com/fr/b", "a.com", "/fr/b", "com/fr/", "allow"), ("http://a.com/de/b", "a.com", "/de/b", "com/de/", "block"),
    ("http://a.com?de/b", "a.com", "", None, "allow"), ("http://example.org", "example.org", "", None, "allow"),
    ("http://example.org/EN/1", "example.org", "/EN/1", "org/", "allow"), (None, "", "", None, "allow"), ("no scheme/org/", "", "", None, "allow"),
    ("", "", "", None, "allow"), ("x://", "", "", None, "allow"), ("a://b.org/c://d", "b.org", "/c://d", "org/", "allow"),
    ("http://ex.net/" + "a" * 50_000, "ex.net", "/" + "a" * 50_000, None, "allow"), ("http://com/fr/", "com", "/fr/", "com/fr/", "allow"),
]


def pages(spark, cases):
    return spark.createDataFrame([(k, u, "x", "y", True) for k, u in enumerate(cases)], "page_id long, url string, host string, rule string, bad boolean")


def test_parts_and_explicit_rules(spark):
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = urls.judge(pages(spark, [c[0] for c in CASES] + [CASES[0][0]]), none, URL_RULES).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in got] == [*CASES, CASES[0]]
    assert urls.judge(pages(spark, []), none, URL_RULES).count() == 0


@pytest.fixture(scope="module")
def labelled():
    out = []
    for k in range(400):
        spam, lang = k % 4 == 0, ("en", "de")[k % 2]
        out.append((f"http://{'cheap.' if spam else ''}shop{k % 3}.net/{lang}/{k}?ref={k}", spam and k % 40 != 0))
    return out


def test_mined_rules_against_counting(spark, labelled):
    frame = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(labelled)], "page_id long, url string, bad boolean")
    table = urls.parts(frame).join(frame.select("page_id", "bad"), "page_id")
    mined = urls.mine(table, min_support=0.05).collect()
    tokens = {r.page_id: set(r.t) for r in urls.parts(frame).select(
        "page_id", urls.tokens_of(*(urls.F.col(c) for c in ("url", "host", "path"))).alias("t")).collect()}
    both, alone = Counter(), Counter()
    for k, (_, bad) in enumerate(labelled):
        for n in range(1, len(tokens[k]) + 1):
            for combo in combinations(sorted(tokens[k]), n):
                alone[combo] += 1
                both[combo, bad] += 1
    share = {b: sum(x == b for _, x in labelled) / len(labelled) for b in (True, False)}
    found = {(c, b): n / alone[c] for (c, b), n in both.items() if n >= 0.05 * len(labelled) and n / alone[c] >= urls.MIN_CONFIDENCE}
    good = {(c, b): p for (c, b), p in found.items() if p / share[b] > 1 + 1e-12}
    want = {(c, b) for (c, b), p in good.items() if not any(
        len(d) < len(c) and e == b and q >= p - 1e-12 and set(d) <= set(c) for (d, e), q in good.items())}
    assert {(tuple(r.tokens), r.verdict == urls.BLOCK) for r in mined} == want
    assert all(r.key in r.tokens for r in mined)


def test_unlabelled_pages_are_judged_by_mined_rules(spark, labelled):
    fresh = [(1000, "http://cheap.shop1.net/en/77", None), (1001, "http://shop1.net/en/77", None)]
    rows = [(k, u, b) for k, (u, b) in enumerate(labelled)]
    data = spark.createDataFrame([(k, u) for k, u, _ in rows + fresh], "page_id long, url string")
    marks = spark.createDataFrame([(k, b) for k, _, b in rows] + [(None, True), (5, None)], "page_id long, bad boolean")
    got = {r.page_id: r.verdict for r in urls.judge(data, marks).collect()}
    assert len(got) == 402 and got[1000] == "block" and got[1001] == "allow"


def test_one_long_url_many_times_and_support_at_any_size(spark):
    slug = "-".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    long = [(f"http://host.net/{slug}", True)] * 1000
    few = [(f"http://bad.net/q{chr(97 + k)}", True) for k in range(20)] + [(f"http://less.net/r{chr(97 + k)}", True) for k in range(19)]

    def verdicts(many):
        good = [(f"http://good{k % 7}.net/{chr(97 + k % 26)}/{k}", False) for k in range(many)]
        rows = [(k, u, b) for k, (u, b) in enumerate(long + few + good)]
        asked = [f"http://host.net/{slug}", "http://else.org/waa", "http://bad.net/new", "http://less.net/new", "http://good3.net/a/5", None]
        data = spark.createDataFrame([(k, u) for k, u, _ in rows] + [(-1 - k, u) for k, u in enumerate(asked)], "page_id long, url string")
        marks = spark.createDataFrame([(k, b) for k, _, b in rows], "page_id long, bad boolean")
        got = {r.page_id: r.verdict for r in urls.judge(data, marks).where("page_id < 0").collect()}
        return [got[-1 - k] for k in range(len(asked))]

    # Any word of the slug stands for all of it; nineteen urls that agree are too few, twenty are not.
    want = ["block", "block", "block", "allow", "allow", "allow"]
    assert verdicts(2_000) == want and verdicts(20_000) == want
