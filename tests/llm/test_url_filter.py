from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pytest

from ledgerbeam.llm import url_filter as uf
from ledgerbeam.llm.params import URL_RULES
from ledgerbeam.llm.queries import op2_url_filter
from tests.llm.helpers import TESTDATA, ordered, same_as_duckdb, table


def split(url):
    if not url or "://" not in url:
        return "", ""
    address = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, path = address.partition("/")
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lowered, slash + path


def brute(urls):
    """(host, path, rule, verdict, score) by url, with dictionaries and loops."""
    ruled = {}
    for url in urls:
        host, path = split(url)
        fits = [
            r for r in URL_RULES
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
        ]
        ruled[url] = max(fits, key=lambda r: len(r.name), default=None)

    def text(url):
        rest = (url or "").split("://", 1)[-1] if "://" in (url or "") else (url or "")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest)

    labelled = {}
    for url in urls:
        r = ruled[url]
        labelled.setdefault((text(url), None if r is None else r.verdict), True)
    seen = {"allow": Counter(), "block": Counter()}
    held = []
    for (t, verdict) in labelled:
        if not t or verdict is None:
            continue
        if hashlib.md5(t.encode()).hexdigest()[0] in uf.HELD_BACK:
            held.append((t, verdict))
            continue
        padded = uf.START * 5 + t
        for i in range(5, len(padded)):
            for k in range(6):
                seen[verdict][padded[i - k : i], padded[i]] += 1
                seen[verdict][padded[i - k : i], None] += 1

    characters = len({c for t, _ in labelled for c in t}) + 1

    def chance(side, context, char):
        p = 1 / characters
        for k in range(len(context) + 1):
            ctx = context[len(context) - k :]
            p = (seen[side][ctx, char] + 4 * p) / (seen[side][ctx, None] + 4)
        return p

    def score(t):
        padded = uf.START * 5 + t
        each = [
            math.log(chance("allow", padded[i - 5 : i], padded[i]))
            - math.log(chance("block", padded[i - 5 : i], padded[i]))
            for i in range(5, len(padded))
        ]
        return round(sum(each) / len(each), 6)

    steps = [(max(-2000, min(2000, math.floor(score(t) * 100))), v) for t, v in held]
    good = [s for s, v in steps if v == "allow"]
    bad = [s for s, v in steps if v == "block"]
    threshold = 0.0
    if good and bad:
        threshold = min(
            (round(sum(g < s for g in good) / len(good) + sum(b >= s for b in bad) / len(bad), 9), abs(s), s)
            for s, _ in steps
        )[2] / 100
    out = {}
    for url in urls:
        r, t = ruled[url], text(url)
        points = None if r is not None or not t else score(t)
        by_model = "allow" if (points or 0.0) >= threshold else "block"
        out[url] = (*split(url), r and r.name, r.verdict if r else by_model, points)
    return out


ODD = [
    None, "", "no scheme", "http://", "://", "http://COM/", "http://com", "https://a.com/x?y://z",
    "http://www.EXAMPLE.com/en/1", "http://example.com/en/1", "http://sub.www.example.com/en/",
    "http://xexample.com/en/1", "http://a.net/es/1", "http://a.net/es", "http://net/fr/", "http://a.net?/fr/",
    "http://a.net#/fr/", "http://user@a.net:80/de/ü?x#y", "http://münchen.org/Ä", "http://x.org/" + "a" * 5000,
]


def judged(spark, urls, *limit):
    pages = spark.createDataFrame(
        [(i, u, "clash", "clash") for i, u in enumerate(urls)],
        "page_id long, url string, text string, gram string",
    )
    return uf.judge_urls(pages.repartition(3), URL_RULES, *limit)


@pytest.mark.parametrize("limit", [(), (0,)], ids=["copied", "shuffled"])
def test_odd_urls_equal_brute_force(spark, limit):
    urls = ODD + [f"http://h{i % 7}.example.{t}/{l}/{i}" for i in range(60) for t in ("com", "net", "org") for l in ("en", "es")] + ODD
    want = brute(urls)
    got = judged(spark, urls, *limit)
    expected = sorted(
        ((i, *want[u]) for i, u in enumerate(urls)),
        key=lambda r: tuple((v is not None, str(type(v)), v) for v in r),
    )
    assert ordered(got, "page_id", "host", "path", "rule", "verdict", "score") == expected


def test_scripts_are_told_apart_at_equal_shape(spark):
    good = [f"http://x{i}.com/привет/{w}" for i in range(9) for w in ("мир", "дом", "сад")]
    bad = [f"http://x{i}.net/fr/спам/{w}" for i in range(9) for w in ("яд", "зло", "ложь")]
    asked = ["http://y.org/привет/дом", "http://y.org/спамит/зло", "http://y.org/你好世界中/字典库"]
    urls = good + bad + asked
    want = brute(urls)
    found = {r["page_id"]: (r["verdict"], r["score"]) for r in judged(spark, urls).collect()}
    last = [found[len(urls) - 3 + i] for i in range(3)]
    assert last == [want[u][3:] for u in asked]
    assert len({score for _, score in last}) == 3
    assert last[0][1] > last[2][1] > last[1][1]


def test_a_url_of_many_rows_and_many_without_text(spark):
    urls = ["http://hot.org/a"] * 3000 + [None] * 3000 + [f"http://h{i}.org/b" for i in range(300)]
    urls += [f"http://h{i}.com/en" for i in range(40)] + [f"http://h{i}.net/es/" for i in range(40)]
    want = brute(urls)
    found = judged(spark, urls, 0).collect()
    assert sorted(r["page_id"] for r in found) == list(range(len(urls)))
    assert all((r["verdict"], r["score"]) == want[urls[r["page_id"]]][3:] for r in found)


def test_whole_pages_equal_brute_force(spark):
    pages = table(spark, "pages", "0.01")
    rows = [tuple(r) for r in pages.select("page_id", "url").collect()]
    want = brute([u for _, u in rows])
    got = uf.judge_urls(pages, URL_RULES)
    expected = sorted((i, want[u][2] or "", want[u][3]) for i, u in rows)
    assert sorted((r["page_id"], r["rule"] or "", r["verdict"]) for r in got.collect()) == expected


def test_without_examples_of_a_class_and_empty(spark):
    got = judged(spark, ["http://a.org/x", "http://b.org/y", None])
    assert sorted(r["verdict"] for r in got.collect()) == ["allow"] * 3  # equal models, threshold 0
    assert judged(spark, []).count() == 0


def test_no_python_runs(spark):
    got = uf.judge_urls(table(spark, "pages"), URL_RULES)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan


def test_sql_gives_the_same_rows(spark):
    same_as_duckdb(spark, "op2_url_filter", op2_url_filter, f"{TESTDATA}/sf0.01", ("pages",))
