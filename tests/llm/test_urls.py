"""URL rules, windows and the language model against dictionaries."""

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from arborstat.llm import url_filter as U
from arborstat.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda c: c[0].lower(), host), path


def ruled(host, path):
    best = None
    for verdict, rule in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def model(urls, order):
    n = defaultdict(Counter)
    for u in urls:
        s = U.START * order + u + U.END
        for i in range(order, len(s)):
            for k in range(order + 1):
                n[s[i - k : i]][s[i]] += 1
    return n


def probability(n, context, c, letters):
    p = 1 / letters
    for k in range(len(context) + 1):
        seen = n.get(context[len(context) - k :])
        if seen:
            p = (seen[c] + len(seen) * p) / (seen.total() + len(seen))
    return p


def expected(urls, order=U.ORDER):
    """Score in steps and verdict of every distinct URL without a rule."""
    every = {u or "" for u in urls}
    of = {u: ruled(*parts(u))[1] for u in every}
    letters = len({c for u in every for c in u} | {U.END})
    back = {u for u in every if of[u] and crc32(u.encode()) % U.KEPT_BACK == 0}

    def scorer(some):
        a, b = (model([u for u in some if of[u] == v], order) for v in ("allow", "block"))

        def score(u):
            s, total = U.START * order + u + U.END, 0
            for i in range(order, len(s)):
                total += round((math.log(probability(a, s[i - order : i], s[i], letters)) - math.log(probability(b, s[i - order : i], s[i], letters))) * U.UNIT)
            return math.floor(total / ((len(s) - order) * (U.UNIT // U.STEPS)))

        return score

    part, full = scorer(every - back), scorer(every)
    judged = [(part(u), of[u]) for u in back]
    limit, best = 0, None
    count = Counter(v for _, v in judged)
    if count["allow"] and count["block"]:
        for t in {s for s, _ in judged}:
            wrong = sum(s < t for s, v in judged if v == "allow") * count["block"] + sum(s >= t for s, v in judged if v == "block") * count["allow"]
            if best is None or (wrong, abs(t), t) < best:
                best, limit = (wrong, abs(t), t), t
    scores = {u: full(u) for u in every if not of[u]}
    return {u: (s, "allow" if s >= limit else "block") for u, s in scores.items()}


ODD = [None, "", "no scheme", "http://", "HTTP://ORG", "http://org/", "http://x.ORG/es/1", "ftp://example.org/es/", "http://a.example.org/en/12?x=/en/", "http://notexample.org/es/1", "a://b://org/x",
       "http://é.example.net/ü😀", "http://com?/fr/", "http://com/fr/#/de/", "http://x.net/a\nb", "http://x.net/a\nb", "http://host.net/" + "ab" * 4000]


def test_against_dictionaries(spark):
    urls = ODD + [f"http://{h}.example.{t}/{p}/{i * 37 % 500}" for i in range(40) for h, t, p in [("good", "com", "fr"), ("spam", "com", "de"), ("spam", "net", "de"), ("good", "net", "fr"), ("blog", "org", "fr")]]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(None, "http://q.net/", None)], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "score", "row", "gram")})
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict, r.score) for r in U.judge(pages.repartition(4), URL_RULES).collect()}
    want, scores = set(), expected(urls + ["http://q.net/"])
    for i, u in [*enumerate(urls), (None, "http://q.net/")]:
        rule, verdict = ruled(*parts(u))
        s, v = (None, verdict) if rule else (scores[u or ""][0] / U.STEPS, scores[u or ""][1])
        want.add((i, *parts(u), rule, v, s))
    assert got == want
    by = {(r[1], r[4]) for r in got if r[1] in ("spam.example.net", "good.example.net")}
    assert ("spam.example.net", "block") in by and ("good.example.net", "allow") in by


def test_one_kind_and_none(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.org/x")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge(pages, URL_RULES).collect()} == {1: "allow", 2: "allow"}
    assert {r.verdict for r in U.judge(pages, ()).collect()} == {"allow"}
    assert U.judge(pages.limit(0), URL_RULES).count() == 0


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """Windows are planned by the files of the URLs they are made of, which are small."""
    plans, write = [], U.cut_lineage

    def noted(df):
        plans.append(df)
        return write(df)

    monkeypatch.setattr(U, "cut_lineage", noted)
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.example."), F.element_at(F.array(*map(F.lit, ("com/fr/", "com/de/", "net/fr/"))), (F.col("id") % 3 + 1).cast("int")), "id").alias("url"))
    plans.append(U.judge(pages, URL_RULES))
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert sum("Join" in p for p in plans) == 3 and not any("BroadcastExchange" in p for p in plans)


def test_clashing_columns_are_refused(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "host long, url string")
    with pytest.raises(ValueError):
        U.judge(pages, URL_RULES, keep=("host",))
