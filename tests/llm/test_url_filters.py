"""Hosts, paths, rules and the cascade against plain Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import url_filters as uf
from tessera.llm.queries import URL_RULES

URLS = [
    "http://a.example.org/en/12?x=1", "HTTPS://A.Example.ORG/es/#top", "http://example.org", "http://example.org/", "http://b.com/fr/x",
    "http://b.com/de/x?y#z", "http://b.com/de", "http://notexample.org/es/1", "http://org/", "ftp://x.net?/fr/", "x.org/es/", "", None,
    "://", "http://", "http://É.org/ü", "http://a.b.c.d.net/p/q", "http://a.b.c.d.net/p/q", "http://u@h.com:80/fr/", "a://b://c.org/x",
    "http://sub.bad.net/x", "http://bad.net", "http://verybad.net/", "http://ok.net/only/this", "http://ok.net/only", "http://..//",
]


def parts(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def expected(url: str | None, listed: set[str]) -> tuple:
    host, path = parts(url)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    labels = host.split(".")
    keys = {".".join(labels[k:]) for k in range(len(labels))} | {host + path} if host else set()
    verdict = rule.verdict if rule else "block" if keys & listed else "allow"
    return host, path, rule.text if rule else None, verdict


@pytest.mark.parametrize("max_bits", [uf.MAX_BITS, 8])
@pytest.mark.parametrize("listed", [[], ["bad.net", "ok.net/only/this", "never.seen", None, "bad.net"], ["net"]])
def test_verdicts(llm, listed, max_bits):
    pages = llm.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").withColumns({c: F.lit(1) for c in ("host", "key", "verdict", "rule")})
    got = uf.judge(pages, URL_RULES, llm.createDataFrame([(x,) for x in listed], "key string"), max_bits=max_bits).collect()
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got} == {(k, *expected(u, {x for x in listed if x})) for k, u in enumerate(URLS)}
    assert len(got) == len(URLS)


def test_cascade_is_exact_over_its_universe(llm):
    universe = llm.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 37 == 0).alias("listed"))
    cascade = uf.build_cascade(universe)
    assert len(cascade.levels) > 2
    assert universe.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
    bits = sum(b for b, _, _ in cascade.levels)
    assert bits < 20 * 541


def test_plan_has_no_join_for_membership(llm):
    pages = llm.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    judged = uf.judge(pages, URL_RULES, llm.createDataFrame([("bad.net",)], "key string"))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table(llm):
    none = llm.createDataFrame([], "page_id bigint, url string")
    assert uf.judge(none, URL_RULES, llm.createDataFrame([("a",)], "key string")).count() == 0
