"""Odds of tokens are those of the tokens themselves, broadcast or joined."""

import zlib
from collections import Counter
from math import log

import pytest

from regspan.llm import urls
from regspan.llm.common import table


def stranger(token):
    """A path token whose crc32 falls into the same one of 2^16 buckets."""
    want = zlib.crc32(token.encode()) % (1 << 16)
    letters = str.maketrans("0123456789", "abcdefghij")
    return next(w for i in range(10 ** 8) if zlib.crc32(f"p:{(w := str(i).translate(letters))}".encode()) % (1 << 16) == want)


@pytest.mark.parametrize("broadcast", [20_000, 2, 0])
def test_odds_against_plain_version(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST_TOKENS", broadcast)
    monkeypatch.setattr(urls, "HELD", 3)
    other = stranger("p:jackpots")
    rows = [(i, f"http://casino.example.com/jackpots/x{i % 5}/jackpots", None) if i % 2 else (i, f"http://garden.example.org/fr/rose{i % 9}", None) for i in range(80)]
    rows += [(100, f"http://shop.example.com/{other}", None), (100, "http://shop.example.com/jackpots/jackpots", None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = urls.judge(pages).collect()
    skip, n = urls.rule_words(urls.RULES), (Counter(), Counter())
    for r in got:
        marked = "casino" in (r["words"] or ())
        if marked or r["rule"] == "org/fr/":
            n[marked].update(urls._tokens(r["words"], r["path"], skip, 1))
    seen = n[0].keys() | n[1].keys()
    odds = {t: log((n[1][t] + 1) / (n[1].total() + len(seen)) * (n[0].total() + len(seen)) / (n[0][t] + 1)) for t in seen}
    assert len(got) == len(rows) and len(seen) > 2
    free = [r for r in got if r["rule"] is None]
    block = sum("casino" in (r["words"] or ()) for r in free)
    prior = min(0.0, log((block + 1) / (len(free) - block + 1)))
    for r in got:
        assert r["odds"] == pytest.approx(prior + sum(odds.get(t, 0.0) for t in urls._tokens(r["words"], r["path"], skip, 1)))
    by_path = {r["path"]: r for r in got}
    assert by_path[f"/{other}"]["verdict"] == "allow" and by_path["/jackpots/jackpots"]["verdict"] == "block"


def test_no_ordinary_host_is_blocked_for_its_language_alone(spark):
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    got = urls.judge(pages).where("rule IS NULL").select("host", "path", "verdict", "words").collect()
    telling = [r for r in got if set(r["words"] or []) & set(urls.TELLING)]
    plain = [r for r in got if not set(r["words"] or []) & set(urls.TELLING)]
    assert telling and all(r["verdict"] == "block" for r in telling)
    assert sum(r["verdict"] == "block" for r in plain) <= 0.02 * len(plain)
