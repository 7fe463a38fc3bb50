"""URL filters: listed rules, and naive Bayes over segmented host names and paths.

Host names are split at dots and signs, then a unigram Viterbi search splits what is written together. Word counts come
from the text of all pages; only words that occur inside a host name are joined to it. Naive Bayes counts are kept for each
token itself, learned from urls with telling words and from those that a rule allows, and judge what no rule decides. Up to a
checked number of tokens is broadcast, the most frequent ones first; the odds of all others meet the urls in a join.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from regspan.llm.common import map_rows
from regspan.session import durable


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Host words that mark a url as one to block for learning.
TELLING = ("ads", "adserver", "banner", "bet", "bets", "betting", "casino", "jackpot", "malware", "pharma", "phishing", "pills", "porn",
           "spam", "track", "tracker", "viagra", "xxx")
#: Tokens whose odds are broadcast; salts of the join that brings those of all others.
BROADCAST_TOKENS, SALTS = 20_000, 8
#: Longest word that segmentation looks for; a longer stretch is split.
LONGEST = 24
#: Pseudo-count of a token.
SMOOTH = 1.0
_TAG = re.compile(r"<script.*?</script>|<style.*?</style>|<[^>]*>", re.S | re.I)
_WORD = re.compile(r"[a-z]+")
#: Counted words a task holds before it passes them on.
HELD = 400_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def by_rule(rules: tuple[Rule, ...], field: str) -> Column:
    """Name or verdict of the longest rule that fits columns ``host`` and ``path``; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def word_counts(pages: DataFrame, text_col: str = "html") -> DataFrame:
    """(word, n) over the visible text of all ``pages``; words of up to ``LONGEST`` letters a-z. Null texts have none."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column("text").to_pylist():
                counts.update(_WORD.findall(_TAG.sub(" ", text or "").lower()))
            if len(counts) > HELD:
                yield out()
                counts.clear()
        yield out()

    parts = map_rows(pages.select(F.col(text_col).cast("string").alias("text")), run, "word string, n bigint")
    return parts.where(F.length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))


def split_name(name: str, words: list[tuple[int, int, int]] | None, total: int) -> list[str]:
    """The most probable words of ``name`` under unigram counts: ``words`` holds (start, length, count) of known ones.

    An unknown stretch costs ten times more per letter than one more word would.
    """
    found: dict[int, list[tuple[int, float]]] = {}
    for start, length, n in words or []:
        found.setdefault(start + length, []).append((start, float(np.log(n / total))))
    unknown = -np.log(total + 1.0) - 1.0
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        options = [(best[s] + p, s) for s, p in found.get(end, ())]
        # letters without a known word go together with those before them
        options += [(best[s] + unknown - 2.3 * (end - s), s) for s in range(max(0, end - LONGEST), end)]
        top = max(options)
        best.append(top[0])
        back.append(top[1])
    out, end = [], len(name)
    while end:
        out.append(name[back[end]:end])
        end = back[end]
    return out[::-1]


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words: array) for the distinct hosts of ``hosts``; a host without letters has no words.

    Each distinct part of a name meets the counted words it contains in a join, so neither side needs to be small.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = hosts.select("host", F.posexplode(F.split("host", "[^a-z]+")).alias("at", "part")).where("part <> ''")
    names = parts.select("part").distinct()
    inside = names.select("part", F.explode(F.expr("sequence(0, length(part) - 1)")).alias("start")).select(
        "part", "start", F.explode(F.expr(f"sequence(1, least({LONGEST}, length(part) - start))")).alias("len")).select(
        "part", "start", "len", F.expr("substring(part, start + 1, len)").alias("word"))
    hits = inside.join(counts, "word").groupBy("part").agg(F.collect_list(F.struct("start", "len", "n")).alias("words"))

    def run(batches):
        for b in batches:
            rows = [split_name(p, [(w["start"], w["len"], w["n"]) for w in ws or []], max(total, 1))
                    for p, ws in zip(b.column("part").to_pylist(), b.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(rows, pa.list_(pa.string()))], ["part", "split"])

    split = map_rows(names.join(hits, "part", "left").select("part", "words"), run, "part string, split array<string>")
    return parts.join(split, "part").groupBy("host").agg(
        F.expr("flatten(transform(array_sort(collect_list(struct(at, split))), x -> x.split))").alias("words"))


@dataclass
class Bayes:
    odds: dict[str, float]  # log-odds of block of the most frequent tokens
    prior: float
    rest: DataFrame | None  # (token, odds) of all others, or None without any


def _tokens(words: list[str] | None, path: str, skip: frozenset, depth: int) -> list[str]:
    """Host words, and words and numbers of the path below its first ``depth`` segments."""
    below = path.lower().split("/")[depth + 1:] if depth else [path.lower()]
    found = re.findall(r"[a-z]+|[0-9]+", "/".join(below))
    return [f"h:{w}" for w in words or [] if w not in skip] + [f"p:{'#' if t.isdigit() else t}" for t in found if t not in skip]


def rule_depth(rules: tuple[Rule, ...]) -> int:
    """Path segments that the rules look at. They decide which urls teach allow, so what stands there is no evidence."""
    return max((len([x for x in r.path.split("/") if x]) for r in rules), default=0)


def rule_words(rules: tuple[Rule, ...]) -> frozenset:
    """Words that the rules themselves name: they decide the labels, so they are no evidence beyond them."""
    return frozenset(w for r in rules for w in re.findall(r"[a-z]+", r.name))


def fit(rows: DataFrame, rules: tuple[Rule, ...] = RULES, telling: tuple[str, ...] = TELLING) -> Bayes:
    """Multinomial naive Bayes from ``rows`` (path, rule_verdict, words).

    A telling word in the host teaches block; without one, a rule that allows teaches allow. What a rule blocks for its
    domain alone says nothing about words and teaches nothing. The prior is the share of telling hosts among the urls that
    no rule decides, at most one half: a url without evidence is never blocked.
    """
    skip, marks, depth = rule_words(rules), frozenset(telling), rule_depth(rules)

    def run(batches):
        sums = (Counter(), Counter())

        def out():
            seen = [*sums[0].keys() | sums[1].keys()]
            counts = [pa.array([c[t] for t in seen], pa.int64()) for c in sums]
            for c in sums:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), *counts], ["token", "n0", "n1"])

        for b in batches:
            for path, verdict, words in zip(*(b.column(c).to_pylist() for c in ("path", "rule_verdict", "words"))):
                marked = bool(marks.intersection(words or ()))
                if marked or verdict == "allow":
                    sums[marked].update(_tokens(words, path, skip, depth))
            if sum(map(len, sums)) > HELD:
                yield out()
        yield out()

    counts = durable(map_rows(rows.select("path", "rule_verdict", "words"), run, "token string, n0 bigint, n1 bigint").groupBy("token").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    size, all0, all1 = counts.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n0", "n1")]).first()
    least = SMOOTH * max(size, 1)
    share = lambda c, n: (F.col(c) + SMOOTH) / (n + least)
    odds = counts.select("token", (F.col("n0") + F.col("n1")).alias("n"), F.log(share("n1", all1) / share("n0", all0)).alias("odds"))
    top = {r["token"]: r["odds"] for r in odds.orderBy(F.desc("n"), "token").limit(BROADCAST_TOKENS).collect()}
    rest = odds.select("token", "odds") if size > len(top) else None
    told = F.arrays_overlap(F.coalesce("words", F.array().cast("array<string>")), F.array(*map(F.lit, telling or ("",))))
    free, block = rows.where("rule_verdict IS NULL").agg(F.count("*"), F.coalesce(F.count_if(told), F.lit(0))).first()
    return Bayes(top, min(0.0, float(np.log((block + SMOOTH) / (free - block + SMOOTH)))), rest)


def _rest_odds(rows: DataFrame, model: Bayes, skip: frozenset, depth: int) -> DataFrame:
    """(_row, rest): summed odds of the tokens of ``rows`` (_row, path, words) that are not broadcast; absent without any."""

    def run(batches):
        for b in batches:
            out = [(row, t, n) for row, path, words in zip(*(b.column(c).to_pylist() for c in ("_row", "path", "words")))
                   for t, n in Counter(_tokens(words, path, skip, depth)).items() if t not in model_odds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.string(), pa.int64()))],
                                             ["_row", "token", "n"])

    model_odds = model.odds
    used = map_rows(rows.select("_row", "path", "words"), run, "_row bigint, token string, n bigint").withColumn("salt", F.pmod("_row", F.lit(SALTS)))
    dealt = model.rest.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return used.join(dealt, ["token", "salt"]).groupBy("_row").agg(F.sum(F.col("n") * F.col("odds")).alias("rest"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, telling: tuple[str, ...] = TELLING) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, odds) of every row of ``pages`` (page_id, url, html).

    The longest rule that fits decides; otherwise the sign of the naive Bayes log-odds ``odds``. Null and odd urls have an
    empty host and path and are judged by the prior (allow). Repeated rows stay; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = urls.select("page_id", host.alias("host"), path.alias("path")).select(
        "page_id", "host", "path", by_rule(rules, "name").alias("rule"), by_rule(rules, "verdict").alias("rule_verdict"))
    words = durable(host_words(parsed.select("host").distinct(), durable(word_counts(urls))))
    rows = durable(parsed.join(words, "host", "left").withColumn("_row", F.monotonically_increasing_id()))
    model, skip, depth = fit(rows, rules, telling), rule_words(rules), rule_depth(rules)
    if model.rest is None:
        rows = rows.withColumn("rest", F.lit(0.0))
    else:
        rows = rows.join(_rest_odds(rows, model, skip, depth), "_row", "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))
    top, prior = model.odds, model.prior

    def run(batches):
        for b in batches:
            odds = [prior + rest + sum(top.get(t, 0.0) for t in _tokens(w, p, skip, depth)) for w, p, rest in
                    zip(*(b.column(c).to_pylist() for c in ("words", "path", "rest")))]
            names = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(odds, pa.float64())], [*names, "odds"])

    scored = map_rows(rows.select("page_id", "host", "path", "rule", "rule_verdict", "words", "rest"), run,
                      "page_id bigint, host string, path string, rule string, rule_verdict string, words array<string>, odds double")
    own = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "words", "odds")
