"""URL filter: pattern rules indexed by their rarest literal token.

Every rule carries a regular expression and the literal tokens that any URL it matches must contain. Token
frequencies over the whole table (only of tokens that rules have, so the counts are as few as those) decide
which token of a rule is its rarest, and the rule is filed under that one. A URL's own tokens then fetch the
candidate rules, and only candidates' expressions run. Rules are broadcast in blocks of at most ``BLOCK_BYTES``; a
larger rule set takes more passes over the URLs, each a job of its own that keeps the better of its winner and those
before, and whose broadcast is freed before the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, ascii_lower, materialise

#: Bytes of a block of rules: their names, patterns and literals, and about ``RULE_BYTES`` for each rule beside.
BLOCK_BYTES, RULE_BYTES = 32_000_000, 200
#: A token of a URL: a run of ASCII letters and digits, or of other characters that are not ASCII.
TOKEN = r"[0-9A-Za-z\x80-\U0010FFFF]+"
_TOKEN = re.compile(TOKEN)
_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched from the start of host + path; ``literals`` are whole tokens of what it matches.

    ``fixed``: a listed rule, that is reported and beats all that aren't; then come exceptions; of several the longest
    ``name`` wins, then block, then the smaller name. A rule without literals is tried on every URL.
    """

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    fixed: bool = True
    exception: bool = False


def listed(rule: str, verdict: str) -> Rule:
    """A rule host/path: its host and all subdomains, where the path starts with the rule's path."""
    host, slash, path = rule.partition("/")
    host = host.translate(_LOWER)
    tokens = _TOKEN.findall(host)
    inner = _TOKEN.findall(path)
    if inner and _TOKEN.fullmatch(path[-1]):
        inner.pop()  # a URL's token may go on where the rule's path ends
    end = re.escape(slash + path) if slash else r"(?:/|\Z)"
    return Rule(rule, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{end}", tuple(dict.fromkeys(tokens + inner)))


def keyword(token_a: str, token_b: str, verdict: str = "block") -> Rule:
    """A rule for host labels of the form a-b, with anything before and after the label."""
    return Rule(f"{token_a}-{token_b}", verdict, rf"(?:[^/]*\.)?{re.escape(token_a)}-{re.escape(token_b)}(?:\.|/|\Z)", (token_a, token_b), fixed=False)


#: What ^ stands for in a filter list: the end, or a character that neither a word nor a name can have.
SEPARATOR = r"(?:[^0-9A-Za-z_.%\-\x80-\U0010FFFF]|\Z)"


def filter_rule(line: str) -> Rule | None:
    """A line of a filter list: ``||`` for a host or its subdomains, ``|`` for either end, ``*``, ``^``, and ``@@`` for exceptions.

    Case doesn't count. A scheme at the start is left out, as host and path are matched. Comments, rules that hide parts
    of pages and rules with options, which depend on the page that asks, are None.
    """
    text = line.strip()
    if not text or text[0] in "![" or "##" in text or "#@#" in text or "$" in text:
        return None
    exception, text = text.startswith("@@"), text.removeprefix("@@")
    label, text = text.startswith("||"), text.removeprefix("||")
    start, text = label or text.startswith("|"), text.removeprefix("|") if not label else text
    end, body = text.endswith("|"), text.removesuffix("|").translate(_LOWER)
    scheme = re.match(r"(?:https?|\*)://", body)
    if scheme and not label:
        start, body = start or scheme[0] != "*://", body[scheme.end() :]
    if not body.strip("*^"):
        return None
    pattern = "".join(".*" if c == "*" else SEPARATOR if c == "^" else re.escape(c) for c in body)
    head = r"(?:[^/]*\.)?" if label else "" if start else ".*?"
    # a token is whole where nothing can go on at its ends
    whole = [m[0] for m in _TOKEN.finditer(body) if (body[m.start() - 1] != "*" if m.start() else start) and (body[m.end()] != "*" if m.end() < len(body) else end)]
    return Rule(line.strip(), "allow" if exception else "block", f"(?i:{head}{pattern}{r'\Z' if end else ''})", tuple(dict.fromkeys(whole)), fixed=False, exception=exception)


def rules_of(lines: DataFrame, column: str = "value") -> Iterator[Rule]:
    """The rules of a filter list that is a table of lines (as ``spark.read.text`` gives it), one after another; repeats once."""
    for r in lines.select(column).filter(F.col(column).isNotNull()).distinct().toLocalIterator():
        rule = filter_rule(r[0])
        if rule is not None:
            yield rule


LISTED = (listed("net/", "block"), listed("example.net/en/", "allow"), listed("example.com/de/", "block"), listed("org/fr/", "allow"))
#: Labels of advertising, adult, gambling, pharmacy and spam hosts.
LABELS = (("ads", "track"), ("adult", "x"), ("casino", "win"), ("cheap", "pills"), ("free", "bets"), ("spam", "farm"))
DEFAULT_RULES = LISTED + tuple(keyword(a, b) for a, b in LABELS)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_frequencies(parts: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many rows hold each token that the rules have; bounded by the rules' tokens."""
    wanted = sorted({t for r in rules for t in r.literals})
    if not wanted:
        return {}
    tokens = parts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+)"), 1))).alias("token"))
    small = parts.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    return {r["token"]: r["count"] for r in tokens.join(F.broadcast(small), "token", "left_semi").groupBy("token").count().collect()}


class Index:
    """Rules by their rarest literal token."""

    def __init__(self, rules: tuple[Rule, ...], frequency: dict[str, int]):
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.tried = 0
        # expressions are compiled when a URL first fetches their rule
        self.rules = [(r.name, r.verdict, r.pattern, r.fixed, r.exception) for r in rules]
        self.compiled: dict[int, re.Pattern] = {}
        for i, r in enumerate(rules):
            if r.literals:
                self.by_token.setdefault(min(r.literals, key=lambda t: (frequency.get(t, 0), t)), []).append(i)
            else:
                self.always.append(i)

    def best(self, host: str, path: str) -> tuple | None:
        """(rank, name or None, verdict) of the winning rule; a smaller rank wins."""
        text = host + path
        tokens = _TOKEN.findall(text)
        found = {i for t in {*tokens, *[t.translate(_LOWER) for t in tokens]} for i in self.by_token.get(t, ())}
        won = None
        for i in (*found, *self.always):
            name, verdict, pattern, fixed, exception = self.rules[i]
            rank = (not fixed, not exception, -len(name), verdict != "block", name)
            if won is None or rank < won[0]:
                self.tried += 1
                if i not in self.compiled:
                    self.compiled[i] = re.compile(pattern, re.DOTALL)
                if self.compiled[i].match(text):
                    won = (rank, name if fixed else None, verdict)
        return won


RANKED = "struct<rank:string,rule:string,verdict:string>"


def winner_column(host: Column, path: Column, shared) -> Column:
    """The winner of a broadcast block of (rules, frequency): its rank, name (of listed rules) and verdict; nulls if none fits."""

    @F.pandas_udf(RANKED)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = Index(*shared.value)
        for hosts, paths in batches:
            rows = []
            for h, p in zip(hosts, paths, strict=True):
                w = index.best(h, p)
                # a rank as text: fixed first, then exceptions, the longest name, block before allow, the smaller name
                rows.append((None, None, None) if w is None else (f"{int(w[0][0])}{int(w[0][1])}{10**6 + w[0][2]:07d}{int(w[0][3])}{w[0][4]}", w[1], w[2]))
            yield pd.DataFrame(rows, columns=["rank", "rule", "verdict"])

    return judge(host, path)


def blocks(rules: Iterable[Rule], limit: int) -> Iterator[tuple[Rule, ...]]:
    """Rules in blocks of at most ``limit`` bytes (at least one rule each)."""
    block, size = [], 0
    for r in rules:
        n = RULE_BYTES + sum(len(x.encode()) for x in (r.name, r.pattern, *r.literals))
        if block and size + n > limit:
            yield tuple(block)
            block, size = [], 0
        block.append(r)
        size += n
    if block:
        yield tuple(block)


def judged(pages: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``, without a shuffle of the rows.

    ``rule`` is the listed rule that decides (null if none fits); ``verdict`` is that rule's, else that of the best
    pattern rule, else ``default``. A null URL, or one without ://, has empty host and path, fits no listed rule and
    gets ``default``. Very long URLs are read whole. Rows that repeat stay, other columns are ignored, whatever their
    names, an empty table gives no rows.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    todo = list(blocks(rules, block_bytes))
    won = parts.withColumn("_won", F.lit(None).cast(RANKED))
    for at, block in enumerate(todo):
        frequency = token_frequencies(parts, block)
        shared = pages.sparkSession.sparkContext.broadcast((block, frequency))
        both = F.filter(F.array("_won", winner_column(F.col("host"), F.col("path"), shared)), lambda w: w["rank"].isNotNull())
        won = won.select("page_id", "host", "path", F.array_min(both).alias("_won"))
        if at < len(todo) - 1:
            won = materialise(won)
            shared.destroy()
    return won.select("page_id", "host", "path", F.col("_won.rule").alias("rule"), F.coalesce("_won.verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)(\.|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
