"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression with the literal tokens that any matching URL
must hold. Counted over the given URLs, the rarest of its tokens becomes the
rule's key. Each URL is split into tokens; those that are keys fetch their
rules, and only these run their expressions. Host-and-path rules are kept in
the same index under the rarest token of their host. Rules without any literal
token are run on every URL.

Null URLs and URLs without `://` have an empty host and path and match
nothing; of equally long path rules the smallest name wins, and of several
matching patterns the first; the time grows with a URL's length and the rules
it fetches; repeated URLs get equal verdicts; an empty table gives an empty
result; other columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import received, sent

#: Limit on the rules that are broadcast to every task, in number.
MAX_RULES = 200_000


@dataclass(frozen=True)
class PathRule:
    """Allows or blocks a host with its subdomains, below a path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """Blocks URLs that match; every match must hold all `literals` as whole tokens."""

    name: str
    pattern: str
    literals: tuple[str, ...]


#: Fixed default rules: hosts that name themselves spam, adult or gambling sites, and links that only track or redirect.
PATTERNS = (
    PatternRule("spam-farm", r"^[^/]*://(?:[^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule("adult-host", r"^[^/]*://(?:[^/?#]*[.-])?adult(?:-[a-z0-9]+)?\.", ("adult",)),
    PatternRule("porn-host", r"^[^/]*://(?:[^/?#]*[.-])?porn(?:-[a-z0-9]+)?\.", ("porn",)),
    PatternRule("casino-host", r"^[^/]*://(?:[^/?#]*[.-])?casino(?:-[a-z0-9]+)?\.", ("casino",)),
    PatternRule("malware-host", r"^[^/]*://(?:[^/?#]*[.-])?malware(?:-[a-z0-9]+)?\.", ("malware",)),
    PatternRule("redirect-query", r"[?&]redirect=https?(?::|%3a)//", ("redirect",)),
)
TOKEN = re.compile(r"[a-z0-9]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def token_counts(urls: DataFrame, url_col: str, wanted: list[str]) -> dict[str, int]:
    """How many URLs hold each wanted token; at most one row a wanted token comes to the driver."""
    if not wanted:
        return {}
    tokens = F.split(F.translate(F.col(url_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+")
    few = urls.sparkSession.createDataFrame([(w,) for w in wanted], "token string")
    found = urls.select(F.explode(F.array_distinct(tokens)).alias("token")).join(F.broadcast(few), "token", "left_semi")
    rows = found.groupBy("token").count().collect()
    return {w: 0 for w in wanted} | {r["token"]: r["count"] for r in rows}


def read_rules(table: DataFrame, *, limit: int = MAX_RULES) -> tuple[list[PathRule], tuple[PatternRule, ...]]:
    """Path rules and pattern rules of a table (kind, name, host, path, verdict, pattern, literals), `limit` rows at most.

    kind is `path` (host, path, verdict count) or `pattern` (name, pattern,
    literals, an array of tokens). Path rules come in the order of their names,
    patterns in that of theirs; rows with a null in what counts are an error.
    """
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules")
    paths = [PathRule(r["host"], r["path"], r["verdict"]) for r in rows if r["kind"] == "path"]
    patterns = [PatternRule(r["name"], r["pattern"], tuple(r["literals"] or ())) for r in rows if r["kind"] == "pattern"]
    if len(paths) + len(patterns) < len(rows) or any(None in (r.host, r.path, r.verdict) for r in paths) or any(None in (r.name, r.pattern) for r in patterns):
        raise ValueError("a rule is neither a whole path rule nor a whole pattern rule")
    return sorted(paths, key=lambda r: r.name), tuple(sorted(patterns, key=lambda r: r.name))


def judge_urls(urls: DataFrame, paths: list[PathRule], patterns: tuple[PatternRule, ...] = PATTERNS, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a URL: id, host, path, rule (the longest fitting path rule, else null), pattern (the first matching pattern rule, else null), verdict.

    The path rule decides; without one, a matching pattern blocks, and all else is allowed.
    """
    if len(paths) + len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    needs = [TOKEN.findall(r.host) for r in paths] + [list(r.literals) for r in patterns]
    counts = token_counts(urls, url_col, sorted({t for n in needs for t in n}))
    index: dict[str, list[int]] = {}
    for i, need in enumerate(needs):
        index.setdefault(min(need, key=lambda t: (counts[t], t), default=""), []).append(i)
    shared = sent(urls.sparkSession, (index, list(paths), list(patterns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, paths, patterns = received(shared)
        compiled: dict[int, re.Pattern] = {}

        def matches(i: int, url: str) -> bool:
            # a rule is compiled when a URL first fetches it
            if i not in compiled:
                compiled[i] = re.compile(patterns[i].pattern)
            return compiled[i].search(url) is not None

        # most distinct rules first: the longest name wins, and of equal ones the smallest
        order = {i: (-len(r.name), r.name) for i, r in enumerate(paths)}
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for url in b.column(1).to_pylist():
                host, path = parts(url)
                low = (url or "").translate(LOWER)
                fetched = {i for t in {"", *TOKEN.findall(low)} for i in index.get(t, ())}
                rule = next((paths[i] for i in sorted((i for i in fetched if i < len(paths)), key=order.__getitem__) if path.startswith(paths[i].path) and (host == paths[i].host or host.endswith("." + paths[i].host))), None)
                hit = next((patterns[i - len(paths)] for i in sorted(fetched) if i >= len(paths) and matches(i - len(paths), low)), None)
                for column, x in zip(out, (host, path, rule and rule.name, hit and hit.name, rule.verdict if rule else "block" if hit else "allow"), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in out)], names=["id", "host", "path", "rule", "pattern", "verdict"])

    return urls.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")).mapInArrow(run, "id bigint, host string, path string, rule string, pattern string, verdict string")
