"""URL filter rules, indexed by their rarest literal token: a URL's tokens fetch the few rules whose pattern is tried."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")
_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is tried on host and path in a row; ``literals`` are tokens that every URL it fits must have.

    Rules with a ``name`` decide first: the longest name that fits. Of the others, the longest pattern decides.
    """

    action: str
    pattern: str
    literals: tuple[str, ...]
    name: str | None = None


def prefix_rule(action: str, host: str, path: str) -> Rule:
    """Fits a host and its subdomains if the path starts with ``path``.

    A token of the rule is literal if the rule itself ends it: in ``/en/1`` the last one may go on in the URL.
    """
    whole = host + path
    tokens = [m[0] for m in TOKEN.finditer(whole.translate(_TO_LOWER)) if m.end() < len(whole)]
    return Rule(action, rf"(?:[^/]*\.)?{re.escape(whole)}", tuple(dict.fromkeys(tokens)), whole)


def pattern_rule(action: str, glob: str) -> Rule:
    """``^`` stands for a character that is in no token, or an end; ``*`` for anything. Tried on the lower-cased URL."""
    parts = re.split(r"([*^])", glob)
    pattern = "".join({"*": ".*", "^": r"(?:^|$|(?<=[^a-z0-9])|(?=[^a-z0-9]))[^a-z0-9]?"}.get(p, re.escape(p)) for p in parts)
    tokens = [m[0] for m in TOKEN.finditer(glob) if (m.start() > 0 and glob[m.start() - 1] != "*") and (m.end() < len(glob) and glob[m.end()] != "*")]
    return Rule(action, f"(?s:.*?){pattern}", tuple(dict.fromkeys(tokens)))


#: Rules that are given: org/ is allowed, and so on.
LISTED = (prefix_rule("allow", "org", "/"), prefix_rule("block", "example.org", "/es/"), prefix_rule("block", "example.org", "/en/1"),
          prefix_rule("allow", "com", "/fr/"), prefix_rule("block", "com", "/de/"))
#: Words of hosts and paths that mark betting, adult, advertising and piracy pages.
UNWANTED = ("adserver adult ads betting bets bet casino casinos clickbait escort escorts gambling hentai keygen lottery nude nudes payday "
            "poker porn popunder sex sexy slots spam torrent torrents track tracker tracking viagra warez webcam xxx").split()
RULES = (*LISTED, *(pattern_rule("block", f"^{word}^") for word in UNWANTED))


def parts_of(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path), both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(_TO_LOWER), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


class RuleIndex:
    """Rules by the literal token that the fewest URLs have; rules without any are always tried."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        self.rules = [(r, re.compile(r.pattern)) for r in rules]
        for i, rule in enumerate(rules):
            if rule.literals:
                self.by_token[min(rule.literals, key=lambda t: (counts.get(t, 0), t))].append(i)
            else:
                self.always.append(i)

    def candidates(self, tokens: set[str]) -> list[int]:
        return [*self.always, *(i for t in tokens if t in self.by_token for i in self.by_token[t])]

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """(name of the listed rule that decides, verdict)."""
        whole = host + path
        lower = whole.translate(_TO_LOWER)
        fit = [r for i in self.candidates(set(TOKEN.findall(lower))) for r, p in [self.rules[i]] if p.match(whole if r.name else lower)]
        named = [r for r in fit if r.name]
        best = max(named or fit, key=lambda r: (len(r.name or r.pattern), r.action == "allow", r.pattern), default=None)
        return (best.name if best else None), (best.action if best else "allow")


def _judge(index_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of.value
        for batch in batches:
            parts = [parts_of(u) for u in batch.column("_url").to_pylist()]
            judged = [index.judge(*p) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(x, pa.string()) for x in ([p[0] for p in parts], [p[1] for p in parts], [j[0] for j in judged], [j[1] for j in judged]))],
                                             ["_id", "host", "path", "rule", "verdict"])
    return run


def token_counts(urls: DataFrame, url_col: str, wanted: list[str]) -> dict[str, int]:
    """In how many URLs each token that some rule uses occurs: one pass, at most one row for each such token."""
    tokens = urls.select(F.explode(F.array_distinct(F.split(F.translate(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                                            "[^a-z0-9]+"))).alias("token"))
    counted = tokens.filter(F.col("token").isin(wanted)).groupBy("token").count()
    return {r.token: r["count"] for r in counted.collect()}


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row: which listed rule decides, or else what the pattern rules say.

    Defined cases: a null URL or one without ``://`` has empty host and path and is allowed unless a rule without
    literal fits; rows that repeat are judged each; an empty table gives an empty one; other columns are not read.

    Scale: a URL is judged where it lies, no shuffle. The rule list is a parameter given by the caller, it does not
    grow with the pages; its index is broadcast. The counts that choose the index tokens have a row for each rule
    token at most.
    """
    wanted = sorted({t for r in rules for t in r.literals})
    index = RuleIndex(rules, token_counts(pages, url_col, wanted))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    schema = f"_id {dict(rows.dtypes)['_id']}, host string, path string, rule string, verdict string"
    return rows.mapInArrow(_judge(pages.sparkSession.sparkContext.broadcast(index)), schema).withColumnRenamed("_id", id_col)
