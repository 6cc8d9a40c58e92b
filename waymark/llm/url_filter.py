"""URL filter with rules on host and path and a weighted vocabulary.

A rule names a host (with all its subdomains) and the start of a path, and
allows or blocks; the longest rule that fits decides. Other urls are judged by
their words: an Aho-Corasick automaton finds all terms of the vocabulary in one
pass over the lower-cased url, matches count where no letter or digit adjoins,
and a url is blocked for one strict term or for several distinct soft ones.

The vocabulary is a parameter: two lists, or a table (term, kind). It is carried
to the executors with the plan, and :func:`vocabulary_of` refuses a table beyond
a stated number of terms.

Edge cases: a null or empty url, or one without ``://``, has empty host and path;
no rule fits an empty host; a null url has no terms and is allowed; urls of any
length are read in one pass; of rules of equal length that fit, the last by text
decides; a term that stands in both lists is strict; repeated rows get equal
verdicts; an empty table gives an empty one. Input columns that bear the name of
a result are replaced, all others pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDGE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern``: a host, a slash and the rest of the path's start."""

    pattern: str
    allow: bool

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


RULES = (
    Rule("org/", True),
    Rule("example.org/es/", False),
    Rule("example.org/en/1", False),
    Rule("com/fr/", True),
    Rule("com/de/", False),
)


@dataclass(frozen=True)
class Vocabulary:
    """Terms of letters and digits: one strict term blocks, or ``enough`` distinct soft ones."""

    strict: tuple[str, ...] = (
        "porn", "porno", "pornography", "xxx", "xvideos", "hentai", "camgirl", "camgirls", "camsex", "sexcam", "sexcams", "milf",
        "nudes", "escort", "escorts", "casino", "kasino", "betting", "sportsbook", "jackpot", "slots", "roulette",
        "viagra", "cialis", "levitra", "xanax", "tramadol", "warez", "keygen", "serialz", "crackz", "phishing", "malware",
    )
    soft: tuple[str, ...] = (
        "adult", "sex", "sexy", "nude", "naked", "hot", "dating", "singles", "hookup", "webcam", "cams", "poker", "bingo", "lotto",
        "lottery", "bet", "bets", "odds", "gambling", "spam", "farm", "free", "win", "winner", "prize", "bonus", "promo", "coupon",
        "cheap", "discount", "deal", "deals", "sale", "buy", "order", "loan", "loans", "credit", "payday", "forex", "crypto",
        "pills", "pharmacy", "drugs", "diet", "slim", "torrent", "crack", "hack", "cheats", "download", "clickbait", "popup",
        "traffic", "seo", "backlinks", "replica", "earn", "rich", "casinobonus",
    )
    enough: int = 2


def vocabulary_of(rows: DataFrame, enough: int = 2, most: int = 200_000) -> Vocabulary:
    """The vocabulary of a table (term, kind), kind being strict or soft; an error beyond ``most`` terms."""
    terms = rows.where("term IS NOT NULL AND term <> ''").select(F.translate("term", _UPPER, _LOWER).alias("term"), "kind").distinct()
    found = terms.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} terms")
    if bad := [r.term for r in found if r.kind not in ("strict", "soft") or not set(r.term) <= _EDGE]:
        raise ValueError(f"terms of another kind, or of other characters than letters and digits: {sorted(bad)[:5]}")
    return Vocabulary(*[tuple(sorted(r.term for r in found if r.kind == kind)) for kind in ("strict", "soft")], enough)


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?`` or ``#``, with A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to the next ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The longest rule that fits, as struct<pattern, allow>; null if none does."""
    chosen = F.lit(None).cast("struct<pattern:string,allow:boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.allow).alias("allow"))).otherwise(chosen)
    return chosen


def term_hits(urls: DataFrame, vocabulary: Vocabulary, url: str = "url") -> DataFrame:
    """``urls`` with ``strict_hits`` (all occurrences) and ``soft_terms`` (distinct terms), both long."""
    kept = [c for c in urls.columns if c not in ("strict_hits", "soft_terms")]
    at = kept.index(url)
    table = str.maketrans(_UPPER, _LOWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        # A term in both lists counts as strict.
        strict_terms = frozenset(vocabulary.strict)
        for term in (*vocabulary.soft, *vocabulary.strict):
            finder.add_word(term, (term, term in strict_terms))
        finder.make_automaton()
        edge = _EDGE
        for batch in batches:
            strict, soft = [], []
            for value in batch.column(at).to_pylist():
                text = (value or "").translate(table)
                hits, found = 0, set()
                for end, (term, is_strict) in finder.iter(text):
                    start = end - len(term)
                    if start >= 0 and text[start] in edge or end + 1 < len(text) and text[end + 1] in edge:
                        continue
                    if is_strict:
                        hits += 1
                    else:
                        found.add(term)
                strict.append(hits)
                soft.append(len(found))
            counts = [pa.array(strict, pa.int64()), pa.array(soft, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts], [*kept, "strict_hits", "soft_terms"])

    rows = urls.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, strict_hits long, soft_terms long")


def judged(urls: DataFrame, rules: Iterable[Rule] = RULES, vocabulary: Vocabulary = Vocabulary(), url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule, verdict, strict_hits and soft_terms."""
    found = term_hits(urls.drop("host", "path", "rule", "verdict"), vocabulary, url)
    split = found.withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))})
    chosen = fitting_rule(F.col("host"), F.col("path"), rules)
    blocked = (F.col("strict_hits") > 0) | (F.col("soft_terms") >= vocabulary.enough)
    allow = F.coalesce(chosen["allow"], ~blocked)
    return split.withColumns({"rule": chosen["pattern"], "verdict": F.when(allow, F.lit("allow")).otherwise(F.lit("block"))})
