"""URL filters: host and path rules, then a weighted vocabulary found with an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binflow.llm.common import UPPER, without

#: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: One strict term rejects.
STRICT = ("bestiality", "hentai", "milf", "nsfw", "porn", "porno", "pornstar", "sexcam", "spam", "viagra", "xxx")
#: Several different soft terms reject.
SOFT = ("adult", "bet", "bonus", "casino", "cheap", "dating", "escort", "farm", "free", "gambling", "girls", "hot", "jackpot", "loan", "naked", "nude", "payday", "pills", "poker", "replica", "sex", "sexy", "slots", "x")
SOFT_LIMIT = 2


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: str, path: str, by_host: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """The longest rule (text, verdict) whose host is this one or above it and whose path begins this one."""
    best: tuple[str, str] | None = None
    parts = host.split(".")
    for i in range(len(parts)):
        above = ".".join(parts[i:])
        for start, verdict in by_host.get(above, ()):
            if path.startswith(start) and (best is None or len(above) + len(start) > len(best[0])):
                best = (above + start, verdict)
    return best


def term_hits(url: str, automaton: ahocorasick.Automaton) -> set[tuple[bool, str]]:
    """Terms of the automaton in a lower-cased URL with no letter or digit of a-z and 0-9 beside them."""
    inner = lambda c: "a" <= c <= "z" or "0" <= c <= "9"
    found = set()
    for end, (strict, term) in automaton.iter(url):
        start = end - len(term) + 1
        if (start == 0 or not inner(url[start - 1])) and (end + 1 == len(url) or not inner(url[end + 1])):
            found.add((strict, term))
    return found


def judge_urls(
    pages: DataFrame,
    url_col: str = "url",
    rules: tuple[tuple[str, str, str], ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``n_strict`` and ``n_soft``.

    The host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; the path goes on to ``?``, ``#`` or the end. The longest fitting
    rule decides. Otherwise the whole URL, A-Z lower-cased, is searched for all
    terms at once: a term counts where no letter or digit of a-z, 0-9 is beside
    it. One strict term, or ``soft_limit`` different soft ones, block; else the
    URL is allowed.

    A NULL URL, or one without ``://``, has an empty host and path; a NULL or
    empty URL holds no term and is allowed. A term in both lists is strict. Input
    columns of the six names are replaced, others pass through; equal rows get
    equal verdicts. An empty table gives an empty table. Rules and terms are
    parameters and travel with the function; there is no shuffle.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    terms = {t: False for t in soft} | {t: True for t in strict}
    lower = str.maketrans(UPPER, UPPER.lower())

    def judge(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term, is_strict in terms.items():
            automaton.add_word(term, (is_strict, term))
        if terms:
            automaton.make_automaton()
        for urls, hosts, paths in parts:
            rows = []
            for url, host, path in zip(urls, hosts, paths):
                rule = rule_for(host, path, by_host)
                hits = term_hits(url.translate(lower), automaton) if url and terms else set()
                n_strict = sum(1 for s, _ in hits if s)
                n_soft = len(hits) - n_strict
                own = "block" if n_strict or n_soft >= soft_limit else "allow"
                rows.append((rule[0] if rule else None, rule[1] if rule else own, n_strict, n_soft))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "n_strict", "n_soft"])

    run = F.pandas_udf(judge, "rule string, verdict string, n_strict long, n_soft long")
    rest = without(pages, "host", "path", "rule", "verdict", "n_strict", "n_soft")
    url = F.col(f"`{url_col}`")
    parsed = rest.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    return parsed.withColumn("_judged", run(url, "host", "path")).select(*parsed.columns, "_judged.*")


def oracle_sql() -> str:
    """DuckDB text of the query over ``pages`` with the default rules and terms."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    terms = ", ".join([f"('{t}', true)" for t in STRICT] + [f"('{t}', false)" for t in SOFT if t not in STRICT])
    return rf"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, translate(url, '{UPPER}', '{UPPER.lower()}') AS low
  FROM pages),
rules(rhost, rpath, verdict) AS (VALUES {values}), terms(term, strict) AS (VALUES {terms}),
r AS (
  SELECT page_id, url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM p) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, url),
t AS (
  SELECT page_id, url, count(*) FILTER (strict) AS n_strict, count(*) FILTER (NOT strict) AS n_soft
  FROM (SELECT DISTINCT page_id, url, low FROM p) JOIN terms ON regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')
  GROUP BY page_id, url)
SELECT p.page_id, p.host, p.path, r.rule,
  coalesce(r.verdict, CASE WHEN coalesce(n_strict, 0) >= 1 OR coalesce(n_soft, 0) >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN r ON r.page_id IS NOT DISTINCT FROM p.page_id AND r.url IS NOT DISTINCT FROM p.url
LEFT JOIN t ON t.page_id IS NOT DISTINCT FROM p.page_id AND t.url IS NOT DISTINCT FROM p.url
"""
