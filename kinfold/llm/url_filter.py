"""URL filter: host and path rules first, a weighted vocabulary found by Aho-Corasick for the rest.

A rule fits its host and every subdomain when the url's path starts with the rule's; the longest
rule wins. A url without a rule is blocked by one strict term or by distinct soft terms whose
weights reach a sum. A term counts only between boundaries: no ASCII letter or digit beside it.
"""

from __future__ import annotations

import pkgutil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Most terms of a vocabulary: the automaton is held by every worker (about 100 bytes a character).
MOST_TERMS = 1_000_000


def shipped_terms() -> list[tuple[str, str, float]]:
    """(term, kind, weight) of the package's own table, in several languages, as they are spelt in urls."""
    lines = pkgutil.get_data(__package__, "url_terms.tsv").decode().splitlines()[1:]
    return [(t, k, float(w)) for t, k, w in (line.split("\t") for line in lines)]


def read_terms(table: DataFrame) -> list[tuple[str, str, float]]:
    """The terms of a table (term, kind, weight), for a vocabulary of one's own.

    Kinds are strict (one blocks) and soft (weights add up). Rows with a null or an empty term go; a term
    that repeats counts once, with its largest weight. More than MOST_TERMS terms are an error.
    """
    rows = table.select(F.lower(F.trim("term")).alias("t"), "kind", F.col("weight").cast("double").alias("w")).where("t <> '' and kind in ('strict', 'soft')")
    got = rows.groupBy("t", "kind").agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("w")).orderBy("t", "kind").limit(MOST_TERMS + 1).collect()
    if len(got) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return [(r.t, r.kind, r.w) for r in got]


#: Sum of distinct soft weights that blocks.
SOFT_SUM = 2.0
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, soft_weight double"
ARROW = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("strict_hits", pa.int32()), ("soft_hits", pa.int32()), ("soft_weight", pa.float64())])


class Vocabulary:
    """The automaton over both kinds of terms (at most MOST_TERMS)."""

    def __init__(self, terms: list[tuple[str, str, float]]):
        import ahocorasick

        self.terms = ahocorasick.Automaton()
        strict, soft = {t for t, k, _ in terms if k == "strict"}, {t: w for t, k, w in terms if k == "soft"}
        for t in {*strict, *soft}:
            self.terms.add_word(t, (t, t in strict, soft.get(t, 0.0)))
        if len(self.terms):
            self.terms.make_automaton()

    def hits(self, url: str) -> tuple[set[str], dict[str, float]]:
        """Distinct strict terms and distinct soft terms with weights."""
        strict: set[str] = set()
        soft: dict[str, float] = {}
        if not len(self.terms):
            return strict, soft
        url, last = lower(url), len(url) - 1
        for end, (term, is_strict, weight) in self.terms.iter(url):
            if (end < last and inside(url[end + 1])) or ((start := end - len(term)) >= 0 and inside(url[start])):
                continue
            if is_strict:
                strict.add(term)
            if weight:
                soft[term] = weight
        return strict, soft


def inside(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


_LOWER = {i: i + 32 for i in range(65, 91)}


def lower(s: str) -> str:
    """A-Z only."""
    return s.translate(_LOWER)


def parts(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for null or where there is no ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    at, n = at + 3, len(url)
    cut = min((i for c in "?#" if (i := url.find(c, at)) >= 0), default=n)
    slash = url.find("/", at, cut)
    end = cut if slash < 0 else slash
    return lower(url[at:end]), url[end:cut]


class Rules:
    """Rules by host; looks a host and its parents up, so the cost doesn't grow with the number of rules."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))
        for of in self.by_host.values():
            of.sort(key=lambda r: -len(r[0]))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        at = host
        best: tuple[str | None, str | None] = (None, None)
        while at:
            for prefix, verdict in self.by_host.get(at, ()):
                if path.startswith(prefix):
                    if best[0] is None or len(at + prefix) > len(best[0]):
                        best = at + prefix, verdict
                    break
            at = at.partition(".")[2]
        return best


def filter_urls(pages: DataFrame, rules=RULES, terms: list[tuple[str, str, float]] | None = None, soft_sum: float = SOFT_SUM, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for every row of ``pages``: page_id, host, path, rule, verdict and the term counts.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is judged by
    its terms alone (none in a null). Null ids stay null, repeated rows stay. Only the id and the url
    are read; narrow, no shuffle. ``terms``: (term, kind, weight), as ``read_terms`` gives them; by default
    the package's own.
    """
    terms = shipped_terms() if terms is None else terms

    def make():
        found, words = Rules(rules), Vocabulary(terms)

        def run(ids, urls):
            out = []
            for i, url in zip(ids, urls, strict=True):
                host, path = parts(url)
                rule, verdict = found.find(host, path)
                hard, mild = words.hits(url or "")
                weight = sum(mild.values())
                out.append((i, host, path, rule, verdict or ("block" if hard or weight >= soft_sum else "allow"), len(hard), len(mild), weight))
            return list(zip(*out, strict=True)) or [[]] * 8

        return run

    return common.map_rows(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")), make, SCHEMA, ARROW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.read(spark, sf_dir, "pages"))


def _sql() -> str:
    bounded = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    terms = shipped_terms()
    strict = " + ".join(f"{bounded(t)}::int" for t, k, _ in terms if k == "strict")
    soft_n = " + ".join(f"{bounded(t)}::int" for t, k, _ in terms if k == "soft")
    soft_w = " + ".join(f"{bounded(t)}::int * {w}::double" for t, k, w in terms if k == "soft")
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    by_size = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in by_size)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in by_size)
    lower_sql = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with r as (select page_id, {lower_sql.format("coalesce(url, '')")} as low, case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as rest from pages),
p as (select page_id, low, {lower_sql.format("regexp_extract(rest, '^[^/]*')")} as host, regexp_extract(rest, '^[^/]*(.*)$', 1) as path from r),
c as (select *, ({strict})::int as strict_hits, ({soft_n})::int as soft_hits, ({soft_w})::double as soft_weight from p)
select page_id, host, path, case {rule} end as rule,
  case {verdict} when strict_hits > 0 or soft_weight >= {SOFT_SUM} then 'block' else 'allow' end as verdict, strict_hits, soft_hits, soft_weight from c
"""


SQL = _sql()
