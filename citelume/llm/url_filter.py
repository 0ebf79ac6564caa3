"""URL filter: rules by host and path, else a weighted vocabulary searched by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

# fixed values: rules (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
# fixed values: strict terms, one of which rejects
STRICT = """adult adultfriend anal bdsm blowjob bukkake camgirl camgirls casino casinos cialis cumshot erotic erotica escort escorts fetish gambling hardcore hentai
incest keygen levitra malware milf nude nudes orgy phishing porn porno pornography pornstar ransomware sex sexcam sexcams sexy slut spam stripper threesome torrentz
tramadol viagra voyeur warez webcamsex whore xanax xxx""".split()
# fixed values: soft terms, whose weights add up
SOFT = """ads affiliate baccarat bet bets betting bingo bonus cheap click clickbait coupon crack cracked deal deals discount doubleclick downloadfree earn farm free freebies
giveaway goldfarm hookup jackpot keto linkfarm loan loans lottery lotto miracle moneyfast payday pill pills pokies poker popunder popup popups prize replica roulette singles
slots sportsbook sweepstakes track tracker tracking weightloss win winner winners""".split()
#: The vocabulary: (term, kind, weight). Terms are lower case. A soft term counts once a URL, by its weight.
VOCABULARY = tuple((t, "strict", 1.0) for t in STRICT) + tuple((t, "soft", 1.0) for t in SOFT)
#: Weight of distinct soft terms that rejects.
SOFT_WEIGHT = 2.0
#: Most terms that are sent to the tasks.
MOST_TERMS = 1_000_000


def load_vocabulary(table: DataFrame) -> tuple[tuple[str, str, float], ...]:
    """The vocabulary of a table (term, kind, weight): kind is strict or soft, a null weight is 1. Terms are lower-cased; the
    highest weight of a repeated term counts, and strict goes before soft. Raises ValueError on more than MOST_TERMS rows."""
    rows = table.select(F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "kind", F.coalesce(F.col("weight").cast("double"), F.lit(1.0))).filter("term is not null and term <> ''").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    best: dict[str, tuple[str, float]] = {}
    for term, kind, weight in rows:
        if kind not in ("strict", "soft"):
            raise ValueError(f"{term}: neither strict nor soft, but {kind}")
        have = best.get(term)
        if have is None or (kind, weight) > (have[0], have[1]):
            best[term] = (kind, weight)
    return tuple((term, *x) for term, x in sorted(best.items()))


def parts(url: str | None) -> tuple[str, str]:
    """(host, path): the host after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path after it up to
    `?`, `#` or the end. Without `://` both are empty."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host = rest[: end if slash < 0 else slash]
    return host.translate(_LOWER), "" if slash < 0 else rest[slash:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


class Rules:
    """The longest rule (host and path together) that fits a URL, found by the host's suffixes from the longest."""

    def __init__(self, rules: tuple[tuple[str, str, str], ...]) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, str | None, str | None] = (-1, None, None)
        while host:
            for start, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and len(host) + len(start) > best[0]:
                    best = (len(host) + len(start), host + start, verdict)
            host = host.partition(".")[2]
        return best[1], best[2]


def automaton(vocabulary: Iterable[tuple[str, str, float]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, kind, weight in vocabulary:
        found.add_word(term, (kind, term, weight))
    if len(found):
        found.make_automaton()
    return found


def hits(found, url: str) -> dict[str, tuple[str, float]]:
    """The distinct terms, with kind and weight, that stand in the lower-cased URL without an ASCII letter or digit beside them."""
    out: dict[str, tuple[str, float]] = {}
    low = url.translate(_LOWER)
    inner = "abcdefghijklmnopqrstuvwxyz0123456789"
    for end, (kind, term, weight) in found.iter(low) if len(found) else ():
        start = end - len(term) + 1
        if (start == 0 or low[start - 1] not in inner) and (end + 1 == len(low) or low[end + 1] not in inner):
            out[term] = (kind, weight)
    return out


def judge(pages: DataFrame, rules: tuple = RULES, vocabulary: Iterable[tuple[str, str, float]] = VOCABULARY, soft_weight: float = SOFT_WEIGHT) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight, terms) of each page's URL.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest decides. Without one, a
    strict term or distinct soft terms whose weights reach soft_weight block. vocabulary: (term, kind, weight), as
    load_vocabulary gives; one automaton finds all terms in one pass over a URL, however many they are.

    Nulls: a null URL has an empty host and path, no rule and no terms, and is allowed; a null page_id stays. Repeated
    rows keep their rows. No pages give no rows, no terms find nothing. Other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(tuple(vocabulary))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, by_rule = automaton(sent.value), Rules(rules)
        for b in batches(source):
            rows = []
            for url in b.column("url").to_pylist():
                host, path = parts(url)
                rule, verdict = by_rule.find(host, path)
                found = hits(terms, url or "")
                soft = [w for kind, w in found.values() if kind == "soft"]
                strict, heft = len(found) - len(soft), float(sum(soft))
                rows.append((host, path, rule, verdict or ("block" if strict or heft >= soft_weight else "allow"), strict, len(soft), heft, ",".join(sorted(found))))
            columns = zip(*rows, strict=True) if rows else [()] * 8
            kinds = (*[pa.string()] * 4, pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight", "terms"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, n_strict bigint, n_soft bigint, soft_weight double, terms string")


def query(pages: DataFrame) -> DataFrame:
    return judge(pages)


def _sql() -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    terms = ", ".join(f"('{t}', '{k}', {w})" for t, k, w in VOCABULARY)
    return rf"""
WITH rules(says, rh, rp) AS (VALUES {values}), vocabulary(term, kind, weight) AS (VALUES {terms}),
u AS (SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
             regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\n', ' ', 'g') AS low FROM pages),
h AS (SELECT n, count(*) FILTER (WHERE kind = 'strict') AS n_strict, count(*) FILTER (WHERE kind = 'soft') AS n_soft, coalesce(sum(weight) FILTER (WHERE kind = 'soft'), 0) AS soft_weight, string_agg(term, ',' ORDER BY term) AS terms
      FROM u JOIN vocabulary ON contains(low, term) AND regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY n),
p AS (SELECT u.*, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path, coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, CAST(coalesce(soft_weight, 0) AS DOUBLE) AS soft_weight, coalesce(terms, '') AS terms FROM u LEFT JOIN h ON u.n = h.n),
r AS (SELECT p.*, (SELECT max_by(struct_pack(rule := rh || rp, says := says), length(rh || rp)) FROM rules
                   WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM p)
SELECT page_id, host, coalesce(path, '') AS path, best.rule AS rule,
       coalesce(best.says, CASE WHEN n_strict > 0 OR soft_weight >= {SOFT_WEIGHT} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n_strict AS BIGINT) AS n_strict, CAST(n_soft AS BIGINT) AS n_soft, soft_weight, terms FROM r
"""


#: The same in SQL, a regular expression for each term in place of the automaton.
SQL = _sql()
