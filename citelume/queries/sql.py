"""DuckDB SQL for the text primitives, to build oracles from. Written apart from the Spark expressions."""

from __future__ import annotations

BL = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9\-+./]*"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{BL}]+|[{BL}]+$', '', 'g')"


def norm(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace(replace(replace({x}, chr(160), ' '), chr(8203), ''), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def match(x: str) -> str:
    return norm(rf"regexp_replace(lower({x}), '[^a-z0-9\-+{BL}]', ' ', 'g')")


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{TOKEN}'), lambda t: lower(t))"


def sentences(x: str) -> str:
    parts = f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])[{BL}]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"
    return f"CASE WHEN len({parts}) > 0 THEN {parts} ELSE [{strip(x)}] END"


def share(n: str, most: int) -> str:
    return f"(least({n}, {most}) / {float(most)})"


def either(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def found(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def has_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def n_hits(x: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(t)}) AS INT)" for t in terms) + ")"


def labels(x: str, terms) -> str:
    each = ", ".join(f"CASE WHEN {found(x, either(p))} THEN {q(n)} END" for n, p in terms)
    return f"list_sort(list_filter([{each}], lambda l: l IS NOT NULL))"


def clamp(x: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"greatest({low}, least({x}, {high}))"
