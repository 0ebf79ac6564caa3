"""Text primitives as Column functions. Blanks are Unicode's, as one class that every regex engine reads alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The inside of a class of all blanks.
BLANKS = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANK = f"[{BLANKS}]"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9\-+./]*"
#: Line ends, a carriage return and newline together being one.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def normalized(c: Column) -> Column:
    """Blanks and tabs squeezed to one, three newlines or more to two, no zero-width space, ends stripped."""
    c = F.translate(F.translate(c, " ", " "), "​", "")
    return stripped(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


#: The inside of a class of all characters but a-z, digits, blanks, - and +, from U+0002 on. Java finds what is in a class like this
#: ten times as fast as what isn't in the opposite one.
_REST = r"\x02-\x08\x0E-\x1B!-*,./:-`{-\x84\x86-\x9F\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}"


def matchable(c: Column) -> Column:
    """Lower case with nothing but a-z, digits, blanks, - and +."""
    return normalized(F.regexp_replace(F.lower(c), rf"[\x00\x01{_REST}]", " "))


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN))


def lexical_tokens(c: Column) -> Column:
    """Lower-cased tokens, repeats kept."""
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.lower)


def sentences(c: Column) -> Column:
    """Cut at blanks after . ! ? and before A-Z or a digit; never an empty array."""
    parts = F.filter(F.transform(F.split(c, rf"(?<=[.!?]){BLANK}+(?=[A-Z0-9])", -1), stripped), lambda s: s != "")
    return let(parts, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(stripped(c))))


_SENTENCE_END = rf"(?<=[.!?]){BLANK}+(?=[A-Z0-9])"


def sentence_count(c: Column) -> Column:
    """How many sentences() there are; they needn't be cut for that, as none is empty."""
    return F.regexp_count(c, F.lit(_SENTENCE_END)) + 1


def matchable_sentences(c: Column) -> Column:
    """matchable() of each sentence, but for blanks at its ends: the text is made matchable as a whole, with a mark between
    sentences."""
    marked = F.regexp_replace(F.translate(c, "\x01", " "), _SENTENCE_END, "\x01")
    return F.split(normalized(F.regexp_replace(F.lower(marked), rf"[\x00{_REST}]", " ")), "\x01", -1)


def truncated(c: Column, limit: int = 240) -> Column:
    short = lambda n: F.concat(F.regexp_replace(F.substring(n, 1, limit - 3), f"{BLANK}+$", ""), F.lit("..."))
    return let(normalized(c), lambda n: F.when(F.length(n) > limit, short(n)).otherwise(n))


def words(c: Column) -> Column:
    """What stands between blanks."""
    return F.regexp_extract_all(c, F.lit(f"[^{BLANKS}]+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{BLANKS}]+"))


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def page_list(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def stable_id(path: Column) -> Column:
    """The first 16 hex digits of the lower-cased path's SHA-1."""
    return F.substring(F.sha1(F.encode(F.lower(path), "UTF-8")), 1, 16)


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def hits(c: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms are contained."""
    total: Column = F.lit(0)
    for t in terms:
        total = total + c.contains(t).cast("int")
    return total


def contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    found: Column = F.lit(False)
    for t in terms:
        found = found | c.contains(t)
    return found


def any_of(patterns: tuple[str, ...]) -> str:
    """One pattern for several."""
    return "|".join(f"(?:{p})" for p in patterns)
