"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores."""

from __future__ import annotations

import ipaddress
import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, raw

#: Kinds whose spans are kept whatever their score, in order; then those that need THRESHOLD.
BASE, MORE = ("email", "ip", "card", "phone"), ("iban", "local_phone", "short_card", "ssn", "ipv6", "login", "secret")
#: Least score of an added span; characters on each side in which whole context words count.
THRESHOLD, NEAR = 0.6, 48
#: What a span's score begins with, and what is added where its check passes: by how rarely the check passes by chance.
PROPOSED, CHECKED = 0.3, {"none": 0.0, "luhn": 0.2, "mod97": 0.35, "format": 0.35}
#: Least bits a character, by the characters' own frequencies, of a secret.
ENTROPY = 3.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a failed run of digits fails from its middle too, so only its start is tried
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:.])")
_LOGIN = re.compile(r"(?<=://)[^\s/:@]{1,64}:[^\s/@]{1,128}(?=@)")
# what issuers' formats say without a context, and any long run that may be a key or token
_ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*|-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)")
_RUN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}={0,2}(?![A-Za-z0-9_+/=-])")
# fixed values: words that raise a kind's score nearby, and words that lower any
CONTEXT = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "local_phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "teléfono", "téléphone"),
    "short_card": ("card", "amex", "visa", "credit", "debit", "karte", "carte", "tarjeta"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "auth", "authorization", "bearer", "credential", "credentials", "access_key", "secret_key", "access_token"),
}
AGAINST = ("isbn", "issn", "order", "invoice", "serial", "sku", "version")
_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    """The check of card numbers: from the right every second digit is doubled and its digits summed."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of account numbers: rotated by four, letters as 10 to 35, the remainder by 97 is 1."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @ outwards in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as in BASE, then start: leftmost matches that don't overlap; those that fail their check go."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15] if "+" in text else []
    return out


def entropy(run: str) -> float:
    """Bits a character."""
    return sum(-n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())


def _score(kind: str, text: str, start: int, end: int, check: str) -> float:
    """The score of a span from its check and the words near it. Words that the window cuts don't count."""
    a, b = max(0, start - NEAR), min(len(text), end + NEAR)
    near = {m[0].lower() for m in _WORD.finditer(text, a, start) if m.start() > a or not a or not (text[a - 1].isalnum() or text[a - 1] == "_")}
    near |= {m[0].lower() for m in _WORD.finditer(text, end, b) if m.end() < b or b == len(text) or not (text[b].isalnum() or text[b] == "_")}
    return PROPOSED + CHECKED[check] + 0.35 * any(w in near for w in CONTEXT.get(kind, ())) - 0.3 * any(w in near for w in AGAINST)


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """Spans of the kinds in MORE that reach THRESHOLD and don't overlap base spans or each other."""
    found: list[tuple[str, int, int, str]] = []
    found += [("iban", *m.span(), "mod97") for m in _IBAN.finditer(text) if mod97(m[0].replace(" ", ""))]
    found += [("local_phone", *m.span(), "none") for m in _LOCAL_PHONE.finditer(text)]
    found += [("short_card", *m.span(), "luhn") for m in _CARD.finditer(text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 15 and luhn(d) and d[0] in "3456"]
    found += [("ssn", *m.span(), "none") for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"]
    found += [("ipv6", *m.span(), "format") for m in _IPV6.finditer(text) if _is_ipv6(m[0])]
    found += [("login", *m.span(), "format") for m in _LOGIN.finditer(text)]
    found += [("secret", *m.span(), "format") for m in _ISSUED.finditer(text)]
    found += [("secret", *m.span(), "none") for m in _RUN.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and entropy(m[0]) >= ENTROPY]
    # taken spans, joined where they overlap, by start
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out = []
    for kind, a, b, check in found:
        at = bisect_left(taken, (a, a))
        if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
            continue
        if (score := _score(kind, text, a, b, check)) >= THRESHOLD:
            insort(taken, (a, b))
            out.append((kind, a, b, score))
    return sorted(out, key=lambda x: (MORE.index(x[0]), x[1]))


def _is_ipv6(run: str) -> bool:
    try:
        return ipaddress.IPv6Address(run).is_global
    except ValueError:
        return False


_DIGIT = re.compile(rb"[0-9@]|PRIVATE KEY")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): each whole text's personal data as an array of (kind, start, end, score), by kind as in BASE and
    MORE, then start; code points, end exclusive. Base spans have score 1.

    Nulls: a null text is empty and has no spans; a null doc_id stays. Repeated rows keep their rows. No documents give no
    rows. Other columns are ignored.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches(source):
            rows = []
            for content in raw(b.column("text")):
                spans: list[dict] = []
                if content and _DIGIT.search(content):  # every kind holds a digit or an @, or is a key's first line
                    text = content.decode("utf-8", "replace")
                    base = base_spans(text)
                    spans = [{"kind": k, "start": a, "end": e, "score": 1.0} for k, a, e in base]
                    spans += [{"kind": k, "start": a, "end": e, "score": s} for k, a, e, s in added_spans(text, base)]
                rows.append(spans)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def query(docs: DataFrame) -> DataFrame:
    found = personal_data(docs)
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
