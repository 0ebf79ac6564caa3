"""Benchmark decontamination: an FM-index per shard of training text, searched for the benchmark's windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, mixed, raw, sieved, stored
from .fmindex import FMIndex

WINDOW = 13
#: Most symbols in one index, and about how many UTF-8 bytes of benchmark text are searched for at once (one broadcast): at
#: 8 MB a task's tables of phrases take some 150 MB.
SHARD, BLOCK_BYTES = 1 << 20, 8 << 20
#: To lower case; everything but digits, letters and non-ASCII becomes a blank.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    r"""Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the ASCII lower-cased text."""
    return (text or b"").translate(_CLEAN).split()


class Phrases:
    """Windows of `window` consecutive words of each item; a shorter item, if it has words, is one window.

    Words are numbers from 2 on. Windows are kept as places in the items' joined words; equal ones are one, with all owners.
    """

    def __init__(self, items: list[tuple[str, bytes | None]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number, parts, starts, owners, lengths, at = self.vocabulary, [], [], [], [], 0
        self.names = [name for name, _ in items]
        for i, (_, text) in enumerate(items):
            found = words(text)
            parts.append(np.fromiter((number.setdefault(w, len(number) + 2) for w in found), np.int32, len(found)))
            n = max(1, len(found) - window + 1) if found else 0
            starts.append(np.arange(at, at + n))
            owners.append(np.full(n, i, np.int32))
            lengths.append(np.full(n, min(window, len(found)), np.int32))
            at += len(found)
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
        self.words = join(parts, np.int32)
        start, owner, length = join(starts, np.int64), join(owners, np.int32), join(lengths, np.int32)
        #: For each length: starts of distinct windows, and their owners: those of window w are owner[edge[w] : edge[w + 1]].
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            key = np.zeros(len(mine), np.uint64)
            for j in range(n):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + self.words[start[mine] + j].astype(np.uint64))
            mine = mine[np.argsort(key, kind="stable")]
            new = np.zeros(len(mine), bool)
            new[0] = True
            for j in range(n):  # equal by their words, not by the hash
                column = self.words[start[mine] + j]
                new[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(new)
            self.groups.append((n, start[mine[first]], np.append(first, len(mine)), owner[mine]))
        self.least, self.most = (self.groups[0][0], self.groups[-1][0]) if self.groups else (1, 1)


def _runs(ids: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Stretches of known words long enough for a window. Unknown words, which no window holds, end one."""
    known = np.concatenate([[False], ids > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= least:
            yield a, b


def _shards(docs: list[np.ndarray], p: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, document of each, word position of each) of all runs, cut to SHARD symbols with an overlap of a window."""
    parts: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*[(np.append(s, 1), np.full(len(s) + 1, d), np.arange(a, a + len(s) + 1)) for s, d, a in parts], strict=True))

    for d, ids in enumerate(docs):
        for start, end in _runs(ids, p.least):
            for a in range(start, max(start + 1, end - p.most + 1), SHARD):
                part = ids[a : min(end, a + SHARD + p.most - 1)]
                parts.append((part, d, a))
                size += len(part) + 1
                if size >= SHARD:
                    yield joined()
                    parts, size = [], 0
    if parts:
        yield joined()


def _search(docs: list[np.ndarray], p: Phrases) -> tuple[list[np.ndarray], list[set[str]]]:
    """For each document a mark per word that is inside an occurrence, and the items whose windows occur."""
    steps = [np.zeros(len(ids) + 1, np.int32) for ids in docs]
    items: list[set[str]] = [set() for _ in docs]
    for symbols, doc, position in _shards(docs, p):
        index = FMIndex(symbols)
        here = np.zeros(len(p.vocabulary) + 2, bool)
        here[symbols] = True
        absent = np.concatenate([[0], np.cumsum(~here[p.words])])  # a window with a word that the shard lacks isn't looked for
        for n, starts, edges, owners in p.groups:
            asked = np.flatnonzero(absent[starts + n] == absent[starts])
            lo, hi = index.search(p.words, starts[asked], n)
            count = hi - lo
            which = np.repeat(np.arange(len(asked)), count)
            if not len(which):
                continue
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
            at = index.locate(rows)
            for d, a, w in set(zip(doc[at].tolist(), position[at].tolist(), asked[which].tolist(), strict=True)):
                steps[d][a] += 1
                steps[d][a + n] -= 1
                items[d].update(p.names[o] for o in owners[edges[w] : edges[w + 1]].tolist())
    return [np.cumsum(s[:-1]) > 0 for s in steps], items


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_SPANS = "array<struct<start:bigint,end:bigint>>"


def _found(text: pa.Array, p: Phrases) -> tuple[list[int], list[np.ndarray], list[set[str]]]:
    lookup = p.vocabulary.get
    ids = [np.fromiter((lookup(w, 0) for w in ws), np.int64, len(ws)) for ws in map(words, raw(text))]
    return [len(x) for x in ids], *_search(ids, p)


def _find(docs: DataFrame, items: list[tuple[str, bytes | None]], window: int, all_rows: bool = True) -> DataFrame:
    """The columns of docs but text, with n_words, spans and items; all rows, or those with a span."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Phrases(sent.value, window)
        for b in batches(source):
            n, hits, found = _found(b.column("text"), p)
            out = {"n_words": pa.array(n, pa.int64()), "spans": pa.array([[{"start": a, "end": e} for a, e in _spans(h)] for h in hits], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "items": pa.array([sorted(x) for x in found], pa.list_(pa.string()))}
            columns = [c for c in b.schema.names if c != "text"]
            rows = pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *out.values()], names=[*columns, *out])
            yield rows if all_rows else rows.filter(pa.array([bool(h.any()) for h in hits], pa.bool_()))

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kept}, n_words bigint, spans {_SPANS}, items array<string>")


def _benchmark(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The benchmark's (item, text) and the number of blocks that hold about block_bytes of text each."""
    sized = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return sized, -(-total // block_bytes) or 1


def _items(sized: DataFrame, k: int, blocks: int) -> list[tuple[str, bytes | None]]:
    some = sized if blocks == 1 else sized.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
    return [(r["item"], (r["text"] or "").encode()) for r in some.collect()]


def _united(rows: DataFrame, sized: DataFrame, blocks: int, window: int) -> DataFrame:
    """(row, doc_id, n_words, spans, items) of rows (row, doc_id, text) over all blocks of the benchmark.

    A pass over the texts for each block, each in tasks of its own, so memory is that of one block. The first gives all
    rows, the others those with a span."""
    every = _find(rows, _items(sized, 0, blocks), window)
    for k in range(1, blocks):
        every = every.unionByName(_find(rows, _items(sized, k, blocks), window, False))
    whole = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.expr("""aggregate(spans, filter(spans, s -> false), (done, s) -> if(size(done) > 0 and element_at(done, -1).end >= s.start,
        concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end)))), concat(done, array(s))))""")
    return whole.withColumn("spans", merged)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items): word spans [start, end) of each whole text inside occurrences of the benchmark's
    windows, merged where they touch or overlap, and the ids (as strings, sorted) of items that occur.

    The benchmark is searched for in blocks of about block_bytes of text (or one item), each broadcast. With one block
    shards are indexed where the documents are and no text moves; with several, rows are numbered and stored once, and what
    is found in each block is united by row. Words that no window holds end a run of text, and runs shorter than every
    window are left out of the index, which loses nothing.

    Nulls: a null text has no words, no spans and no items; a null item text has no window; a null item_id counts as the
    text `null`. Repeated rows keep their rows. An empty benchmark gives no spans. Other columns of docs are ignored.
    """
    sized, blocks = _benchmark(benchmark, block_bytes)
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if blocks == 1:
        return _find(plain, _items(sized, 0, 1), window)
    rows = stored(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
    return _united(rows, sized, blocks, window).select("doc_id", "n_words", "spans", "items")


def n_hit() -> F.Column:
    return F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")


def is_contaminated() -> F.Column:
    """At least a twentieth of the words lie inside occurrences."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> DataFrame:
    """docs without contaminated ones, in the columns they came with, whatever their names. Words hit by any block count, as in
    contamination(): with several blocks rows are numbered and stored, and those that go are found by number."""
    sized, blocks = _benchmark(benchmark, block_bytes)
    if blocks > 1:
        whole = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")), "numbered")
        plain = whole.select("row", F.col("document.doc_id").alias("doc_id"), F.col("document.text").cast("string").alias("text"))
        gone = _united(plain, sized, blocks, window).filter(is_contaminated()).select("row")
        return whole.join(gone, "row", "left_anti").select("document.*")
    sent = docs.sparkSession.sparkContext.broadcast(_items(sized, 0, 1))

    def make() -> Callable[[pa.Array], list[bool]]:
        p = Phrases(sent.value, window)
        return lambda texts: [not (h.any() and 20 * h.sum() >= len(h)) for h in _found(texts, p)[1]]

    return sieved(docs, make)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same in SQL: windows as joined words, matched by equality.
SQL = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_SQL_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, l, array_to_string(ws[k : k + l - 1], ' ') AS w FROM (SELECT item, ws, least(len(ws), {WINDOW}) AS l, unnest(range(1, CASE WHEN len(ws) > 0 THEN greatest(len(ws) - {WINDOW}, 0) + 2 ELSE 1 END)) AS k FROM b)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS ws FROM documents),
p AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k, len(ws) AS n FROM d),
dw AS (SELECT r, l, k, n, string_agg(w, ' ') OVER (PARTITION BY r, l ORDER BY k ROWS BETWEEN CURRENT ROW AND l - 1 FOLLOWING) AS w FROM p, (SELECT DISTINCT l FROM bw)),
hit AS (SELECT r, k, dw.l AS l, item FROM dw JOIN bw ON dw.w = bw.w AND dw.l = bw.l WHERE k + dw.l - 1 <= n),
covered AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + l)) FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN covered ON covered.r = d.r LEFT JOIN named ON named.r = d.r
"""
