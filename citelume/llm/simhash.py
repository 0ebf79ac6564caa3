"""Near-duplicates by SimHash: deletion-variant signatures, equality join, verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, give_back, mixed, raw, stored
from .graph import stars

SEED = 42
#: A key's fingerprints are compared in blocks of about so many.
BLOCK = 1024


def _fingerprint(words: list[bytes], shingle: int) -> int:
    n = len(words) - shingle + 1
    if not words:
        return 0
    parts = [b" ".join(words)] if n < 1 else [b" ".join(words[i : i + shingle]) for i in range(n)]
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for start in range(0, len(parts), 1 << 16):
        some = parts[start : start + (1 << 16)]
        h = np.fromiter((digest(p, SEED) for p in some), "<u8", len(some))
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(parts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, second: int | None = None) -> DataFrame:
    """(doc_id, fp, second): the 64-bit SimHash of each text's word shingles, repeats counted; 0 for a text without words.
    second: that of shingles of `second` words (0 if None).

    Words are of the ASCII lower-cased text. Shingles hash by XXH64 with seed 42; a text of fewer words is one shingle.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            words = [(t or b"").lower().split() for t in raw(b.column("text"))]
            fp = [_fingerprint(w, shingle) for w in words]
            more = [_fingerprint(w, second) if second else 0 for w in words]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64()), pa.array(more, pa.int64())], names=["doc_id", "fp", "second"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint, second bigint")


def _keys(fps: DataFrame, segments: int) -> DataFrame:
    """(key, id, fp, second): for each of 64 bits, the fingerprint's segment around it without it; the bit's number is part of the key."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    masks, lows = [], []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        for bit in range(lo, hi):
            mask = ((1 << hi) - (1 << lo)) & ~(1 << bit)
            masks.append(mask - (1 << 64) if mask >> 63 else mask)
            lows.append(lo)
    bits = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(m).cast("long").alias("m"), F.lit(lo).alias("lo")) for i, (m, lo) in enumerate(zip(masks, lows, strict=True))])
    each = fps.select("id", "fp", "second", F.explode(bits).alias("v"))
    # the bit's number lies above the segment's at most 33 bits
    return each.select(F.expr("shiftrightunsigned(fp & v.m, v.lo) | shiftleft(v.i, 40)").alias("key"), "id", "fp", "second")


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join as the given ones do, one fewer than the nodes of each component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _compare(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray, seconds: np.ndarray, most: int, second_most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids of equal key (sorted) whose fingerprints differ in at most `most` bits, the second ones in second_most."""
    found_a, found_b, at, d = [], [], np.arange(len(keys)), 1
    while True:
        at = at[at + d < len(keys)]
        at = at[keys[at + d] == keys[at]]
        if not len(at):
            break
        ok = at[np.bitwise_count((fps[at] ^ fps[at + d]).view(np.uint64)) <= most]
        if second_most < 64:
            ok = ok[np.bitwise_count((seconds[ok] ^ seconds[ok + d]).view(np.uint64)) <= second_most]
        found_a.append(ids[ok])
        found_b.append(ids[ok + d])
        d += 1
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(fps: DataFrame, most: int = 4, segments: int = 3, second_most: int = 64) -> DataFrame:
    """(a, b): ids of linked fingerprints, enough links to join all that differ in at most `most` bits.

    fps: id, fp and second, a row for each distinct pair of fp and second; second fingerprints must differ in at most
    second_most bits too. Of fewer segments than `most` + 1, one differs in at most one bit as long as most < 2 * segments;
    so two linked fingerprints share a one-wildcard variant of that segment. Each fingerprint has 64 keys; rows meet by key.
    Keys of over BLOCK rows are dealt out as pairs of blocks of about so many, so no task gets a whole hot key, and a task
    returns a spanning forest of what it finds, not all pairs of a group.
    """
    if most >= 2 * segments:
        raise ValueError("some pair within `most` bits would differ in two bits of every segment")
    keys = _keys(fps, segments)
    hot = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter(f"n > {BLOCK}"), "simhash-hot")
    many = hot.count()  # of BLOCK rows each at least
    if many:
        blocks = F.coalesce(F.ceil(F.col("n") / BLOCK).cast("int"), F.lit(1))
        dealt = keys.join(F.broadcast(hot) if many <= 100_000 else hot, "key", "left").withColumn("blocks", blocks).withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
        # a block meets every block once: pair (i, j), i <= j, gets the rows of i and of j
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        dealt = dealt.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(pair).alias("cell"), "id", "fp", "second")
    else:
        dealt = keys.select(F.col("key").alias("cell"), "id", "fp", "second")
    n = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(n, "cell").sortWithinPartitions("cell")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            rows = _forest(a, b)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])

        for batch in source:
            held = np.concatenate([held, [c.to_numpy(zero_copy_only=False) for c in batch.columns]], axis=1)
            if held.shape[1] < 1 << 18:
                continue
            whole = int(np.searchsorted(held[0], held[0, -1]))  # the last cell may go on
            yield out(*_compare(*held[:, :whole], most, second_most))
            held = held[:, whole:]
        yield out(*_compare(*held, most, second_most))
        del held
        give_back()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4, segments: int = 3, second: int | None = None, second_most: int = 64) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints link, directly or through others, share the smallest doc_id.

    second: words in the shingles of a second fingerprint, which linked documents must share but for second_most bits.
    Copies and equal fingerprints meet as one node. Nulls: a null text has no words and fingerprint 0, linked like any
    other; a null doc_id keeps its row and never becomes a component_id unless its component has no other. Repeated rows
    each keep their row. No documents give no rows; other columns are ignored.
    """
    signed = stored(fingerprints(docs, shingle, second), "simhash").withColumn("id", F.xxhash64("fp", "second") if second else F.col("fp"))
    nodes = stored(signed.groupBy("id", "fp", "second").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    joined = stars(links(nodes.select("id", "fp", "second"), most, segments, second_most))
    return signed.join(_smallest(nodes, joined), "id").select("doc_id", "fp", "component_id")


def _smallest(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """(id, component_id): the smallest node of each id's component. What is aggregated by label is stored, so that a hot
    label's rows can be split when they are joined to it."""
    labelled = stored(nodes.join(joined.withColumnRenamed("a", "id"), "id", "left").select("id", "node", F.coalesce("b", "id").alias("label")), "near-labels")
    smallest = stored(labelled.groupBy("label").agg(F.min("node").alias("component_id")), "near-smallest")
    return labelled.join(smallest, "label").select("id", "component_id")


#: For whole pipelines: texts alike by ALIKE (num, den) in their sets of WORDS_IN-word shingles are near-duplicates. Candidates
#: are near_duplicates' classes. For alike texts whose fingerprints lie further apart, also those that share one of BANDS keys of
#: ROWS minima each, as 99.7 % of pairs alike by 0.8 do by calculation, and more of those above.
ALIKE, WORDS_IN, BANDS, ROWS = (4, 5), 5, 32, 8
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def _shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct XXH64 of the text's shingles; a text of fewer words is one shingle, one without words has a 0."""
    words = (text or b"").lower().split()
    parts = {b" ".join(words[i : i + WORDS_IN]) for i in range(max(1, len(words) - WORDS_IN + 1))} if words else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), "<u8", len(parts))) if parts else np.zeros(1, "<u8")


def _minima(shingles: np.ndarray) -> np.ndarray:
    out, high = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(high), 512):
        np.minimum(out, (high[start : start + 512, None] * _TIMES + _PLUS).min(0), out=out)
    return out


def _band_keys(minima: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys of (texts, BANDS * ROWS) minima; the band's number is part of the key."""
    rows = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def _alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what is alike by ALIKE or more, directly or through others: pairs already joined aren't compared."""
    num, den = ALIKE
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    names, number = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    label, mark, out = np.arange(len(order)), np.zeros(len(names), np.int32), []
    for x in range(1, len(order)):
        lo = int(np.searchsorted(sizes, -(-num * sizes[x] // den)))  # smaller sets can't be alike enough
        own = number[starts[x] : starts[x] + sizes[x]]
        mark[own] = 1
        for first in (x - 1, lo):  # the nearest in size alone often joins all
            first = max(first, lo)
            if first >= x or not (label[first:x] != label[x]).any():
                continue
            both = np.add.reduceat(mark[number[starts[first] : starts[x]]], starts[first:x] - starts[first]).astype(np.int64)
            for y in (first + np.flatnonzero(den * both >= num * (sizes[first:x] + sizes[x] - both))).tolist():
                if label[y] != label[x]:
                    label[label == label[x]] = label[y]
                    out.append((order[y], order[x]))
        mark[own] = 0
    return out


def _verified(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): links between ids of one group whose texts are alike by ALIKE. members: id, group. texts: id, text.

    Only members' texts move, one of each id. Groups of over BLOCK members are dealt out as pairs of blocks, as in links().
    """
    few = members.count() <= 500_000
    own = texts.join(F.broadcast(members) if few else members, "id").groupBy("id", "group").agg(F.first("text").alias("text"))
    blocks = stored(members.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"), "alike-blocks")
    dealt = own.join(blocks, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cell = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))
    n = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.select(cell.alias("cell"), "id", "text").repartition(n, "cell").sortWithinPartitions("cell")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def out() -> pa.RecordBatch:
            rows = _alike(sets)
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in rows], pa.int64()), pa.array([ids[b] for _, b in rows], pa.int64())], names=["a", "b"])

        for batch in batches(source):
            for cell, i, text in zip(batch.column("cell").to_pylist(), batch.column("id").to_pylist(), raw(batch.column("text")), strict=True):
                if sets and cell != now:
                    yield out()
                    ids, sets = [], []
                now = cell
                ids.append(i)
                sets.append(_shingles(text))
        if sets:
            yield out()
        sets = []
        give_back()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def alike_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): documents whose texts are alike by ALIKE, directly or through others, share the smallest doc_id.

    Candidates are the classes of near_duplicates, and texts that share a band of MinHash keys for what lies beyond its bits;
    every link is confirmed by the exact likeness of the two sets of shingles. Equal texts meet as one id. Nulls as in
    near_duplicates: a null text is one without words, and those are alike.
    """
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("id", F.xxhash64("text"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            keys = _band_keys(np.stack([_minima(_shingles(t)) for t in raw(b.column("text"))]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("id"), lists], names=["doc_id", "id", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(plain.mapInArrow(run, f"doc_id {kind}, id bigint, keys array<bigint>"), "alike")
    keyed = signed.select("id", F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a <> last").select("key", "a"), "alike-keys")
    banded = keyed.join(shared, "key").select("a", F.col("id").alias("b"))
    classes = near_duplicates(plain.select(F.col("id").alias("doc_id"), "text"))
    grouped = stars(classes.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).unionByName(banded))
    members = grouped.select(F.col("a").alias("id"), F.col("b").alias("group")).unionByName(grouped.select(F.col("b").alias("id"), F.col("b").alias("group")).distinct())
    joined = stars(stored(_verified(plain.select("id", "text"), stored(members, "alike-members")), "alike-links"))
    nodes = signed.groupBy("id").agg(F.min("doc_id").alias("node"))
    return signed.select("doc_id", "id").join(_smallest(nodes, joined), "id").select("doc_id", "component_id")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near-duplicates by alike_documents: that of the smallest doc_id.

    Rows of equal doc_id are one document: one of them stays. Rows of a null doc_id stay, as nothing names them.
    """
    found = alike_documents(docs)
    rest = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    gone = stored(rest.filter("doc_id <> component_id or rows > 1"), "simhash-gone")
    kept = docs.join(gone.filter("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti")
    again = gone.filter("doc_id = component_id and rows > 1").select("doc_id")
    columns = [f"`{c}`" for c in docs.columns]
    if again.isEmpty():
        return kept.select(columns)
    one = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").unionByName(one).select(columns)


def query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
