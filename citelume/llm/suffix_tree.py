"""LM scoring by a probabilistic suffix tree over words.

States are contexts of up to DEPTH words. A context is kept if, with its words held back one at a time, its own next-word
distribution predicts better than its suffix's does (a divergence test), and only if its suffix was kept. A word's
probability comes from the longest kept suffix of what stands before it, smoothed by absolute discounting towards the state
below; at the root stands the add-one unigram.

Counts are never gathered in one place. Documents are encoded into blocks of some megabytes, which are stored by block and
stay there; what moves are requests and answers, a row for each block and hash bucket (not for each word):

* words: a block's distinct words go to the owners of their hashes and come back with corpus-wide counts and numbers;
* pairs: all contexts of one word with their next words. Deeper contexts of over HOT occurrences follow, depth by depth,
  as long as there are any. Next words of a hot context are dealt out over all owners; its test is then made from sums;
* windows: for contexts that aren't hot, the words before and after go to the owner of the shortest context not yet known,
  which tests and smooths all depths above it at once. Windows are left out, or cut, where counts of pairs show that no
  longer context can occur twice.

Whether a context is hot changes who tests it, not the outcome. The model and what is gathered for it grow with the corpus.
The driver sees two totals and a row for each kept hot context, of which there are at most tokens / HOT a depth.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, forget_shuffles, mixed, named, release, scratch, stored

#: Longest context; least count of a context (one seen once has nothing to hold back); absolute discount; least gain in nats.
DEPTH, CONTEXT, DISCOUNT, GAIN = 4, 2, 0.75, 5.0
#: Bytes of text in a block (one document at least), and of text for each bucket.
BLOCK, BUCKET = 8 << 20, 16 << 20
#: A context of more occurrences than this has no single owner.
HOT = 1 << 20
#: In the test the logarithm of the state below is rounded to so many steps a nat.
STEPS = 4
#: Bytes a plane, on average, from which planes are compressed apart.
APART = 1024
#: Documents whose crc32 of the id's text has this remainder by 7 are held out.
HELD = 2
#: Numbers of next words: known to occur once, in training; not in training. Words have numbers from 2 on; 0 is also no word.
ONCE, UNKNOWN = 0, 1
_ROWS = "block bigint, bucket int, payload binary"
_KINDS = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<u8", 12: "<f4", 16: "<f8"}
_CODES = {np.dtype(k): c for c, k in _KINDS.items()}
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes of equal weight side by side. Long ones are compressed apart, as each has frequencies of its own."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<BQ", _CODES[x.dtype], len(x)) for x in arrays)
    planes = [plane.tobytes() for x in arrays for plane in np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T]
    if sum(map(len, planes)) < APART * len(planes):
        return b"\0" + zstandard.compress(head + b"".join(planes), 3)
    packed = [zstandard.compress(plane, 3) for plane in planes]
    return b"\1" + head + struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)


def _unpack(b: bytes) -> list[np.ndarray]:
    apart, raw = b[0], b[1:] if b[0] else zstandard.decompress(b[1:])
    heads, at, out = [struct.unpack_from("<BQ", raw, 1 + 9 * i) for i in range(raw[0])], 1 + 9 * raw[0], []
    kinds = [np.dtype(_KINDS[code]) for code, _ in heads]
    sizes = iter(struct.unpack_from(f"<{sum(k.itemsize for k in kinds)}I", raw, at)) if apart else iter(())
    at += 4 * sum(k.itemsize for k in kinds) * apart
    every = memoryview(raw)
    for kind, (_, n) in zip(kinds, heads, strict=True):
        x = np.empty((n, kind.itemsize), np.uint8)
        for plane in range(kind.itemsize):
            size = next(sizes, n)
            x[:, plane] = np.frombuffer(zstandard.decompress(every[at : at + size]) if apart else every[at : at + size], np.uint8) if n else 0
            at += size
        out.append(x.view(kind).ravel())
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """In the fewest bytes that hold all values."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _steps(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rising runs as their steps; new marks where a run begins, which stays as it is."""
    out = x.copy()
    out[1:] -= np.where(new[1:], 0, x[:-1]).astype(x.dtype)
    return out


def _unstepped(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    total = np.cumsum(x.astype(np.uint64), dtype=np.uint64)
    start = np.flatnonzero(new)
    return total - np.repeat(total[start] - x[start], np.diff(start, append=len(x)))


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _pairs(word: np.ndarray, next_: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a representative of each case in which windows agree on the state below, number of each window's). Windows
    that begin deeper have states of their own, and so has every window whose next word occurs once, where it doesn't matter."""
    key = mixed(mixed(word.astype(np.uint64)) + next_.astype(np.uint64))
    return _numbered(np.where(start > 2, np.arange(len(word), dtype=np.uint64), key))


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a representative of each distinct key, in the keys' order; number of each key)."""
    order = np.argsort(key)
    new = np.empty(len(key), bool)
    new[:1] = True
    ordered = key[order]
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _bytes(x: bytes) -> np.ndarray:
    return np.array(bytearray(x), "<u1")


def _rows(rows: Iterator[tuple[int, int, bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of (block, bucket, payload) of some megabytes."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        block, bucket, payload = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], names=["block", "bucket", "payload"])

    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= most:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def held_out(doc_id) -> bool:
    """A null doc_id counts as the empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == HELD


def rounded(q: np.ndarray) -> np.ndarray:
    """Probabilities as the test sees them, in steps of their negative logarithm."""
    return np.minimum(np.round(-STEPS * np.log(q)), 65535).astype("<u2")


def gains(n: np.ndarray, total: np.ndarray, q: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What next words counted n times of total gain over the state below, each occurrence held back in turn."""
    return n * np.log(np.maximum(n - 1 - DISCOUNT, 0) / np.maximum(total - 1, 1) / q + share)


# --- words


def _encode(docs: DataFrame, buckets: int) -> DataFrame:
    """Per block: a row of bucket -1, its documents as word numbers of the block; and for each bucket its words and their
    training counts."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[pa.Array] = []
        size = 0

        def done() -> Iterator[tuple[int, int, bytes]]:
            words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(pa.concat_arrays(texts), "")))
            flat, offsets = words.flatten(), words.offsets.to_numpy()
            real = pc.greater(pc.binary_length(flat), 0)
            some = real.to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(some)])[offsets - offsets[0]]
            coded = flat.filter(real).dictionary_encode()
            names = [b"", *coded.dictionary.cast(pa.large_binary()).to_pylist()]  # the first is a document's end
            lens = np.diff(before) + 1
            ends = np.cumsum(lens) - 1
            seq, inside = np.zeros(int(lens.sum()), np.int64), np.ones(int(lens.sum()), bool)
            inside[ends] = False
            seq[inside] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
            held = np.array([held_out(i) for i in ids])
            order = np.argsort(-np.bincount(seq, minlength=len(names)), kind="stable")  # by falling frequency
            names = [names[i] for i in order]
            bucket = (np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            # a word's number in the block rises with its place in its bucket, and tells the bucket as its remainder
            number, counts = np.empty(len(names), np.int64), np.bincount(seq[np.repeat(~held, lens)], minlength=len(names))[order]
            number[order[by]] = (np.arange(len(by)) - edges[bucket[by]]) * buckets + bucket[by]
            yield block, -1, _pack(_bytes(json.dumps(ids).encode()), _narrow(lens), held.astype("<u1"), _narrow(number[seq]))
            for r in range(buckets):
                if len(at := by[edges[r] : edges[r + 1]]):
                    yield block, r, _pack(_bytes(b" ".join([names[i] for i in at])), _narrow(counts[at]))

        for b in batches(source, 1 << 20):
            ids += b.column("doc_id").to_pylist()
            texts.append(b.column("text").cast(pa.large_string()))
            size += b.column("text").nbytes
            if size >= BLOCK:
                yield from _rows(done())
                block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield from _rows(done())

    return docs.mapInArrow(run, _ROWS)


def _by_bucket(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[list[np.ndarray]]]]:
    """(bucket, blocks, their unpacked payloads) of consecutive rows of one bucket."""
    now, blocks, held = None, [], []
    for b in source:
        for block, bucket, payload in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "payload")), strict=True):
            if blocks and bucket != now:
                yield now, blocks, held
                blocks, held = [], []
            now = bucket
            blocks.append(block)
            held.append(_unpack(payload))
    if blocks:
        yield now, blocks, held


def _owned(requests: DataFrame, buckets: int, answer) -> DataFrame:
    """What the owners answer: a task for each bucket. Rows of a negative block are their own."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(row for bucket, blocks, asked in _by_bucket(source) for row in answer(bucket, blocks, asked))

    return requests.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "block").mapInArrow(run, _ROWS)


def _count_words(buckets: int):
    """Corpus-wide training counts of a bucket's words and their numbers, and its totals."""

    def answer(bucket: int, blocks: list[int], asked: list[list[np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
        words = pa.concat_arrays([pc.split_pattern(pa.array([a[0].tobytes()], pa.large_binary()), b" ").flatten() for a in asked]).dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(index, np.concatenate([a[1] for a in asked]), len(words.dictionary)).astype(np.int64)
        number = np.empty(len(counts), np.int64)
        number[np.argsort(-counts, kind="stable")] = np.arange(len(counts)) * buckets + bucket + 2
        number[counts == 0] = UNKNOWN
        yield -1 - bucket, bucket, _pack(np.array([counts.sum(), (counts > 0).sum()], "<u8"))
        at = 0
        for block, a in zip(blocks, asked, strict=True):
            own = index[at : at + len(a[1])]
            at += len(own)
            yield block, bucket, _pack(_narrow(counts[own]), _narrow(number[own]))

    return answer


# --- tables by block


def _kept(rows: DataFrame, tasks: int, name: str, grouped: bool = True) -> DataFrame:
    """rows stored by block, one row for each with all its payloads, so that later joins by block don't move them."""
    if grouped:
        rows = rows.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias("parts"))
    path, table = scratch(rows.sparkSession, name), f"citelume_{uuid.uuid4().hex}"
    rows.write.option("path", path).option("compression", "uncompressed").bucketBy(tasks, "block").sortBy("block").saveAsTable(table)
    out = rows.sparkSession.table(table)
    rows.sparkSession.sql(f"DROP TABLE {table}")  # its files stay, and so does what was read from the catalog
    return out


def _totals(table: DataFrame) -> tuple[int, int]:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            found = [_unpack(p["payload"])[0] for parts in b.column("parts").to_pylist() for p in parts]
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(x[0]) for x in found], pa.int64()), "v": pa.array([int(x[1]) for x in found], pa.int64())})

    out = table.filter("block < 0").mapInArrow(run, "n bigint, v bigint")
    return tuple(out.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first())


# --- a block


class _Block:
    """A block's documents with what the answers so far say of them. Words are held by their small numbers in the block.

    gram[d]: how often the d words that end here stand in training; -1 where that isn't known, and then it is HOT at most.
    """

    def __init__(self, payload: bytes, answers: list[dict[int, bytes]], totals: tuple[int, int], tables: list[dict[int, int]], buckets: int, depth: int, hot: int) -> None:
        ids, lens, held, seq = _unpack(payload)
        self.ids = json.loads(ids.tobytes())
        self.lens, self.held, self.local = lens.astype(np.int64), held.astype(bool), seq.astype(np.int32)
        self.n, self.v = totals
        self.buckets, self.depth, self.hot, self.kinds = buckets, depth, hot, int(self.local.max()) + 1
        count, self.number = np.zeros(self.kinds, np.int64), np.zeros(self.kinds, np.uint64)
        for r, part in answers[0].items():
            c, number = _unpack(part)
            count[r : r + len(c) * buckets : buckets], self.number[r : r + len(c) * buckets : buckets] = c, number
        # from here on the block's numbers rise with those of all blocks, so what is sorted by one is sorted by the other
        order = np.argsort(self.number, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.local, count, self.number = rank[self.local], count[order], self.number[order]
        self.train = ~np.repeat(self.held, self.lens)
        self.place = (np.arange(len(seq)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)).astype(np.int32)
        self.gram = [None, count[self.local]]
        self.p, self.state = ((count + 1) / (self.n + self.v + 1))[self.local], np.zeros(len(seq), np.int8)
        for d, part in enumerate(answers[1:], 1):
            self.ask(d)
            self.hear(d, part, tables[d - 1])
            del self.total, self.pair_of, self.pairs, self.keys, self.words, self.are_hot, self.unit  # memory

    def key(self, at: np.ndarray, d: int) -> np.ndarray:
        """The context of d words at positions, as all blocks know it."""
        out = self.number[self.local[at - 1]]
        for i in range(2, d + 1):
            out = mixed(out * _ODD + self.number[self.local[at - i]] + np.uint64(i))
        return out

    def ask(self, d: int) -> None:
        """The pairs of contexts of d words and next words that are asked for: all of one word, hot ones of more."""
        before = np.zeros(len(self.local), np.int64)
        before[1:] = self.gram[d][:-1]
        self.at = at = np.flatnonzero((self.place >= d) & (before >= CONTEXT if d == 1 else before > self.hot))
        context = self.local[at - 1].astype(np.int64)
        for i in range(2, d + 1):
            context = _numbered(context * self.kinds + self.local[at - i])[1]
        self.total = before[at]
        first, pair_of = _numbered(context * self.kinds + self.local[at])
        where = at[first]  # a representative of each pair
        key, word, hot = self.key(where, d), self.number[self.local[where]], before[where] > self.hot
        owner = mixed(np.where(hot, key ^ mixed(word), key)) % np.uint64(self.buckets)
        # a context at an owner is a unit; units are sorted by owner, their pairs stand together
        order = np.argsort(_narrow(owner), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.pair_of = place[pair_of]
        self.pairs, self.keys, self.words, self.are_hot, owner, c = where[order], key[order], word[order], hot[order], owner[order], context[first][order]
        self.unit = np.cumsum(np.concatenate([[False], (c[1:] != c[:-1]) | (owner[1:] != owner[:-1])])) if len(c) else np.zeros(0, np.int64)
        self.edges = np.searchsorted(owner, np.arange(self.buckets + 1, dtype=np.uint64))

    def requests(self, d: int) -> Iterator[tuple[int, bytes]]:
        """For each owner: contexts, how many pairs each has, whether they are hot, then the pairs: word, twice the count (and 1 if
        held-out text asks), state below."""
        train = self.train[self.at]
        asked = 2 * np.bincount(self.pair_of, train, len(self.pairs)).astype(np.int64) + (np.bincount(self.pair_of, ~train, len(self.pairs)) > 0)
        below = rounded(self.p[self.pairs])
        for r in range(self.buckets):
            s = slice(self.edges[r], self.edges[r + 1])
            if s.start < s.stop:
                unit = self.unit[s] - self.unit[s.start]
                first = np.flatnonzero(np.diff(unit, prepend=-1))
                keys, new = self.keys[s][first], np.zeros(len(unit), bool)
                new[first] = True
                if d == 1:  # numbers rise; longer contexts are hashes
                    keys = _steps(keys, np.arange(len(keys)) == 0)
                words = _steps(self.words[s], new)
                yield r, _pack(_narrow(keys), _narrow(np.diff(first, append=len(unit))), self.are_hot[s][first].astype("<u1"), _narrow(words), _narrow(asked[s]), below[s])

    def hear(self, d: int, parts: dict[int, bytes], table: dict[int, int]) -> None:
        """Takes the pairs' counts, and how many next words a context has (0: not kept)."""
        n, next_ = np.zeros(len(self.pairs), np.int64), np.zeros(len(self.pairs), np.int64)
        for r, part in parts.items():
            s = slice(self.edges[r], self.edges[r + 1])
            n[s], kinds = _unpack(part)
            next_[s] = kinds[self.unit[s] - self.unit[s.start]]
        if len(hot := np.flatnonzero(self.are_hot)):
            first, of = _numbered(self.keys[hot])
            next_[hot] = np.array([table.get(int(k), 0) for k in self.keys[hot][first]], np.int64)[of]
        own = n[self.pair_of]
        gram = np.full(len(self.local), 0 if d == 1 else -1, np.int64)
        once, own = own == 2, own - (own > 1)
        gram[self.at] = own
        self.gram.append(gram)
        if d == 1:
            self.once = np.zeros(len(self.local), bool)  # the pair's one occurrence, which held-out text doesn't ask for
            self.once[self.at] = once
        kinds = next_[self.pair_of]
        live = (kinds > 0) & (self.state[self.at] == d - 1)
        at, total, kinds = self.at[live], self.total[live], kinds[live]
        self.p[at] = np.maximum(own[live] - DISCOUNT, 0) / total + DISCOUNT * kinds / total * self.p[at]
        self.state[at] = d

    def window(self) -> None:
        """The distinct windows to be asked for, by owner: the state, the words before (none from where no context recurs), the next word."""
        at = np.flatnonzero((self.state > 0) & (self.state < self.depth) & (self.place > self.state))
        start = self.state[at] + 1
        count = np.full(len(at), -1, np.int64)
        for d in range(2, len(self.gram)):
            now = start == d
            count[now] = self.gram[d][at[now] - 1]
        go = (count < 0) | (count >= CONTEXT) & (count <= self.hot)
        at, start = at[go], start[go].astype(np.int8)
        words, alive = [], np.ones(len(at), bool)  # numbers in the block and 1, or 0
        for d in range(1, self.depth + 1):
            alive &= (self.place[at] >= d) & ((start >= d) | (self.gram[2][np.maximum(at - d + 1, 0)] >= CONTEXT if d > 1 else True))
            words.append(np.where(alive, self.local[np.maximum(at - d, 0)] + 1, 0).astype(np.int32))
        words.append(np.where(self.once[at], 0, self.local[at] + 1).astype(np.int32))  # the next word; 0: it occurs once
        words.append(start)
        key = np.zeros(len(at), np.uint64)
        for x in words:
            key = key * _ODD + x.astype(np.uint64)
        order = np.argsort(mixed(key))
        new = np.ones(len(order), bool)
        new[1:] = False
        for x in words:
            x = x[order]
            new[1:] |= x[1:] != x[:-1]
        number = np.empty(len(order), np.int32)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        words = [x[first] for x in words]
        everywhere = np.concatenate([np.zeros(1, np.uint64), self.number])
        # all windows after a word have one owner, but for a hot word's: those are dealt out by the shortest context in question
        deep = np.where(self.gram[1][at[first] - 1] > self.hot, words[-1], 1)
        hashed = np.zeros(len(first), np.uint64)
        for d, x in enumerate(words[:-2], 1):
            hashed = np.where(deep >= d, mixed(hashed * _ODD + everywhere[x]), hashed)
        owner = hashed % np.uint64(self.buckets)
        bits = max(1, int(self.kinds + 1).bit_length())
        near = np.zeros(len(first), np.uint64)  # equal contexts stand together
        for d, x in enumerate(words[:-2][:3], 1):
            shift = 64 - d * bits
            near |= x.astype(np.uint64) << np.uint64(shift) if shift >= 0 else x.astype(np.uint64) >> np.uint64(-shift)
        order = np.argsort(near, kind="stable")
        order = order[np.argsort(_narrow(owner)[order], kind="stable")]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.at, self.of, self.first = at, place[number], at[first][order]
        self.windows, self.everywhere = [x[order] for x in words], everywhere
        self.edges = np.searchsorted(owner[order], np.arange(self.buckets + 1, dtype=np.uint64))

    def window_requests(self) -> Iterator[tuple[int, bytes]]:
        """For each owner: next word, training count, state below, shortest context, then the words before."""
        counts = np.bincount(self.of, self.train[self.at], len(self.first)).astype(np.int64)
        *before, next_, start = self.windows
        below = np.where(next_ == ONCE, 0, rounded(self.p[self.first])).astype("<u2")  # it doesn't matter there
        for r in range(self.buckets):
            s = slice(self.edges[r], self.edges[r + 1])
            if s.start < s.stop:
                first, *more = (self.everywhere[x[s]] for x in before)
                if more:
                    more[0] = _steps(more[0], _changes(first))
                after = self.everywhere[next_[s]]
                told, _ = _pairs(first, after, start[s])
                yield r, _pack(_narrow(after), _narrow(counts[s]), below[s][told], start[s].astype("<u1"), _narrow(_steps(first, np.arange(len(first)) == 0)), *map(_narrow, more))

    def finish(self, parts: dict[int, bytes]) -> None:
        state, a, b = np.zeros(len(self.first), np.int8), np.zeros(len(self.first)), np.ones(len(self.first))
        for r, part in parts.items():
            s = slice(self.edges[r], self.edges[r + 1])
            state[s], *more = _unpack(part)
            begun = self.windows[-1][s]
            for d in range(2, self.depth + 1):
                some = s.start + np.flatnonzero((state[s] >= d) & (begun <= d))
                n, total, kinds, *more = more
                new = np.zeros(len(some), bool)
                for x in self.windows[:d]:
                    new |= _changes(x[some])
                run = np.cumsum(new) - 1
                total, share = total[run], (DISCOUNT * kinds / total)[run]
                a[some] = np.maximum(n - DISCOUNT, 0) / total + share * a[some]
                b[some] *= share
        found = state[self.of] > 0
        at, of = self.at[found], self.of[found]
        self.p[at] = a[of] + b[of] * self.p[at]
        self.state[at] = state[of]


# --- owners of contexts


def _count_pairs(d: int, most: int):
    def answer(bucket: int, blocks: list[int], asked: list[list[np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
        """Per block the corpus-wide training count of each pair, in a code that tells single ones apart, and the number of next
        words of each kept context; of hot contexts (of which this may be a part) sums, and what their test needs."""
        join = lambda i: np.concatenate([a[i] for a in asked])
        each_sizes, each_pairs = [a[1].astype(np.int64) for a in asked], [len(a[3]) for a in asked]
        sizes = np.concatenate(each_sizes)
        units = np.concatenate([_unstepped(a[0], np.arange(len(a[0])) == 0) if d == 1 else a[0].astype(np.uint64) for a in asked])
        firsts, context = _numbered(units)
        keys, hot = units[firsts], join(2).astype(bool)[firsts]
        asks, below = join(4), join(5)
        new = np.zeros(len(asks), bool)
        new[np.cumsum(sizes) - sizes] = True
        word = _unstepped(join(3), new)
        asked.clear()  # memory
        context = np.repeat(context, sizes).astype(np.int32)
        _, of = _numbered(context.astype(np.uint64) << np.uint64(40) | word)
        del units, word, new
        first = np.empty(int(of.max()) + 1, np.int64)
        first[of] = np.arange(len(of))
        n = np.bincount(of, asks // 2, len(first)).astype(np.int64)
        held = np.bincount(of, asks % 2, len(first)) > 0
        owner, q = context[first], below[first].astype(np.int64)
        some = n > 0
        total = np.bincount(owner, n, len(keys)).astype(np.int64)
        kinds = np.bincount(owner[some], minlength=len(keys))
        share = DISCOUNT * kinds / np.maximum(total, 1)
        gain = np.bincount(owner[some], gains(n[some], total[owner[some]], np.exp(-q[some] / STEPS), share[owner[some]]), len(keys))
        kept = np.where((total >= CONTEXT) & (gain >= GAIN), kinds, 0)
        if hot.any():  # only a part of them is here: what was found above isn't theirs, and the blocks don't use it
            more, each = hot[owner] & (n > 1), lambda mask: np.bincount(owner[mask], minlength=len(keys))[hot].astype("<u8")
            order = np.argsort(owner[more], kind="stable")
            yield -1 - bucket, bucket, _pack(keys[hot].astype("<u8"), total[hot].astype("<u8"), kinds[hot].astype("<u8"), each(n > most), each(more), _narrow(n[more][order]), q[more][order].astype("<u2"))
        # 1: occurs once, and held-out text asks for it as well; 2: occurs once; from there on the count and 1
        said, at = n + (n > 1) + ((n == 1) & ~held), 0
        for block, own_sizes, pairs in zip(blocks, each_sizes, each_pairs, strict=True):
            own = slice(at, at + pairs)
            at = own.stop
            starts = np.cumsum(own_sizes) - own_sizes
            yield block, bucket, _pack(_narrow(said[of[own]]), _narrow(kept[context[own][starts]]))

    return answer


def _test_windows(depth: int):
    def answer(bucket: int, blocks: list[int], asked: list[list[np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
        """Per block the state of each window (0: as it was), and for each depth up to it the next word's count, and once for
        windows of a context that stand together the context's count and how many next words it has."""
        for a in asked:
            a[4] = _unstepped(a[4], np.arange(len(a[4])) == 0)
            if depth > 1:
                a[5] = _unstepped(a[5], _changes(a[4]))
        join = lambda i: np.concatenate([a[i] for a in asked])
        for a in asked:
            a[2] = a[2][_pairs(a[4], a[0], a[3])[1]]
        word, count, start, before = join(0), join(1), join(3).astype(np.int8), [join(3 + d) for d in range(1, depth + 1)]
        q, sizes = np.exp(-join(2).astype(np.float64) / STEPS), [len(a[0]) for a in asked]
        asked.clear()  # memory
        state, found = np.zeros(len(word), np.int8), {d: [np.zeros(0, np.int64)] * 5 for d in range(2, depth + 1)}
        context = _numbered(before[0])[1].astype(np.int32)
        live = np.ones(len(word), bool)
        for d in range(2, depth + 1):
            far = before[d - 1]
            context = _numbered(context.astype(np.uint64) << np.uint64(40) | far)[1].astype(np.int32)
            live &= (far != 0) & ((start >= d) | (state == d - 1))
            if not (at := np.flatnonzero(live & (start <= d))).size:
                continue
            _, own = _numbered(context[at])
            total = np.bincount(own, count[at]).astype(np.int64)
            _, pair = _numbered(own.astype(np.uint64) << np.uint64(40) | word[at])
            first = np.empty(int(pair.max()) + 1, np.int64)
            first[pair] = np.arange(len(pair))
            n = np.bincount(pair, count[at], len(first)).astype(np.int64)
            single = word[at[first]] == ONCE  # each occurrence is a next word of its own
            of, some = own[first], n > 0
            kinds = np.bincount(of[some], np.where(single[some], n[some], 1), len(total)).astype(np.int64)
            share = DISCOUNT * kinds / np.maximum(total, 1)
            each = np.where(single, 1, n)
            gain = gains(each, total[of], q[at][first], np.maximum(share[of], 1e-9)) * np.where(single, n, 1)
            gain = np.bincount(of[some], gain[some], len(total))
            kept = ((total >= CONTEXT) & (gain >= GAIN))[own]
            own, at, each = own[kept].astype(np.int32), at[kept], each[pair[kept]]
            q[at] = np.maximum(each - DISCOUNT, 0) / total[own] + share[own] * q[at]
            state[at] = d
            found[d] = [at, _narrow(each), own, _narrow(total), _narrow(kinds)]
        at = 0
        for block, size in zip(blocks, sizes, strict=True):
            own = at, at + size
            at = own[1]
            parts = []
            for where, each, context_of, total, kinds in found.values():
                here = slice(*np.searchsorted(where, own))
                first = context_of[here][_changes(context_of[here])]  # once for windows of a context that stand together
                parts += [_narrow(each[here]), _narrow(total[first]), _narrow(kinds[first])]
            yield block, bucket, _pack(state[own[0] : own[1]].astype("<u1"), *parts)

    return answer


# --- hot contexts


def _hot(table: DataFrame) -> tuple[dict[int, int], bool]:
    """(next words of each kept hot context, whether a longer context is hot), from its parts at the owners."""

    def parts(rows: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for row in rows.column("parts").to_pylist():
            for p in row:
                yield _unpack(p["payload"])

    def sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for keys, total, kinds, deeper, *_ in parts(b):
                yield pa.RecordBatch.from_pydict({"context": pa.array(keys.view(np.int64)), "total": pa.array(total.view(np.int64)), "kinds": pa.array(kinds.view(np.int64)), "deeper": pa.array(deeper.view(np.int64))})

    own = table.filter("block < 0")
    every = own.mapInArrow(sums, "context bigint, total bigint, kinds bigint, deeper bigint").groupBy("context").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds"), F.sum("deeper").alias("deeper"))
    found = every.collect()  # tokens / HOT at most
    if not found:
        return {}, False
    sent = table.sparkSession.sparkContext.broadcast({r["context"] & (1 << 64) - 1: (r["total"], r["kinds"]) for r in found})

    def tested(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            rows = []
            for keys, own_total, _, _, sizes, n, q in parts(b):
                ends = np.cumsum(sizes.astype(np.int64))
                for i, k in enumerate(keys.tolist()):
                    total, kinds = sent.value[k]
                    s = slice(int(ends[i]) - int(sizes[i]), int(ends[i]))
                    m, share = n[s].astype(np.int64), DISCOUNT * kinds / total
                    gain = gains(m, np.int64(total), np.exp(-q[s].astype(np.int64) / STEPS), share).sum() + (int(own_total[i]) - int(m.sum())) * np.log(share)
                    rows.append((np.uint64(k).astype(np.int64), float(gain)))
            context, gain = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_pydict({"context": pa.array(context, pa.int64()), "gain": pa.array(gain, pa.float64())})

    kept = own.mapInArrow(tested, "context bigint, gain double").groupBy("context").agg(F.sum("gain").alias("gain")).filter(f"gain >= {GAIN}").collect()
    kinds = sent.value
    return {k: kinds[k][1] for r in kept for k in [r["context"] & (1 << 64) - 1]}, any(r["deeper"] for r in found)


def _at_blocks(blocks: DataFrame, answers: list[DataFrame], function, schema: str) -> DataFrame:
    """function over each block and the answers so far. Tables stored by block meet without being moved."""
    together = blocks.select("block", "payload")
    for i, a in enumerate(answers):
        together = together.join(a.select("block", F.col("parts").alias(f"a{i}")).hint("merge"), "block", "left")
    names = [f"a{i}" for i in range(len(answers))]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                parts = [{p["bucket"]: p["payload"] for p in row.column(c)[0].as_py() or ()} for c in names]
                made = function(row.column("block")[0].as_py(), row.column("payload")[0].as_py(), parts)
                del parts
                yield from _rows(made) if schema == _ROWS else made
                pa.default_memory_pool().release_unused()

    return together.mapInArrow(run, schema)


def score(docs: DataFrame, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_context): log10 probabilities of whole texts.

    Words are of the ASCII lower-cased text, and an end follows them. The model learns from documents that aren't held out.
    base_score is that of the add-one unigram at the root, score the tree's; n_context counts tokens whose state is a
    context. Nulls: a null text is empty (its end is scored); a null doc_id counts as an empty id. Repeated rows count and
    are scored each. If all documents are held out, every token has the root's share of nothing seen. No documents give no
    rows; other columns are ignored. doc_id may be of any type that its text gives back. hot: see HOT; it changes no result.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(-(-size // BUCKET) or 1)
    tasks = int(min(-(-size // BLOCK) or 1, 100_000))
    before = named()
    encoded = stored(_encode(plain, buckets), "lm-encoded")
    encoded_at = named()
    blocks = _kept(encoded.filter("bucket = -1"), tasks, "lm-blocks", False)
    words = _kept(_owned(encoded.filter("bucket >= 0"), buckets, _count_words(buckets)), tasks, "lm-words")
    release(spark, before, encoded_at)
    forget_shuffles(spark)
    totals = _totals(words)
    answers, tables = [words], []
    for d in range(1, depth + 1):
        sent = spark.sparkContext.broadcast(list(tables))

        def ask(block: int, payload: bytes, parts: list, d: int = d, sent=sent) -> Iterator[tuple[int, int, bytes]]:
            b = _Block(payload, parts, totals, sent.value, buckets, depth, hot)
            b.ask(d)
            for bucket, request in b.requests(d):
                yield block, bucket, request

        answers.append(_kept(_owned(_at_blocks(blocks, answers, ask, _ROWS), buckets, _count_pairs(d, hot)), tasks, "lm-pairs"))
        forget_shuffles(spark)
        table, deeper = _hot(answers[-1])
        tables.append(table)
        if not deeper:
            break
    sent = spark.sparkContext.broadcast(tables)

    def look(block: int, payload: bytes, parts: list) -> Iterator[tuple[int, int, bytes]]:
        b = _Block(payload, parts, totals, sent.value, buckets, depth, hot)
        b.window()
        for bucket, request in b.window_requests():
            yield block, bucket, request

    tested = _owned(_at_blocks(blocks, answers, look, _ROWS), buckets, _test_windows(depth))
    found = tested.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias("parts"))

    def finish(block: int, payload: bytes, parts: list) -> Iterator[pa.RecordBatch]:
        b = _Block(payload, parts[:-1], totals, sent.value, buckets, depth, hot)
        b.window()
        b.finish(parts[-1])
        starts = np.cumsum(b.lens) - b.lens
        add = lambda x: np.add.reduceat(x, starts)
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(b.ids, pa.string()), "held_out": pa.array(b.held.tolist(), pa.bool_()), "n_tokens": pa.array(b.lens), "n_known": pa.array(add((b.gram[1] > 0).astype(np.int64))),
            "train_tokens": pa.array([b.n] * len(b.ids), pa.int64()), "base_score": pa.array(add(np.log10((b.gram[1] + 1) / (b.n + b.v + 1)))), "score": pa.array(add(np.log10(b.p))), "n_context": pa.array(add((b.state > 0).astype(np.int64))),
        })

    out = _at_blocks(blocks, [*answers, found], finish, "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_context bigint")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def query(docs: DataFrame) -> DataFrame:
    return score(docs)
