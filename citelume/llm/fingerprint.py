"""Document fingerprints by consistent weighted sampling: equal components estimate generalised Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, mixed, stored

#: Components of a fingerprint: the likeness's standard error is at most 1 / (2 * sqrt(SAMPLES)), 0.0625.
SAMPLES = 64
#: Texts fingerprinted at once share their terms' random numbers; memory follows this.
CHUNK_BYTES = 1 << 18


def _weights(text: str) -> Counter[bytes]:
    """A text's terms, pairs of neighbouring words of the ASCII lower-cased text (a lone word is a term), and their counts."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return Counter(words if len(words) == 1 else map(b"\x20".join, zip(words, words[1:], strict=False)))


class Sampler:
    """Improved consistent weighted sampling: for each component k and term, r and c are Gamma(2, 1) and b is uniform,
    all drawn from a hash of term, k and seed, so they are the same wherever the term occurs.

    A term of weight w has the quantised level t = floor(ln w / r + b) and the value ln c - r * (t - b + 1); a component is
    the least value over a text's terms, kept as 16 mixed bits of it: equal values come from the same term and level.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 42) -> None:
        salts = mixed(np.arange(1, 2 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)).astype(np.uint32)
        self.salts = salts[:samples], salts[samples:]
        self.samples = samples
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        self.log = -np.log(u).astype(np.float32)
        x = np.concatenate([np.geomspace(1e-6, 1, 1 << 15), np.linspace(1, 40, 1 << 16)[1:]])
        self.gamma = np.interp(u, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)  # Gamma(2, 1) by its quantiles

    def values(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A row of values for each hashed term and its weight."""
        out = np.empty((len(terms), self.samples), np.float32)
        low = np.uint32(0xFFFF)
        for at in range(0, len(terms), 512):
            h, w = terms[at : at + 512], weights[at : at + 512]
            x = _mixed32((h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] ^ self.salts[0])
            y = _mixed32((h >> np.uint64(32)).astype(np.uint32)[:, None] ^ self.salts[1])
            r = self.gamma[x & low]
            b = ((x >> np.uint32(16)).astype(np.float32) + np.float32(0.5)) * np.float32(1 / (1 << 16))
            lnc = np.log(self.log[y & low] + self.log[y >> np.uint32(16)])
            b -= 1  # b - 1 - t
            if (many := w > 1).any():
                b[many] -= np.floor(np.log(w[many])[:, None] / r[many] + b[many] + 1)
            b *= r
            b += lnc
            out[at : at + 512] = b
        return out

    def signatures(self, weighted: list[Counter[bytes]]) -> list[np.ndarray]:
        """A row of 16-bit components for each multiset of terms; an empty multiset's are zero.

        Terms of several multisets are drawn once. Multisets of more than PART terms are drawn in parts."""
        rows: dict = {}
        index = []
        for terms in weighted:
            if len(terms) > PART:
                index.append(None)
                continue
            index.append([rows.setdefault(t if n == 1 else (t, n), len(rows)) for t, n in terms.items()])
        values = self.values(*_hashed(rows))
        out = []
        for terms, at in zip(weighted, index, strict=True):
            if at is None:
                pairs, least = list(terms.items()), np.full(self.samples, np.inf, np.float32)
                for i in range(0, len(pairs), PART):
                    least = np.minimum(least, self.values(*_hashed([t if n == 1 else (t, n) for t, n in pairs[i : i + PART]])).min(0))
            elif not at:
                out.append(np.zeros(self.samples, np.uint16))
                continue
            else:
                least = values[at].min(0)
            out.append((_mixed32(least.view(np.uint32).copy()) >> np.uint32(16)).astype(np.uint16))
        return out


#: Most terms whose values are held at once for one text.
PART = 1 << 16


def _hashed(keys) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh64_intdigest
    plain = [(k, 1) if type(k) is bytes else k for k in keys]
    return np.fromiter((digest(t) for t, _ in plain), np.uint64, len(plain)), np.fromiter((n for _, n in plain), np.float32, len(plain))


def _mixed32(x: np.ndarray) -> np.ndarray:
    """MurmurHash3's finaliser over uint32, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def hexed(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def _rows(rows: list[tuple], after: str, sampler: Sampler, id_type: pa.DataType) -> dict[str, pa.Array]:
    """The result of (doc_id, text) rows that follow each other, `after` the text that follows the last."""
    texts = [r[1] for r in rows]
    nexts = [*texts[1:], after]
    edited = []
    for t, n in zip(texts, nexts, strict=True):
        cut = len(t) // 3
        edited.append(t[: len(t) - cut] + n[:cut])
    all_ = sampler.signatures([_weights(t) for t in (*texts, after, *edited)])
    own, other = all_[: len(texts) + 1], all_[len(texts) + 1 :]
    like = lambda a, b: float((a == b).mean())
    return {
        "doc_id": pa.array([r[0] for r in rows], id_type), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
        "fingerprint": pa.array([hexed(s) for s in own[:-1]], pa.string()), "edited_fingerprint": pa.array([hexed(s) for s in other], pa.string()),
        "near_edited": pa.array([like(a, b) for a, b in zip(own, other, strict=False)], pa.float64()),
        "near_next": pa.array([like(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
    }


#: About how many documents share a range of ids, at least as many ranges as there are shuffle partitions.
RANGE = 65_536
_RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame, samples: int = SAMPLES, seed: int = 42) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each whole text's
    fingerprint beside that of its edited text (the last third of its code points replaced by as many, or all there are,
    of the next document's) and of the next document, in descending doc_id; after the last comes the first.

    Texts move once, to ranges of ids. A range's task does all but its last document; that, and the first one's text, it
    leaves in the stored result, and the few left are then joined to the range after theirs. doc_id may be of any type with
    an order. Nulls: a null text is empty, with a fingerprint of zeros, alike to other empty texts; a null doc_id comes
    last. Rows of equal doc_id follow each other by a hash of their text, equal ones as they come, so that many of them
    spread over ranges. A single document is its own next. No documents give no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // RANGE)
    order = (F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("place"))
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("place")).withColumn("h", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, part = Sampler(samples, seed), TaskContext.get().partitionId()
        held: list[tuple] = []  # rows whose next isn't known, as they come
        size, id_type, begun = 0, pa.int64(), False

        def edge(which: int, doc, text: str) -> pa.RecordBatch:
            blank = pa.nulls(1, pa.string()), pa.nulls(1, pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([doc], id_type), pa.nulls(1, pa.int64()), *blank[:1] * 3, *blank[1:] * 2, pa.array([part], pa.int32()), pa.array([which], pa.int32()), pa.array([text], pa.string())], names=names)

        def done(rows: list[tuple], after: str) -> pa.RecordBatch:
            out, n = _rows(rows, after, sampler, id_type), len(rows)
            return pa.RecordBatch.from_arrays([*out.values(), pa.array([part] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string())], names=names)

        for b in batches(source):
            id_type = b.schema.field("doc_id").type
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not begun:
                    yield edge(1, doc, text)
                    begun = True
                if size >= CHUNK_BYTES:
                    yield done(held, text)
                    held, size = [], 0
                held.append((doc, text))
                size += len(text)
        if len(held) > 1:
            yield done(held[:-1], held[-1][1])
        if held:
            yield edge(2, *held[-1])

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "edge", "text"]
    every = stored(ranged.mapInArrow(run, f"doc_id {kind}, {_RESULT}, part int, edge int, text string"), "fingerprints")
    firsts, lasts = every.filter("edge = 1").select("part", "text"), every.filter("edge = 2").select("part", "doc_id", "text")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part").select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(whole)).alias("next"))
    pairs = lasts.join(after, "part").join(firsts.select(F.col("part").alias("next"), F.col("text").alias("after")), "next").select("doc_id", "text", "after")

    def resolve(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples, seed)
        for b in batches(source):
            for i in range(b.num_rows):
                doc, text, next_text = (b.column(c)[i].as_py() for c in ("doc_id", "text", "after"))
                yield pa.RecordBatch.from_pydict(_rows([(doc, text)], next_text, sampler, b.schema.field("doc_id").type))

    return every.filter("edge = 0").select(names[:7]).unionByName(pairs.mapInArrow(resolve, f"doc_id {kind}, {_RESULT}"))


def query(docs: DataFrame) -> DataFrame:
    return neighbours(docs)
