"""Token ids in training order: packed sequences, a keyed permutation of all of them, fixed-stride binary shards."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, mixed, shared_dir, stored

#: Ranks of a public byte-level BPE (one base64 token and its id a line) and the pattern that cuts texts for it.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ends each document, and fills the last sequence of a run of documents.
END = 50256
#: Tokens in a sequence, sequences in a shard.
LENGTH, SHARD = 2048, 4096
#: After each record: a text writer's line end, which makes the stride a byte longer.
STRIDE_END = "\n"
KEY = 20_240_229


def stride(length: int = LENGTH) -> int:
    """Bytes of a record: a count of tokens (uint16) and `length` little-endian uint16 ids, then the record's end."""
    return 2 + 2 * length + len(STRIDE_END)


def permuted(index: np.ndarray, n: int, key: int = KEY, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network on the next even number of bits, walked along its cycle
    until it is below n (fewer than four steps on average)."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out, at = index.astype(np.uint64), np.arange(len(index))
    while len(at):
        left, right = out[at] >> half, out[at] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[at] = left << half | right
        at = at[out[at] >= n]
    return out.astype(np.int64)


def content(spark: SparkSession, vocabulary: str) -> bytes:
    """The vocabulary's file, read by the driver: a local path, or any that Spark reads."""
    if "://" not in vocabulary:
        with open(vocabulary, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(vocabulary).first()["content"])


def encoder(vocabulary: str | bytes, pattern: str = PATTERN):
    """vocabulary: a local path, or the file's content."""
    import tiktoken

    if isinstance(vocabulary, str):
        with open(vocabulary, "rb") as f:
            vocabulary = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """The encoder, by a pattern without the look-ahead where blanks never stand side by side: there the cuts are the same
    and the search is a third faster."""

    def __init__(self, vocabulary: str | bytes) -> None:
        self.full, self.quick = encoder(vocabulary), encoder(vocabulary, PATTERN.replace(r"\s+(?!\S)|", ""))
        self.blanks = re.compile(r"\s\s")

    def encode_ordinary(self, text: str) -> list[int]:
        return (self.full if self.blanks.search(text) else self.quick).encode_ordinary(text)


#: Longest stretch given to the tokenizer at once; cut before a blank that follows a letter, where the pattern cuts as well.
STRETCH = 1 << 18


def encoded(enc, text: str) -> np.ndarray:
    """The whole text's ids. Long texts are encoded in stretches, cut where tokens end in any case."""
    parts, start = [], 0
    while start < len(text):
        end = start + STRETCH
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        parts.append(np.frombuffer(array("H", enc.encode_ordinary(text[start:end])), np.uint16))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _sequences(source: Iterator[pa.RecordBatch], vocabulary: bytes, length: int) -> Iterator[tuple[np.ndarray, list]]:
    """(ids, doc_ids) of each packed sequence of a partition; the last may be shorter."""
    enc = Encoder(vocabulary)
    ids, docs, size = [], [], 0  # docs: (doc_id, its last token's place in what is held)
    for b in batches(source):
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids.append(np.append(encoded(enc, text or ""), np.uint16(END)))
            size += len(ids[-1])
            docs.append((doc, size - 1))
            if size < length:
                continue
            held = np.concatenate(ids)
            whole = size // length
            d = 0
            for i in range(whole):
                inside = []
                while d < len(docs):
                    inside.append(docs[d][0])
                    if docs[d][1] >= (i + 1) * length:
                        break  # goes on in the next sequence
                    d += 1
                yield held[i * length : (i + 1) * length], inside
            held = held[whole * length :]
            docs = [(x, end - whole * length) for x, end in docs[d:]]
            ids, size = [held], len(held)
    if size:
        yield np.concatenate(ids), [x for x, _ in docs]


def materialise(docs: DataFrame, path: str | None = None, length: int = LENGTH, shard: int = SHARD, key: int = KEY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes the shards to path (a new folder in the shared one if None) and returns a row for each sequence:
    slot, shard, byte_offset (in the shard's file), n_tokens, doc_ids (in order, each document the sequence holds a part
    of), tokens_sha256 (of its ids without filling).

    Documents of a partition are joined, each ended by END, and cut into sequences of `length`; only a partition's last
    sequence is filled. The sequences are counted once; then each has a global number (its partition's start and its place)
    and the permutation gives it a slot, so a reader goes through the files from first to last, and resumes at any slot:
    the file of shard slot // `shard`, at (slot % `shard`) * stride. Texts are encoded twice instead of storing tokens
    between. docs must come in the same partitions both times, as from files; a run in which they don't is stopped.

    Nulls: a null text is empty and gives an END; a null doc_id stays null in doc_ids. Repeated rows are encoded each.
    No documents give no sequences and no files. Other columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = spark.sparkContext.broadcast(content(spark, vocabulary))  # about a megabyte; executors need no file of their own

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), []
        id_type = None

        def out() -> pa.RecordBatch:
            place, n, inside, sha = zip(*rows, strict=True)
            return pa.RecordBatch.from_pydict({"part": pa.array([part] * len(rows), pa.int32()), "place": pa.array(place, pa.int64()), "n_tokens": pa.array(n, pa.int32()), "doc_ids": pa.array(inside, pa.list_(id_type)), "tokens_sha256": list(sha)})

        def seen(it):
            nonlocal id_type
            for b in it:
                id_type = b.schema.field("doc_id").type
                yield b

        for place, (ids, inside) in enumerate(_sequences(seen(source), words.value, length)):
            rows.append((place, len(ids), inside, hashlib.sha256(ids.astype("<u2").tobytes()).hexdigest()))
            if len(rows) >= 1024:
                yield out()
                rows = []
        if rows:
            yield out()

    counted = stored(plain.mapInArrow(count, f"part int, place bigint, n_tokens int, doc_ids array<{kind}>, tokens_sha256 string"), "token-sequences")
    # a number for each partition of files: tens of bytes for tens of megabytes of text
    parts = {r["part"]: r["n"] for r in counted.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(parts):
        starts[p], total = total, total + parts[p]
    sent = spark.sparkContext.broadcast((starts, parts))

    def number(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = sent.value[0]
        for b in source:
            index = np.array([first[p] for p in b.column("part").to_pylist()], np.int64) + b.column("place").to_numpy(zero_copy_only=False)
            slot = permuted(index, total, key)
            names = ["slot", "shard", "byte_offset", "n_tokens", "doc_ids", "tokens_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // shard), pa.array(slot % shard * stride(length)), *(b.column(c) for c in names[3:])], names=names)

    manifest = counted.mapInArrow(number, f"slot bigint, shard bigint, byte_offset bigint, n_tokens int, doc_ids array<{kind}>, tokens_sha256 string")
    if not total:
        return manifest

    def records(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held = TaskContext.get().partitionId(), 0, []
        first, most = sent.value[0].get(part, 0), sent.value[1].get(part, 0)

        def out() -> pa.RecordBatch:
            slot = permuted(np.arange(place - len(held), place) + first, total, key)
            return pa.RecordBatch.from_arrays([pa.array(slot // shard), pa.array(slot), pa.array(held, pa.binary())], names=["shard", "slot", "record"])

        for ids, _ in _sequences(source, words.value, length):
            filled = np.full(length + 1, END, "<u2")
            filled[0] = len(ids) % 65536
            filled[1 : len(ids) + 1] = ids
            held.append(filled.tobytes())
            place += 1
            if len(held) >= 512:
                yield out()
                held = []
        if held:
            yield out()
        if place != most:
            raise RuntimeError(f"partition {part} has {place} sequences, it had {most}: docs come in other partitions than before")

    target = path or f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    dealt = plain.mapInArrow(records, "shard bigint, slot bigint, record binary")
    tasks = min(-(-total // shard), max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # ranges of slots are whole shards; each goes to one task, which writes its records in order
    ranges = dealt.repartitionById(tasks, F.expr(f"cast(shard % {tasks} as int)")).sortWithinPartitions("shard", "slot")
    ranges.select("shard", F.col("record").cast("string").alias("record")).write.option("lineSep", STRIDE_END).partitionBy("shard").text(target)
    return manifest


def read_shards(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """(shard, place, n_tokens, tokens) of written shards, for tests and readers on Spark."""
    step = stride(length)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                got = np.frombuffer(content, np.uint8).reshape(-1, step)[:, : step - len(STRIDE_END)].copy().view("<u2")
                number = int(name.split("shard=")[1].split("/")[0])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([number] * len(got), pa.int64()), "place": pa.array(range(len(got)), pa.int64()), "n_tokens": pa.array(got[:, 0].astype(np.int32)), "tokens": pa.array([r[1 : 1 + int(r[0])].astype(np.int32) for r in got], pa.list_(pa.int32()))})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("path").contains("shard=")).select("path", "content")
    return files.mapInArrow(run, "shard bigint, place bigint, n_tokens int, tokens array<int>")


def query(docs: DataFrame) -> DataFrame:
    return materialise(docs)
