"""Quality classifier: heuristic labellers weighed by expectation-maximisation, posterior labels, a hashed linear scorer."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .common import batches, give_back, raw, sieved, stored

#: Most documents that the scorer is fitted on, most of them with a label from annotators, and most bytes of their text; by a
#: seeded hash of doc_id. The labellers' accuracies come from all documents.
SAMPLE, ANNOTATED, SAMPLE_BYTES = 20_000, 15_000, 64 << 20
#: Hashed features (a power of two).
WIDTH = 1 << 20
# fixed values: words of abuse, one labeller's list
ABUSE = frozenset(w.encode() for w in "bastard clown disgusting dumb filth idiot imbecile loser moron pathetic scum stupid trash worthless".split())

#: Labellers in order: what annotators said, then heuristics on the text. Votes: 1 keep, 2 reject, 0 none.
LABELLERS = ("annotated", "repetition", "frequent_word", "symbols", "tables", "shouting", "word_length", "abuse", "prose")
#: What is thought of a labeller's accuracy beforehand (annotators', heuristics'), and as how many votes that counts.
BEFOREHAND, AS_VOTES = (0.97, 0.9), 100.0
#: A document without annotators' label counts in full from this posterior on, less the nearer its posterior is to a half.
SURE = 0.99
_STRIP = b".,;:!?()[]{}\"'`*#$%&@|<>^~_-+=/\\"
_SYMBOLS = re.compile(rb"[#$%&*@^~<>{}\\|=+_]")


class Measures:
    """What the text labellers and the scorer look at in a text's words."""

    def __init__(self, text: bytes | None) -> None:
        own = (text or b"").split()
        words = [w.lower() for w in own]
        self.n = n = len(words)
        self.bare = [w.strip(_STRIP) for w in words]
        counts = Counter(self.bare)
        self.repeated = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n - 1)
        self.top = max((c for w, c in counts.items() if len(w) > 3), default=0) / max(1, n)
        self.symbols = sum(1 for w in words if _SYMBOLS.search(w)) / max(1, n)
        self.shouted = sum(1 for w in own if len(w) > 3 and w.isupper() or w.endswith(b"!!")) / max(1, n)
        self.bars = sum(1 for w in words if w == b"|") / max(1, n)
        self.length = sum(map(len, self.bare)) / max(1, n)
        self.short = sum(1 for w in self.bare if 0 < len(w) <= 3) / max(1, n)
        self.abusive = not ABUSE.isdisjoint(counts)
        self.kinds = counts.keys()

    def votes(self) -> list[int]:
        n = self.n
        against = [
            2 if n >= 8 and self.repeated > 0.2 else 0,
            2 if n >= 20 and self.top > 0.2 else 0,
            2 if n >= 4 and self.symbols > 0.3 else 0,
            2 if n >= 4 and self.bars > 0.15 else 0,
            2 if n >= 4 and self.shouted > 0.3 else 0,
            2 if n >= 4 and not 2 <= self.length <= 14 else 0,
            2 if self.abusive else 0,
        ]
        return [*against, 1 if n >= 8 and self.short > 0.15 and not any(against) else 0]

    def features(self) -> np.ndarray:
        """Distinct hashed features: words, their first 4 and 5 bytes, and coarse levels of the measures."""
        crc, found = zlib.crc32, set()
        for w in self.kinds:
            found.add(crc(w))
            if len(w) > 4:
                found.add(crc(b"4" + w[:4]))
                if len(w) > 5:
                    found.add(crc(b"5" + w[:5]))
        for name, x in (("repeated", self.repeated), ("top", self.top), ("symbols", self.symbols), ("bars", self.bars), ("shouted", self.shouted), ("short", self.short)):
            found.add(crc(f"\0{name}{min(9, int(x * 10)) if self.n >= 4 else -1}".encode()))
        found.add(crc(f"\0length{min(20, int(self.length))}".encode()))
        return np.fromiter(found, np.int64, len(found)) & (WIDTH - 1)


def accuracies(patterns: np.ndarray, counts: np.ndarray, beforehand: tuple[float, float] = BEFOREHAND, as_votes: float = AS_VOTES, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of reject for each vote pattern, accuracy of each labeller), by expectation-maximisation.

    A labeller that votes is right with its accuracy, whatever the class; one that doesn't vote says nothing. The first one
    is the annotators. All accuracies are estimated, theirs too: from where votes overlap, and from what is thought
    beforehand, which counts as as_votes votes. Both classes are as likely beforehand.
    """
    m = patterns.shape[1]
    prior = np.array([beforehand[0], *[beforehand[1]] * (m - 1)])
    right, side = prior.copy(), np.where(patterns == 2, 1.0, np.where(patterns == 1, -1.0, 0.0))
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-(side @ np.log(right / (1 - right)))))
        agreed = ((side > 0) * post[:, None] + (side < 0) * (1 - post[:, None])) * counts[:, None]
        new = np.clip((agreed.sum(0) + as_votes * prior) / (((side != 0) * counts[:, None]).sum(0) + as_votes), 0.05, 0.999)
        moved, right = np.abs(new - right).max(), new
        if moved < 1e-9:
            break
    return post, right


def weight(posterior: np.ndarray, annotated: np.ndarray, any_annotated: bool = True) -> np.ndarray:
    """How much a document counts: in full if annotators judged it, else by how far the heuristics' evidence goes; steeply where
    there are annotators, so that the many documents of which no labeller knows much don't drown what they say."""
    p = np.clip(posterior, 1e-9, 1 - 1e-9)
    sure = np.minimum(1, np.abs(np.log(p / (1 - p))) / math.log(SURE / (1 - SURE)))
    return np.where(annotated, 1.0, sure ** (8 if any_annotated else 1))


def fitted(rows: list[np.ndarray], targets: np.ndarray, weights: np.ndarray, epochs: int = 16, batch: int = 128, rate: float = 0.3, decay: float = 1e-5, least: float = 15.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, their weights, bias) of a logistic scorer over hashed features, by Adagrad over shuffled batches.

    Only features whose documents' targets differ from the rest's count: a likelihood ratio (G) of `least` or more."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    docs, bad = weights.sum(), (weights * targets).sum()
    with_, with_bad = np.zeros(WIDTH), np.zeros(WIDTH)
    for at in range(0, len(rows), 512):  # a few rows at a time: all together would be large
        some = slice(at, at + 512)
        columns, sizes = np.concatenate(rows[some]), [len(r) for r in rows[some]]
        with_ += np.bincount(columns, np.repeat(weights[some], sizes), WIDTH)
        with_bad += np.bincount(columns, np.repeat((weights * targets)[some], sizes), WIDTH)
    g2 = np.zeros(WIDTH)
    for seen, all_ in ((with_bad, bad), (with_ - with_bad, docs - bad)):
        for n, total in ((seen, with_), (all_ - seen, docs - with_)):
            expected = np.maximum(total * all_ / docs, 1e-12)
            g2 += 2 * n * np.log(np.maximum(n, 1e-12) / expected)
    told = [r[g2[r] >= least] for r in rows]
    known, dense = np.unique(np.concatenate(told), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in told])])
    w, g, bias, gb = np.zeros(len(known)), np.ones(len(known)) * 1e-2, 0.0, 1.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        turn = order.permutation(len(rows))
        for at in range(0, len(turn), batch):
            some = turn[at : at + batch]
            cols = np.concatenate([dense[starts[i] : starts[i + 1]] for i in some])
            mine = np.repeat(np.arange(len(some)), starts[some + 1] - starts[some])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(mine, w[cols], len(some)) + bias, -30, 30)))
            err = (p - targets[some]) * weights[some]
            grad = np.bincount(cols, err[mine], len(known)) / len(some)
            touched = np.flatnonzero(grad)
            grad = grad[touched] + decay * w[touched]
            g[touched] += grad**2
            w[touched] -= rate * grad / np.sqrt(g[touched])
            gb += err.mean() ** 2
            bias -= rate * err.mean() / math.sqrt(gb)
    return known, w, float(bias)


def _annotated(labels: DataFrame | None, docs: DataFrame) -> DataFrame:
    """(id, mark): a row for each labelled doc_id: 2 if any of its labels is of low quality or toxic, else 1."""
    if labels is None:
        return docs.select(F.lit("").alias("id"), F.lit(0).alias("mark")).limit(0)
    mark = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 2).when(F.col("quality").isNull() & F.col("toxic").isNull(), 0).otherwise(1)
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max(mark).alias("mark"))


def _sample(voted: DataFrame, found: list, posterior: dict[str, float], sample: int, most_bytes: int) -> DataFrame:
    """(id, target, weight) of the documents to fit on: a bounded table."""
    spark = voted.sparkSession
    annotated = F.substring("votes", 1, 1) != "0"
    first = min(sample * ANNOTATED // SAMPLE, sum(r["count"] for r in found if r["votes"][0] != "0"))
    order = (F.xxhash64("id", F.lit(42)), F.col("id"))
    known = voted.filter("id is not null").groupBy("id").agg(F.max(F.struct("votes", "n_bytes")).alias("v")).select("id", "v.votes", "v.n_bytes")
    some = known.filter(annotated).orderBy(*order).limit(first).unionByName(known.filter(~annotated).orderBy(*order).limit(sample - first))
    some = some.withColumn("before", F.sum("n_bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("before") <= most_bytes)
    patterns = spark.createDataFrame([(k, float(p), float(weight(p, k[0] != "0", first > 0))) for k, p in posterior.items()], "votes string, target double, weight double")
    return stored(some.join(F.broadcast(patterns), "votes").select("id", "target", "weight"), "quality-sample")


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float, dict]:
    """(weights, bias, what the labellers were found to be): the weak-label model over all documents, the scorer on a sample.

    The driver sees a row for each pattern of votes and the scorer's weights. The sample's features are made where its
    texts are and go to one task, whose memory most_bytes bounds.
    """

    def vote(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            texts = raw(b.column("text"))
            votes = ["".join(map(str, Measures(t).votes())) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(votes, pa.string()), pa.array([len(t or b"") for t in texts], pa.int64())], names=["id", "votes", "n_bytes"])

    plain = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    votes = plain.mapInArrow(vote, "id string, votes string, n_bytes bigint")
    marks = _annotated(labels, docs)
    voted = stored(votes.join(marks, "id", "left").select("id", "n_bytes", F.concat(F.coalesce("mark", F.lit(0)).cast("string"), "votes").alias("votes")), "quality-votes")
    found = voted.groupBy("votes").count().orderBy("votes").collect()  # a row for each pattern of three votes: 3 ** 9 at most
    if not found:
        return np.zeros(WIDTH, np.float32), 0.0, {}
    post, right = accuracies(np.array([[int(c) for c in r["votes"]] for r in found]), np.array([r["count"] for r in found], float))
    chosen = _sample(voted, found, {r["votes"]: float(p) for r, p in zip(found, post, strict=True)}, sample, most_bytes)

    def featured(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            rows = [np.sort(Measures(t).features()).astype("<i4").tobytes() for t in raw(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("target"), b.column("weight"), pa.array(rows, pa.binary())], names=["id", "target", "weight", "features"])

    def train(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(i, t, w, f) for b in source for i, t, w, f in zip(*(b.column(c).to_pylist() for c in ("id", "target", "weight", "features")), strict=True)})
        heft = np.array([w for _, _, w, _ in rows])
        known, w, bias = fitted([np.frombuffer(f, "<i4") for *_, f in rows], np.array([t for _, t, _, _ in rows]), heft / max(heft.max(initial=0), 1e-9))  # what is known best counts in full
        yield pa.RecordBatch.from_pydict({"known": [known.astype("<i4").tobytes()], "w": [w.astype("<f4").tobytes()], "bias": [bias], "n": [len(rows)]})
        del rows
        give_back()

    # at most `sample` narrow rows, proven by the limits
    rows = stored(plain.join(F.broadcast(chosen), "id").mapInArrow(featured, "id string, target double, weight double, features binary"), "quality-features")
    got = rows.repartition(1).mapInArrow(train, "known binary, w binary, bias double, n bigint").first()
    weights = np.zeros(WIDTH, np.float32)
    weights[np.frombuffer(bytes(got["known"]), "<i4")] = np.frombuffer(bytes(got["w"]), "<f4")
    return weights, got["bias"], {"accuracies": dict(zip(LABELLERS, right.tolist(), strict=True)), "patterns": len(found), "sample": got["n"]}


def _probability(m: Measures, weights: np.ndarray, bias: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[m.features()].sum()) + bias)))) if m.n else 1.0


def scored(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """docs with n_words, p_reject and keep, which replace columns of these names. A text without words is not kept."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))
    plain = docs.drop("n_words", "p_reject", "keep")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = sent.value
        for b in batches(source):
            n, p = [], []
            for text in raw(b.column("text")):
                m = Measures(text)
                n.append(m.n)
                p.append(_probability(m, w, b0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(p, pa.float64()), pa.array([x <= 0.5 for x in p], pa.bool_())], names=[*b.schema.names, "n_words", "p_reject", "keep"])

    more = [StructField("n_words", LongType()), StructField("p_reject", DoubleType()), StructField("keep", BooleanType())]
    return plain.mapInArrow(run, StructType([*plain.schema.fields, *more]))


def kept(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """The documents that classify() keeps, in the columns they came with, whatever their names."""
    weights, bias, _ = fit(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def make() -> Callable[[pa.Array], list[bool]]:
        w, b0 = sent.value
        return lambda texts: [_probability(Measures(t), w, b0) <= 0.5 for t in raw(texts)]

    return sieved(docs, make)


def classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs with n_words, p_reject (the scorer's probability that the document is junk or toxic) and keep (p_reject <= 0.5).

    Overlapping labellers vote on every document: annotators where there is a label, and heuristics. The accuracies of all
    of them are estimated together by expectation-maximisation over the counts of all vote patterns, so heuristics that
    agree outvote a wrong label. The posterior labels of a bounded sample, documents with and without annotators' labels,
    train a logistic scorer on hashed words, word starts and levels of the heuristics, which judges every whole text.

    Nulls: a null text is empty; empty texts are not kept; a null doc_id is judged and never sampled. Null labels are no
    votes. Without labels the heuristics alone are the labellers. Repeated rows are judged alike. No documents give no rows.
    """
    weights, bias, _ = fit(docs, labels, sample)
    return scored(docs, weights, bias)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs.select("doc_id", "text"), labels).select("doc_id", "n_words", "p_reject", "keep")
