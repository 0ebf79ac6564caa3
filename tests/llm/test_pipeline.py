"""Every stage of the pipeline against a plain version of it, on what the stage before kept."""

import hashlib
import math
import random
from collections import Counter

import pytest

import corpus_pipeline
from citelume.llm import common, decontamination, quality, token_shards

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b + c for a in "ab cd ef gh ij".split() for b in "klmn" for c in ("o", "pu", "ra")]


def prose(rng, n):
    return [rng.choice(["the", "of", "is", "to", "in"]) if rng.random() < 0.4 else rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]


def tables(spark, path):
    rng, rows = random.Random(21), []
    items = [" ".join(prose(rng, 30)) for _ in range(4)]
    for _ in range(150):
        words = prose(rng, rng.randrange(40, 160))
        if (kind := rng.random()) < 0.15:
            words = [w + "###" for w in words]
        elif kind < 0.25:
            at = rng.randrange(len(words))
            words[at:at] = rng.choice(items).split()[: rng.choice([12, 13, 20, 30])]
        elif kind < 0.45 and rows:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9))
        rows.append((len(rows), " ".join(words), "en", f"src{min(4, rng.randrange(12))}"))
    rows = [(*r, len(r[1])) for r in rows]
    labels = [(i, int("###" not in t), 0) for i, t, *_ in rows if i % 3 == 0]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, items


def good(docs, spark, path):
    weights, bias, _ = quality.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    score = lambda t: bias + sum(float(weights[f]) for f in quality.Measures(t.encode()).features().tolist())
    return [r for r in docs if score(r[1]) <= 0]


def distinct(docs):
    sets = [set(zip(*(r[1].split()[k:] for k in range(5)), strict=False)) for r in docs]
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    least = {}
    for x, r in zip(label, docs, strict=True):
        least[x] = min(least.get(x, r[0]), r[0])
    return [r for x, r in zip(label, docs, strict=True) if least[x] == r[0]]


def uncontaminated(docs, items):
    windows = set()
    for t in items:
        w = decontamination.words(t.encode())
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))}
    out = []
    for r in docs:
        w, hit = decontamination.words(r[1].encode()), set()
        for i in range(len(w) - 12):
            if tuple(w[i : i + 13]) in windows:
                hit |= set(range(i, i + 13))
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def mixed(docs):
    size = Counter()
    for r in docs:
        size[r[3]] += len(r[1].split())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    target, free, left = {}, set(size), float(sum(size.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        if not (over := {s for s in free if weight[s] * unit > 3 * size[s]}):
            break
        for s in over:
            target[s], left = 3.0 * size[s], left - 3.0 * size[s]
        free -= over
    target |= {s: weight[s] * unit for s in free}
    out = []
    for s in sorted(size):
        start, reps = 0, math.floor(target[s] / size[s])
        want = target[s] - reps * size[s]
        for r in sorted((r for r in docs if r[3] == s), key=lambda r: (hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), len(r[1].split()))):
            n = len(r[1].split())
            out += [r] * (reps + (want > 0 and start + n / 2 <= want))
            start += n
    return out


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    rows, items = tables(spark, path)
    plain = {"quality": lambda d: good(d, spark, path), "near_dedup": distinct, "decontamination": lambda d: uncontaminated(d, items), "mixture": mixed}
    docs, want, frame = rows, rows, spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, frame, path)
        if name == "tokens":
            break
        made.write.parquet(f"{path}/{name}")
        frame = spark.read.parquet(f"{path}/{name}")
        got, want = sorted(map(tuple, frame.collect())), sorted(plain[name](docs))
        assert got == want and (name == "mixture" or 0 < len(got) < len(docs))
        docs = got
    assert not any("###" in r[1] for r in docs)
    encode = token_shards.encoder(token_shards.VOCABULARY).encode_ordinary
    manifest = made.collect()
    assert sorted(r.slot for r in manifest) == list(range(len(manifest))) and sum(r.n_tokens for r in manifest) == sum(len(encode(r[1])) + 1 for r in docs)
    assert {i for r in manifest for i in r.doc_ids} == {r[0] for r in docs}


def test_run_leaves_little_behind(spark, tmp_path):
    tables(spark, str(tmp_path))
    before = common.named()
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and got.columns[0] == "slot"
    kept = common._SCRATCH[before:]
    assert sum("pipeline-" in p for p in kept) == 2  # the last documents and the manifest
    common.release(spark, before)
    with pytest.raises(Exception, match="not exist|FileNotFound|FAILED_READ_FILE"):
        got.collect()
