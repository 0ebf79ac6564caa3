"""The suffix tree against one that is built from plain counts."""

import math
import random
from collections import Counter, defaultdict

import pytest

from citelume.llm import suffix_tree

WORDS = [a + b for a in "ab cd ef gh".split() for b in "klmnop"]


def corpus():
    rng = random.Random(3)
    phrases = [[rng.choice(WORDS) for _ in range(rng.randrange(2, 7))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(0, 14)):
            words += rng.choice(phrases) if rng.random() < 0.6 else [rng.choice(WORDS) + (str(rng.randrange(30)) if rng.random() < 0.3 else "")]
        rows.append((i, " ".join(words)))
    return [*rows, (500, None), (501, "ÉÜ x\x1cy"), (None, "no id")]


class Tree:
    def __init__(self, rows, depth):
        self.texts = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
        self.depth, self.count, self.next = depth, Counter(), defaultdict(Counter)
        for (i, _), words in zip(rows, self.texts, strict=True):
            if not suffix_tree.held_out(i):
                self.count.update(words)
                for k, w in enumerate(words):
                    for d in range(1, min(depth, k) + 1):
                        self.next[tuple(words[k - d : k])][w] += 1
        self.kept = set()
        for d in range(1, depth + 1):
            self.kept |= {c for c in self.next if len(c) == d and (d == 1 or c[1:] in self.kept) and self.gain(c) >= suffix_tree.GAIN}

    def smoothed(self, context, word, below):
        n = self.next.get(context, Counter())
        total = sum(n.values())
        return max(n[word] - suffix_tree.DISCOUNT, 0) / total + suffix_tree.DISCOUNT * len(n) / total * below(context[1:], word)

    def p(self, context, word):
        return self.smoothed(context, word, self.p) if context else (self.count[word] + 1) / (sum(self.count.values()) + len(self.count) + 1)

    def below(self, context, word):
        """What the test sees: the root and contexts of one word are rounded."""
        if len(context) > 1:
            return self.smoothed(context, word, self.below)
        return math.exp(-round(-suffix_tree.STEPS * math.log(self.p(context, word))) / suffix_tree.STEPS)

    def gain(self, context):
        n = self.next[context]
        total = sum(n.values())
        if total < suffix_tree.CONTEXT:
            return -math.inf
        share = suffix_tree.DISCOUNT * len(n) / total
        return sum(m * math.log(max(m - 1 - suffix_tree.DISCOUNT, 0) / max(total - 1, 1) / self.below(context[1:], w) + share) for w, m in n.items())

    def state(self, words, k):
        d = 0
        while d < min(self.depth, k) and tuple(words[k - d - 1 : k]) in self.kept:
            d += 1
        return tuple(words[k - d : k])


@pytest.mark.parametrize(("block", "bucket", "hot", "depth"), [(12 << 20, 16 << 20, 1 << 20, 4), (500, 1500, 1 << 20, 4), (500, 1500, 60, 4), (500, 1500, 8, 4), (500, 1500, 8, 2), (500, 1500, 8, 1)])
def test_against_plain_counts(spark, monkeypatch, block, bucket, hot, depth):
    monkeypatch.setattr(suffix_tree, "BLOCK", block)
    monkeypatch.setattr(suffix_tree, "BUCKET", bucket)
    rows = corpus()
    tree = Tree(rows, depth)
    assert len(tree.kept) > 20
    got = sorted(suffix_tree.score(spark.createDataFrame(rows, "doc_id bigint, text string"), depth, hot).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    for r, i in zip(got, order, strict=True):
        words = tree.texts[i]
        states = [tree.state(words, k) for k in range(len(words))]
        assert (r.doc_id, r.n_tokens, r.n_context) == (rows[i][0], len(words), sum(map(bool, states)))
        assert math.isclose(r.score, sum(math.log10(tree.p(s, w)) for s, w in zip(states, words, strict=True)), rel_tol=1e-6)


def test_next_words_sum_to_one():
    tree = Tree(corpus(), 4)
    known = list(tree.count)
    unseen = len([0])  # all unknown words together have the root's one share of nothing seen
    for context in sorted(tree.kept)[:20]:
        total = sum(tree.p(context, w) for w in known) + unseen * tree.p(context, b"never seen")
        assert math.isclose(total, 1, rel_tol=1e-9)
