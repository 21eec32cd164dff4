"""Kneser-Ney scores against dictionaries of counts, on awkward tables and on real ones."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF

from leafmark.llm import language_model, queries

SCHEMA = "doc_id long, text string, n_tokens long, score string"


def tokens_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "</s>"]


class Plain:
    """Interpolated modified Kneser-Ney by its definition, with n-grams as tuples."""

    def __init__(self, texts, order):
        self.order = order
        raw = [collections.Counter() for _ in range(order + 1)]
        for t in texts:
            seq = ["<s>", *tokens_of(t)]
            for i in range(1, len(seq)):
                for k in range(1, order + 1):
                    if i - k + 1 >= (0 if k > 1 else 1):
                        raw[k][tuple(seq[i - k + 1 : i + 1])] += 1
        self.raw, self.tokens, self.words = collections.Counter({w: n for (w,), n in raw[1].items()}), sum(raw[1].values()), len(raw[1])
        self.counts = [None] * (order + 1)
        for k in range(1, order + 1):
            if k == order:
                self.counts[k] = dict(raw[k])
            else:
                before = collections.Counter(g[1:] for g in raw[k + 1])
                self.counts[k] = {g: before[g] if g[0] != "<s>" else n for g, n in raw[k].items()}
        self.d, self.after = [None], [None]
        for k in range(1, order + 1):
            n = collections.Counter(self.counts[k].values())
            if min(n[1], n[2], n[3]) == 0:
                self.d.append((0.5, 1.0, 1.5))
            else:
                y = n[1] / (n[1] + 2 * n[2])
                d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
                self.d.append(tuple(x if 0 <= x <= i else i / 2 for i, x in enumerate(d, 1)))
            after = collections.defaultdict(lambda: [0, 0.0])
            for g, c in self.counts[k].items():
                after[g[:-1]][0] += c
                after[g[:-1]][1] += self.d[k][min(c, 3) - 1]
            self.after.append(dict(after))

    def p(self, gram):
        if not gram:
            return 1 / (self.words + 1)
        k = len(gram)
        follow = self.after[k].get(gram[:-1])
        lower = self.p(gram[1:])
        if not follow:
            return lower
        c = self.counts[k].get(gram, 0)
        return ((c - self.d[k][min(c, 3) - 1]) if c else 0) / follow[0] + follow[1] / follow[0] * lower

    def score(self, text):
        seq = ["<s>", *tokens_of(text)]
        own = sum(math.log10(self.p(tuple(seq[max(0 if self.order > 1 else i, i - self.order + 1) : i + 1]))) for i in range(1, len(seq)))
        base = sum(math.log10((self.raw[w] + 0.5) / (self.tokens + 0.5 * (self.words + 1))) for w in seq[1:])
        return len(seq) - 1, sum(self.raw[w] > 0 for w in seq[1:]), base, own


def prose(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "ÄB", "x" * 40] + ["".join(r.choices("abc", k=r.randint(1, 3))) for _ in range(40)]
    return " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))


def awkward():
    rows = [(i, prose(i, 5 * i)) for i in range(40)] + [(100, None), (101, ""), (102, " \n\t"), (103, "one"), (None, prose(3, 50)), (104, " a b \x1f"), (105, "w" * 300_000), (106, "the " * 30_000)]
    return rows + rows[:3] + [(None, None)]


@pytest.mark.parametrize("order, many", [(1, False), (2, True), (3, True), (3, False)])
def test_scores_are_those_of_the_definition(spark, monkeypatch, order, many):
    if many:  # shards
        monkeypatch.setattr(language_model, "_sampled_bounds", lambda docs, k: [np.array([i * (2**64 // 7) for i in range(1, 7)], np.uint64)] * k)
    docs = spark.createDataFrame([(*r, 1, "clash") for r in awkward()], SCHEMA).repartition(4)
    model = language_model.train(docs.where("doc_id is null or doc_id % 5 <> 1"), order)
    plain = Plain([t for i, t in awkward() if i is None or i % 5 != 1], order)
    assert (model.tokens, model.words) == (plain.tokens, plain.words)
    assert np.allclose(model.discounts, plain.d[1:])
    got = sorted((tuple(r) for r in language_model.score(docs, model).collect()), key=lambda r: (str(r[0]), r[4]))
    want = sorted(((i, *plain.score(t)) for i, t in awkward()), key=lambda r: (str(r[0]), r[4]))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], rtol=1e-6)


def test_probabilities_sum_to_one():
    plain = Plain([prose(i, 60) for i in range(8)], 3)
    for context in [("<s>",), ("<s>", "the"), ("of", "the"), ("never", "seen")]:
        total = sum(plain.p((*context, w[0])) for w in plain.counts[1]) + plain.p((*context, "unknown word"))
        assert abs(total - 1) < 1e-9


def test_nothing_to_train_on(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (row,) = language_model.score(docs, language_model.train(docs.where("false"))).collect()
    assert row["n_known"] == 0 and row["score"] == 0 and row["n_tokens"] == 3
    assert language_model.score(docs.where("false"), language_model.train(docs)).count() == 0


def test_query_and_its_held_out_texts(spark, duck):
    rows = queries.QUERIES["op11_language_model"](spark, SF).collect()
    own = duck.sql("select doc_id, text from documents").fetchall()
    assert len(rows) == len(own)
    out = {i for i, _ in own if zlib.crc32(str(i).encode()) % 5 == 1}
    plain = Plain([t for i, t in own if i not in out], language_model.ORDER)
    want = {i: plain.score(t) for i, t in own}
    for r in rows:
        assert r["held_out"] == (r["doc_id"] in out) and r["train_tokens"] == plain.tokens
        assert (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][:2]
        assert np.allclose([r["base_score"], r["score"]], want[r["doc_id"]][2:], rtol=1e-6)
    # Held-out texts are more likely under the model than by single words.
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])
