"""Vector codes against an exhaustive integer search in plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import SF

from leafmark.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, v string"


def expected(rows, entries=64, rounds=2):
    """[(vec_id, label, code, error)] and the codebooks."""
    kept = [(i, label, [max(-(2**24), min(2**24, math.floor(256 * x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for *_, v in kept), default=0) // 16))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    parts = [[tuple((v + [0] * (16 * width))[p * width : (p + 1) * width]) for p in range(16)] for *_, v in kept]
    books = [[row[p] for row in parts[:entries]] for p in range(16)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for r in range(rounds + 1):
        best = [[nearest(row[p], books[p]) for p in range(16)] for row in parts]
        if r < rounds:
            for p in range(16):
                for e in range(len(books[p])):
                    own = [row[p] for row, b in zip(parts, best, strict=True) if b[p][1] == e]
                    if own:
                        books[p][e] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    return [(i, label, "".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b)) for (i, label, _), b in zip(kept, best, strict=True)], books


def check(spark, rows, entries=64, rounds=2):
    frame = spark.createDataFrame([(i, v, label, "clash", "clash") for i, v, label in rows], SCHEMA).repartition(3)
    coded, books = vector_codes.encode(frame, rounds, entries)
    plain, plain_books = expected(rows, entries, rounds)
    key = lambda r: tuple(map(str, r))
    got = [(r["vec_id"], None if r["label"] is None else int(r["label"]), r["code"], r["error"]) for r in coded.collect()]
    assert sorted(got, key=key) == sorted(plain, key=key)
    assert [[tuple(e) for e in book] for book in books.tolist()] == plain_books if plain else books.size == 0


def cloud(n, dim, seed, spread=0.05):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    return [(i, [x + r.gauss(0, spread) for x in centres[r.randrange(12)]], r.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("entries, rounds", [(64, 2), (20, 5), (1, 2)])
def test_codes_of_clouds(spark, entries, rounds):
    check(spark, cloud(300, 32, entries), entries, rounds)


def test_ties_and_awkward_vectors(spark):
    r = random.Random(4)
    grid = [(i, [r.choice([0.0, 1 / 256, -1 / 256, 2 / 256]) for _ in range(16)], None) for i in range(150)]
    odd = [(7, None, 1), (8, [None] * 16, 1), (9, [float("nan")] * 16, 1), (10, [float("inf")] + [0.0] * 15, 1), (None, [0.5] * 16, 2), (None, [0.5] * 16, 2), (11, [], 3), (12, [1.0], 3), (13, [-0.001] * 40, 3)]
    odd += [(14, [1e300, -1e300] * 8, 4), (15, [70000.0] * 16, 4), (16, [5e-324] * 16, 4)]
    check(spark, grid + odd + grid[:5])
    check(spark, odd)
    check(spark, [])
    check(spark, odd[:4])


def test_lists_rule_out_entries_without_a_search(spark, monkeypatch):
    """With little movement only uncertain parts are searched again, and lists shrink."""
    rows = [v for _, v, _ in cloud(400, 32, 9)]
    x = np.floor(256 * np.array(rows))[:, :2]
    books = x[:64].copy()
    part = vector_codes.Part(x, books)
    code, best, near, low, outer = part.search(np.arange(len(x)), 16)
    searched = []
    moved = vector_codes.Part(x, books + 1)
    monkeypatch.setattr(moved, "search", lambda rows, b, own=moved.search: searched.append(len(rows)) or own(rows, b))
    after = moved.verify(code, near, low, outer, np.full(64, 1.5))
    d = vector_codes.squares(x, books + 1)
    assert (after[0] == d.argmin(1)).all() and (after[1] == d.min(1)).all()
    assert sum(searched) < len(x) / 4 and np.median(after[-1]) < 8
    others = np.sqrt(d)
    others[np.arange(len(x)), after[0]] = np.inf
    listed = np.take_along_axis(others, after[2].astype(int), 1)
    assert (after[3] <= listed + 1e-6).all()
    np.put_along_axis(others, after[2].astype(int), np.inf, 1)
    assert (after[4] <= others.min(1) + 1e-6).all()


def test_query_matches_sql(spark, duck, same):
    same(queries.QUERIES["op12_vector_codes"](spark, SF), duck.sql(queries.ORACLE_SQL["op12_vector_codes"]))
