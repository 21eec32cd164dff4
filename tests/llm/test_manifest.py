"""The Merkle manifest against plain loops, on trees of several distributed levels and on awkward tables."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from conftest import SF

from leafmark.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, hash string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row, from the definition."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def siblings(tree, i):
        out = []
        for level in tree[:-1]:
            run = i // 3 * 3
            out.append((level[run:i], level[i + 1 : run + 3]))
            i //= 3
        return out

    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        own = sorted(by_source[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[source] = own, levels([leaf(r, r["text"]) for r in own])
    top = levels([trees[s][1][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        own, tree = trees[source]
        for i, r in enumerate(own):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            now = leaf(r, r["text"].replace("\n", "") if tampered else r["text"])
            proof = ""
            for left, right in siblings(tree, i) + siblings(top, k):
                now, proof = sha(*left, now, *right), proof + "".join(left + right)
            out.append((r["doc_id"], tree[0][i], tree[-1][0], top[-1][0], sha(proof), now))
    return out


def got(frame):
    rows = frame.collect()
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in rows)
    return [tuple(r)[:6] for r in rows]


def key(row):
    return tuple(map(str, row))


def awkward():
    rows = [(i, f"a{i}\nb\n{i % 7}", "en", f"s{i % 3}", i) for i in range(0, 90, 1)] + [(1000 + i, "x\ny", None, "hot", None) for i in range(82)]
    rows += [(None, None, None, None, None), (None, "t\n", "de", None, 3), (5, "", "en", "", 0), (5, "é\n中" * 200_000, "en", "s1", 1), (6, "\n", "en", "S", 2), (7, "q", "en", "é", 1)]
    return rows + rows[:4] + rows[-3:]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_trees_of_any_depth(spark, levels):
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in awkward()], SCHEMA)
    mine, plain = got(merkle.manifest(docs, levels)), expected([r.asDict() for r in docs.collect()])
    assert sorted(mine, key=key) == sorted(plain, key=key)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(2, "a\nb", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert got(merkle.manifest(one)) == expected([r.asDict() for r in one.collect()])
    empty = merkle.manifest(one.where("false"))
    assert empty.count() == 0 and empty.columns[:2] == ["doc_id", "leaf"]


def test_query_matches_sql(spark, duck, same):
    same(queries.QUERIES["op13_merkle"](spark, SF), duck.sql(queries.ORACLE_SQL["op13_merkle"]))
