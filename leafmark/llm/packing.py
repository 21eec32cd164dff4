"""Packing documents into training windows by Karmarkar-Karp multiway differencing.

A document's tokens and its end mark are cut into pieces of window size; full pieces are windows as they are,
and what is left over is cut into pieces of up to a quarter window that join others. They are taken in groups of fixed size as they stream by,
and each group is divided into windows by differencing: partial partitions, each a list of window sums, start
with one piece; the two of largest spread are merged again and again, the largest sums of one meeting the
smallest of the other, so that imbalances oppose and cancel. All windows of a group come out nearly equal. If
one exceeds the capacity, the number of windows rises and the group is divided anew.

A group lives in one task and has a fixed size, so memory is bounded and nothing is shuffled; a skewed key cannot
matter as there is no key. A sequence_id is made of the partition and a running number within it. It
depends on how the input is partitioned, as the packing does; each is the same whenever a task is repeated.

Cases: a null or empty text is just its end mark; repeated rows are packed once each; null doc_ids pass; an empty
table gives no pieces. Very long texts become full windows and a few pieces, whatever runs of blanks they hold. Further columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


WINDOW = 2048
#: Pieces in a group, and the largest piece that goes into one: many smaller pieces leave differencing a fine balance.
GROUP = 3072
PIECE = 512
#: Ids (or pieces, without ids) that a task gives back at once.
HELD = 1 << 19
VOCABULARY = "byte_bpe_50k"
END = 1

_encoders: dict[str, object] = {}


def _place(vocabulary: str, kind: str) -> str:
    import public_tokenizers

    return f"{vocabulary}.{kind}" if os.sep in vocabulary else public_tokenizers.path(f"{vocabulary}.{kind}")


def slow_encoder(vocabulary: str):
    """The JSON file's own library: slower, but without a limit on runs of blanks."""
    key = f"{vocabulary}.json"
    if key not in _encoders:
        from tokenizers import Tokenizer

        _encoders[key] = Tokenizer.from_file(_place(vocabulary, "json"))
    return _encoders[key]


def encoder(vocabulary: str):
    """The byte-level BPE of a public vocabulary, with the added tokens of its JSON file.

    The rank file holds the vocabulary and merges of the JSON file of the same name, and the encoder here gives the ids that the JSON
    file's own library gives by default, several times as fast (tests hold the two against each other): strings of
    added tokens in a text are these tokens.
    """
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(_place(vocabulary, "tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        with open(_place(vocabulary, "json"), encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        _encoders[vocabulary] = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _encoders[vocabulary]


def token_ids(text: str | None, vocabulary: str, end: int = END) -> np.ndarray:
    """Ids of the whole text, then the end mark."""
    try:
        ids = encoder(vocabulary).encode_to_numpy(text, allowed_special="all", disallowed_special=()) if text else np.empty(0, np.uint32)
    except ValueError:  # its pattern gives up on runs of a million blanks or so
        ids = np.array(slow_encoder(vocabulary).encode(text, add_special_tokens=False).ids)
    return np.append(ids.astype("<u4"), np.array([end], "<u4"))


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the indexes of sizes, divided into so many windows with nearly equal sums."""
    # A partial partition is its positive sums in ascending order; each carries a tree of the indexes in it.
    heap = [(-s, i, [(s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - windows)
        met = []
        for j in range(over):
            (s, i, tree), (t, k, other) = a[j], b[over - 1 - j]
            met.append((s + t, min(i, k), (tree, other)))
        merged = a[over:] + b[over:] + met
        merged.sort(key=lambda e: e[:2])
        low = merged[0][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[-1][0], number, merged))
        number += 1
    out = []
    for _, _, tree in heap[0][2] if heap else []:
        members, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                members.append(x)
        out.append(sorted(members))
    return out


def divide(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few near-equal windows as differencing finds without exceeding the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, windows)
        fullest = max((sum(sizes[i] for i in part) for part in parts), default=0)
        if fullest <= capacity:
            return parts
        windows += 1


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, window: int = WINDOW, vocabulary: str = VOCABULARY, end: int = END, with_ids: bool = True, group: int = GROUP) -> DataFrame:
    """Pieces of documents (doc_id, text) with their places in windows; with_ids adds each piece's ids."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        made = held = 0
        rows: list[tuple] = []
        waiting: list[tuple] = []

        def piece(doc_id, ids, start, stop):
            part = ids[start:stop]
            return (doc_id, start, stop - start, zlib.crc32(part.tobytes()), len(ids)), part

        def place(head, part, sequence, offset):
            nonlocal held
            rows.append((*head, base + sequence, offset, *([part.astype(np.int32)] if with_ids else [])))
            held += len(part) if with_ids else 1

        def flush():
            nonlocal made, waiting
            for members in divide([head[2] for head, _ in waiting], window):
                offset = 0
                for i in members:
                    place(*waiting[i], made, offset)
                    offset += waiting[i][0][2]
                made += 1
            waiting = []

        def out():
            nonlocal rows, held
            names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids
            frame = pd.DataFrame(rows, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            rows, held = [], 0
            return frame

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = token_ids(text, vocabulary, end)
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                full = len(ids) // window * window
                for start in range(0, full, window):
                    place(*piece(doc_id, ids, start, start + window), made, 0)
                    made += 1
                for start in range(full, len(ids), PIECE):
                    head, part = piece(doc_id, ids, start, min(start + PIECE, len(ids)))
                    waiting.append((head, part if with_ids else None))
                    if len(waiting) == group:
                        flush()
                # Few enough ids at a time, whatever the size of a batch.
                if held >= HELD:
                    yield out()
            yield out()
        flush()
        yield out()

    return docs.select("doc_id", "text").mapInPandas(packed, SCHEMA + ", ids array<int>" * with_ids)


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
