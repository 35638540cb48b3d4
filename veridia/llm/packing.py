"""Token-ID output: best-fit-decreasing packing into fixed-length rows.

Documents of a block are sorted by length and each goes to the fullest row it
still fits; a segment tree over capacities finds that row in O(log L). Longer
documents are cut into full rows plus a rest, so nothing is lost. A packed row
holds the ids, cumulative segment lengths, and positions that restart with
every segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal, send, slices, small_batches

#: ids held in memory before a block is packed and written
BLOCK_TOKENS = 1 << 21


class CapacityTree:
    """A segment tree over 0..length that finds the smallest capacity >= need with an open row."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def push(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def pop(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) with the least capacity >= need, taken out; None if there is none."""
        i, count = need + self.leaves, self.count
        if not count[i]:
            while i > 1 and not (i & 1 == 0 and count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Items of each packed row; ties keep the items' order. All lengths are in 1..length."""
    tree, rows = CapacityTree(length), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.pop(lengths[item])
        capacity, row = found or (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append(item)
        if capacity > lengths[item]:
            tree.push(capacity - lengths[item], row)
    return rows


def pieces(n: int, length: int) -> list[tuple[int, int]]:
    """Start and end of the full rows and the rest of a document of n tokens."""
    return [(a, min(a + length, n)) for a in range(0, n, length)]


def pack_block(doc_ids: list, tokens: list[np.ndarray], length: int, pad: int):
    """Packed rows of a block: (doc_ids, starts in the documents, ids, cumulative lengths, positions)."""
    items = [(d, a, b) for d, t in enumerate(tokens) for a, b in pieces(len(t), length)]
    for row in best_fit_decreasing([b - a for _, a, b in items], length):
        ids = np.full(length, pad, np.int32)
        position = np.zeros(length, np.int32)
        ends, at = [0], 0
        for i in row:
            d, a, b = items[i]
            ids[at : at + b - a] = tokens[d][a:b]
            position[at : at + b - a] = np.arange(b - a)
            at += b - a
            ends.append(at)
        yield [doc_ids[items[i][0]] for i in row], [items[i][1] for i in row], ids, ends, position


#: the public word pattern of the 50k byte-level vocabularies (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def rank_encoder(ranks: dict[bytes, int], pattern: str = PATTERN):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [np.asarray(own.encode_ordinary(t), np.int32) for t in texts]


SCHEMA = "block string, row int, doc_ids array<long>, doc_starts array<int>, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary"


def pack_tokens(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 50256, pad: int = 50256) -> DataFrame:
    """Packed rows of all documents; ids and position_ids are little-endian int32.

    Every document ends with ``end_id``; a null or empty text is that id alone,
    a null doc_id stays null, repeated rows are documents of their own, further
    columns are left out, an empty table gives an empty one. Padding (which may
    equal ``end_id``) lies behind ``n_tokens``. Packing is done per block of ``BLOCK_TOKENS`` ids
    of a task's input, so memory is bounded and a lost task is simply run again.
    The rank file is read on the driver and broadcast (its size is fixed by the
    vocabulary).
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_path, "rb") as f:
        raw = send(docs.sparkSession, f.read())

    def run(batches):
        import base64

        from pyspark import TaskContext

        encode = rank_encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.value.splitlines())})
        task, block, ids, tokens, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            rows = list(pack_block(ids, tokens, length, pad))
            for i in range(0, len(rows), 256):
                part = rows[i : i + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{task}-{block}"] * len(part)),
                        pa.array(range(i, i + len(part)), pa.int32()),
                        pa.array([r[0] for r in part], pa.list_(pa.int64())),
                        pa.array([r[1] for r in part], pa.list_(pa.int32())),
                        pa.array([r[3][-1] for r in part], pa.int32()),
                        pa.array([r[2].astype("<i4").tobytes() for r in part], pa.binary()),
                        pa.array([r[3] for r in part], pa.list_(pa.int32())),
                        pa.array([r[4].astype("<i4").tobytes() for r in part], pa.binary()),
                    ],
                    names=["block", "row", "doc_ids", "doc_starts", "n_tokens", "ids", "cu_seqlens", "position_ids"],
                )

        for batch in batches:
            for some in slices(batch, batch.column(1), 64):
                texts = [t or "" for t in some.column(1).to_pylist()]
                for d, t in zip(some.column(0).to_pylist(), encode(texts)):
                    ids.append(d)
                    tokens.append(np.append(t, np.int32(end_id)))
                    held += len(t) + 1
                if held >= BLOCK_TOKENS:
                    yield from flush()
                    ids, tokens, held, block = [], [], 0, block + 1
        if ids:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(frugal(run), SCHEMA)
