"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is halved again and again along its widest direction, which
gives lists of equal size whatever the density; their means are the centroids.
A centroid graph (nearest neighbours plus a few far links) is kept in memory
and searched by a beam. Every vector goes to its nearest list and, near a
boundary, to further lists that are almost as near (``1 + boundary`` times the
distance); a query reads the lists within ``1 + ratio`` times the distance of one
of its nearest centroids, however many those are. That centroid has half the
square root of the number of lists as its rank: the nearest one's own distance
varies more from query to query than that of those behind it. Answers are exact
distances on the original vectors.

There is one list for about ``list_size`` vectors, as long as the sample (of
``SAMPLE_BYTES`` at most) has eight for each list; the sample and the centroids
are all that reaches the driver. Neighbouring lists form shards. A shard's
vectors and the queries that probe its lists are dealt in salted blocks of
bounded size, so neither a crowded list nor a popular one is a hot task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, send, store

#: bytes of the sample that fits the lists
SAMPLE_BYTES = 32 << 20
LIST_SIZE = 24
#: lists of a shard
SHARD = 32
#: vectors, and queries, that one block of a shard holds
BLOCK_ROWS = 4096


def usable(vec) -> F.Column:
    """Whether a vector takes part: not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` (a power of two) equal parts, halved along the widest direction; neighbours stand together."""
    parts = [np.arange(len(x))]
    while len(parts) < lists:
        nxt = []
        for p in parts:
            y = x[p] - x[p].mean(0)
            v = np.ones(x.shape[1]) + np.arange(x.shape[1]) * 1e-3
            for _ in range(12):
                v = y.T @ (y @ v)
                v /= np.linalg.norm(v) + 1e-300
            order = np.argsort(y @ v, kind="stable")
            nxt += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
        parts = [p for p in nxt if len(p)]
    return np.stack([x[p].mean(0) for p in parts]).astype(np.float64)


def graph_links(c: np.ndarray, degree: int = 24, far: int = 4, seed: int = 3) -> np.ndarray:
    """For each centroid its ``degree`` nearest others and ``far`` random ones, found in blocks of bounded size."""
    k, sq = len(c), (c**2).sum(1)
    near = min(degree, k - 1)
    out = np.empty((k, near + far), np.int32)
    for a in range(0, k, 512):
        d = sq[None] - 2 * c[a : a + 512] @ c.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        if near:
            out[a : a + 512, :near] = np.argpartition(d, near - 1, 1)[:, :near]
    out[:, near:] = np.random.default_rng(seed).integers(0, k, (k, far))
    return out


class CentroidGraph:
    """Centroids and a navigable graph over them."""

    def __init__(self, centroids: np.ndarray, links: np.ndarray):
        self.c, self.links = centroids, links
        self.sq = (centroids**2).sum(1)
        self.entry = np.unique(np.linspace(0, len(centroids) - 1, min(len(centroids), 16)).astype(int))

    def beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and squared distances of about the ``width`` nearest centroids of each query, nearest first.

        All queries advance together: each step expands the nearest members of
        every beam that were not expanded yet, until none is left. Memory is a
        few beams, whatever the number of centroids.
        """
        n, width = len(q), min(width, len(self.c))
        expand = max(4, width // 16)
        qs, ids = (q**2).sum(1), np.tile(self.entry, (n, 1))
        d = np.maximum(qs[:, None] + self.sq[self.entry] - 2 * q @ self.c[self.entry].T, 0)
        done = np.zeros(ids.shape, bool)
        live = np.arange(n)
        full = [np.full((n, width), -1), np.full((n, width), np.inf)]
        while True:
            order = np.argsort(d, 1, kind="stable")[:, :width]
            ids, d, done = (np.take_along_axis(x, order, 1) for x in (ids, d, done))
            left = np.isfinite(d) & ~done
            ended = ~left.any(1)
            if ended.any():
                for out, x in zip(full, (ids, d)):
                    out[live[ended], : x.shape[1]] = x[ended]
                live, ids, d, done, left = (x[~ended] for x in (live, ids, d, done, left))
            if not len(live):
                full[0][~np.isfinite(full[1])] = -1
                return full[0], full[1]
            pick = np.argsort(~left, 1, kind="stable")[:, :expand]  # the nearest that are left
            real = np.take_along_axis(left, pick, 1)
            new = self.links[np.take_along_axis(ids, pick, 1)]
            new = np.where(real[:, :, None], new, -1).reshape(len(live), -1)
            np.put_along_axis(done, pick, True, 1)
            both = np.concatenate((ids, new), 1)
            order = np.argsort(both, 1, kind="stable")  # a beam's members stand before new ones of the same id
            told = np.take_along_axis(both, order, 1)
            again = np.zeros(both.shape, bool)
            np.put_along_axis(again, order[:, 1:], told[:, 1:] == told[:, :-1], 1)
            row, col = np.nonzero(~again[:, ids.shape[1] :] & (new >= 0))
            e = np.full(new.shape, np.inf)
            at = np.maximum(new, 0)
            e[row, col] = np.maximum(qs[live[row]] + self.sq[new[row, col]] - 2 * np.einsum("ij,ij->i", q[live[row]], self.c[new[row, col]]), 0)
            ids, d = np.concatenate((ids, at), 1), np.concatenate((d, e), 1)
            done = np.concatenate((done, np.zeros(new.shape, bool)), 1)

    def within(self, q: np.ndarray, ratio: float, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query row, centroid) of all centroids found within 1 + ratio times the reference distance; the beam widens until it holds them."""
        rank = max(1, int(len(self.c) ** 0.5 / 2))
        width = width or max(64, len(self.c) // 4)
        ids, d = self.beam(q, max(width, rank))
        limit = (1 + ratio) ** 2 * d[:, rank - 1 : rank] + 1e-12
        wide = (d[:, -1] <= limit[:, 0]) & (width < len(self.c))
        row, col = np.nonzero((d <= limit) & ~wide[:, None])
        out = [(row, ids[row, col])]
        if wide.any():
            at = np.flatnonzero(wide)
            row, found = self.within(q[at], ratio, 2 * width)
            out.append((at[row], found))
        return tuple(np.concatenate(x) for x in zip(*out))


def fit_lists(vectors: DataFrame, n: int, dim: int, list_size: int = LIST_SIZE, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Centroids from a sample of bounded size, chosen by a hash of the ids."""
    sample = max(1, sample_bytes // (4 * dim))
    rows = vectors.select("vec_id", F.col("v").cast("array<float>").alias("v")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    x = np.concatenate([np.asarray(c.flatten()) for c in rows["v"].chunks]).reshape(-1, dim).astype(np.float64)
    lists = 1
    while lists * 2 <= min(n / list_size, len(x) / 8):
        lists *= 2
    return balanced_centroids(x, lists)


def posting_rows(graph: CentroidGraph, x: np.ndarray, copies: int, boundary: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each vector: its nearest list and up to ``copies - 1`` more that are nearly as near."""
    ids, d = graph.beam(x, max(24, 2 * copies))
    ids, d = ids[:, :copies], d[:, :copies]
    near = (ids >= 0) & (d <= (1 + boundary) ** 2 * d[:, :1] + 1e-12)
    return np.nonzero(near)[0], ids[near]


def first_k(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best different vectors, ties to smaller ids."""
    order = np.lexsort((score, vec, query))
    again = (query[order][1:] == query[order][:-1]) & (vec[order][1:] == vec[order][:-1])
    order = order[np.concatenate(([True], ~again))] if len(order) else order
    order = order[np.lexsort((vec[order], score[order], query[order]))]
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int):
    """The k nearest rows of x for each q by exact distance, ties to smaller ids: (query id, vec id, distance)."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    xs = (x**2).sum(1)
    for a in range(0, len(q), 256):
        y, ids = q[a : a + 256], qid[a : a + 256]
        d = np.maximum(xs[None] - 2 * y @ x.T + (y**2).sum(1)[:, None], 0)
        d[ids[:, None] == xid[None]] = np.inf
        m = min(k, len(x))
        kth = np.partition(d, m - 1, 1)[:, m - 1]
        kth = np.where(np.isfinite(kth), kth + 1e-9 * (1 + kth + (y**2).sum(1)), np.finfo(float).max)  # all that may tie within rounding
        row, col = np.nonzero(d <= kth[:, None])
        score = np.sqrt(((x[col] - y[row]) ** 2).sum(1))
        best = first_k(ids[row], xid[col], score, k)
        out.append((ids[row][best], xid[col][best], score[best]))
    return [np.concatenate(o) for o in zip(*out)]


def matrix(column, dim: int) -> np.ndarray:
    """A list column of vectors of one length, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def runs(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct lists, starts and rows) of a column of list arrays: rows[starts[i]:starts[i + 1]] have the i-th list."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, sizes = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    names, starts = np.unique(flat[order], return_index=True)
    return names, np.append(starts, len(flat)), row[order]


def search(
    base: DataFrame, queries: DataFrame, k: int = 10, copies: int = 2, boundary: float = 0.1, ratio: float = 0.085,
    list_size: int = LIST_SIZE, sample_bytes: int = SAMPLE_BYTES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, its own id left out.

    ``base`` and ``queries`` have vec_id and embedding; further columns are left
    out. Unusable vectors and null ids take no part. Vectors are compared with
    those of their own length: the most frequent length has the lists, all
    vectors of another one are a list of their own. Repeated rows count once; an
    id with several vectors is as near as the nearest of them, as candidate and
    as query. Fewer than k candidates give fewer rows, ties go to smaller ids.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = base.sparkSession
    clean = lambda df: df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    base, queries = clean(base), clean(queries)
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n = sizes[0]["d"], sizes[0]["count"]
    centroids = fit_lists(base.where(F.size("v") == dim), n, dim, list_size, sample_bytes)
    # arrays, not the graph: a broadcast is unpickled where this package need not be installed
    sent = send(spark, (centroids, graph_links(centroids)))

    def place(select):
        """Batches of (vec_id, v) to (shard, lists, vec_id, v), by the (row, list) pairs that ``select`` gives."""

        def run(batches):
            graph = CentroidGraph(*sent.value)
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    some = batch.slice(a, 256)
                    size = np.asarray(some.column(1).value_lengths())
                    at = np.flatnonzero(size == dim)
                    row, name = select(graph, matrix(some.column(1).take(pa.array(at)), dim)) if len(at) else (np.zeros(0, int), np.zeros(0, int))
                    other = np.flatnonzero(size != dim)
                    row, name = np.concatenate((at[row], other)), np.concatenate((name, -SHARD * size[other]))
                    order = np.lexsort((name, row))
                    row, name = row[order], name[order]
                    shard = name // SHARD
                    cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])))) if len(row) else np.zeros(0, int)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(name)), pa.int32()), pa.array(name, pa.int64()))
                    picked = some.take(pa.array(row[cut]))
                    yield pa.RecordBatch.from_arrays([pa.array(shard[cut], pa.int64()), lists, picked.column(0), picked.column(1)], names=["shard", "lists", "vec_id", "v"])

        return frugal(run)

    kind = base.schema["v"].dataType.simpleString()
    placed = f"shard long, lists array<long>, vec_id long, v {kind}"
    postings = store(base.mapInArrow(place(lambda g, x: posting_rows(g, x, copies, boundary)), placed), "ann-lists")
    probes = store(queries.mapInArrow(place(lambda g, x: g.within(x, ratio)), placed), "ann-probes")

    def cut_up(table: DataFrame, other: DataFrame, own: str, others: str) -> DataFrame:
        """A table's rows with a block of their own, once for each block of the other table."""
        blocks = lambda t, name: t.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
        out = table.join(blocks(table, "mine"), "shard").join(blocks(other, "theirs"), "shard")
        out = out.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col("mine")).cast("int"))
        return out.withColumn(others, F.explode(F.sequence(F.lit(0), F.col("theirs") - 1))).drop("mine", "theirs")

    held, asked = cut_up(postings, probes, "block", "turn"), cut_up(probes, postings, "turn", "block")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            length = len(left["v"][0])
            q, x = matrix(left["v"], length), matrix(right["v"], length)
            qid, xid = np.asarray(left["vec_id"]), np.asarray(right["vec_id"])
            names, starts, rows = runs(left["lists"])
            at = {name: i for i, name in enumerate(names.tolist())}
            theirs, ends, mates = runs(right["lists"])
            for j, name in enumerate(theirs.tolist()):
                i = at.get(name)
                if i is not None:
                    mine, mate = rows[starts[i] : starts[i + 1]], mates[ends[j] : ends[j + 1]]
                    found.append(nearest(q[mine], qid[mine], x[mate], xid[mate], k))
        query, vec, score = (np.concatenate(c) for c in zip(*found))
        best = first_k(query, vec, score, k)
        return pa.table({"query_id": pa.array(query[best], pa.int64()), "vec_id": pa.array(vec[best], pa.int64()), "score": pa.array(score[best], pa.float64())})

    key = ["shard", "block", "turn"]
    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(answer, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
