"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within a squared distance t = 2 - 2c. A
seeded rotation spreads a vector's energy evenly; the rotated vector is split
into blocks, and each block gets its share of t by size. If all blocks of two
vectors were farther apart than their shares, the whole would be farther than
t; so each linked pair is near in one block at least. Each block is range-
joined: vectors belong to the cell of their nearest pivot and visit the other
cells that their range reaches. A pair is checked exactly, on the original
vectors, in the first block that is near, hence once.

Equal vectors are one, with a count. Cells are cut into tiles of bounded size,
so a crowded cell is many tasks. Tasks return sums and spanning edges, never
pairs: at most one row per vector and tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import usable
from .common import drop_stored, store
from .components import connected_components

#: every block compares most pairs of vectors that point everywhere, so few blocks mean few products;
#: and pairs near by chance are one in a thousand in 8 dimensions, one in a quarter million in 16, none in 32
BLOCK_DIMS = 32
PIVOTS = 8
TILE = 16384
#: slack of the candidate steps against rounding; the final check has none
SLACK = 1e-5


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotate(u: np.ndarray) -> np.ndarray:
    """Rotated rows by element-wise sums in fixed order: a row's result does not depend on its batch."""
    q = rotation(u.shape[1])
    out = np.zeros_like(u)
    for j in range(u.shape[1]):
        out += u[:, j : j + 1] * q[j]
    return out


def splits(dim: int, size: int = BLOCK_DIMS) -> list[tuple[int, int]]:
    return [(a, min(a + size, dim)) for a in range(0, dim, size)]


def pivots(dim: int, a: int, b: int, count: int) -> np.ndarray:
    """Seeded pivots of a block: random directions at the length that a unit vector's block has on average."""
    p = np.random.default_rng(1000 + a).standard_normal((count, b - a))
    return p / np.linalg.norm(p, axis=1, keepdims=True) * np.sqrt((b - a) / dim)


def cells(y: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and the mask of the other cells that its range reaches.

    Of two cells only one receives the other's visitors.
    """
    d = np.maximum((y**2).sum(1)[:, None] + (p**2).sum(1) - 2 * y @ p.T, 0)
    home = d.argmin(1)
    gap = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))[home]
    near = (d - d[np.arange(len(y)), home][:, None]) <= 2 * (radius + SLACK) * gap + SLACK
    other = np.arange(len(p))
    return home, near & (other != home[:, None]) & ((other < home[:, None]) ^ ((other + home[:, None]) % 2 == 1))


def join_tile(left_ids, left, right_ids, right, weights_l, weights_r, guest, a: int, b: int, t: float, cosine: float):
    """Exact links of a tile: (ids, linked counts, roots of the ids linked with each other)."""
    dim = left.shape[1]
    ul, ur = unit(left), unit(right)
    q = rotation(dim)[:, a:b]
    yl, yr = ul @ q, ur @ q
    sq_l, sq_r = (left * left).sum(1), (right * right).sum(1)
    share = t * (b - a) / dim
    # one product of these gives squared distances
    yl = np.concatenate((-2 * yl, (yl**2).sum(1)[:, None], np.ones((len(yl), 1))), 1).astype(np.float32)
    yr = np.concatenate((yr, np.ones((len(yr), 1)), (yr**2).sum(1)[:, None]), 1).astype(np.float32).T.copy()
    ids = np.unique(np.concatenate((left_ids, right_ids)))
    at_l, at_r = np.searchsorted(ids, left_ids), np.searchsorted(ids, right_ids)
    count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for s in range(0, len(yl), 512):
        i, j = np.divmod(np.flatnonzero(yl[s : s + 512] @ yr <= np.float32(share + SLACK)), yr.shape[1])
        i += s
        ok = guest[j] & (left_ids[i] != right_ids[j]) | ~guest[j] & (left_ids[i] < right_ids[j])
        i, j = i[ok], j[ok]
        for c in range(0, len(i), 1 << 16):
            x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
            dot = np.einsum("ij,ij->i", ul[x], ur[y])
            linked = dot >= cosine - 1e-9
            x, y = x[linked], y[linked]
            if not len(x):
                continue
            exact = np.einsum("ij,ij->i", left[x], right[y]) / np.sqrt(sq_l[x] * sq_r[y]) >= cosine
            x, y = x[exact], y[exact]
            if not len(x):
                continue
            (row_x, in_x), (row_y, in_y) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
            diff = rotate(ul[row_x])[in_x] - rotate(ur[row_y])[in_y]
            near = [(diff[:, f:g] ** 2).sum(1) <= t * (g - f) / dim * (1 + 1e-9) for f, g in splits(dim) if f <= a]
            first = near[-1].copy()
            for n in near[:-1]:
                first &= ~n
            x, y = at_l[x[first]], at_r[y[first]]
            wl, wr = weights_l, weights_r
            count += np.bincount(x, wr[right_pos(y, at_r)], len(ids)).astype(np.int64) + np.bincount(y, wl[right_pos(x, at_l)], len(ids)).astype(np.int64)
            while True:  # smallest label on either side, then pointer jumping, until stable
                low = np.minimum(root[x], root[y])
                before = root.copy()
                np.minimum.at(root, root[x], low)
                np.minimum.at(root, root[y], low)
                np.minimum.at(root, x, low)
                np.minimum.at(root, y, low)
                root = root[root]
                if (root == before).all():
                    break
    hit = count > 0
    return ids[hit], count[hit], ids[root[hit]]


def right_pos(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions in ``at`` of the values y (each occurs there)."""
    place = np.empty(at.max() + 1, np.int64)
    place[at] = np.arange(len(at))
    return place[y]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``; further columns are left out.

    Unusable vectors (null, zero, with null or non-finite components) and those
    with a null id link with nothing and are their own component. Vectors of
    different lengths do not link. Equal vectors with different ids are linked
    with each other. Repeated rows (of equal id and vector) count once and get
    equal results; an id with several different vectors has a row for each, and
    they count as different vectors. An empty table gives an empty one.
    """
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    every = every.withColumn("ok", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = every.select("vec_id", "embedding").distinct()
    rows = rows.withColumn("ok", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    good = rows.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))
    good = store(good, "dups-vectors")
    t = 2 - 2 * cosine

    def deal(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["embedding"].map(len)):
                y = rotate(unit(np.stack(part["embedding"])))
                for k, (a, b) in enumerate(splits(dim)):
                    home, guest = cells(y[:, a:b], pivots(dim, a, b, PIVOTS), np.sqrt(t * (b - a) / dim))
                    row, cell = np.nonzero(guest)
                    pick = np.concatenate((np.arange(len(part)), row))
                    some = part.iloc[pick]
                    yield pd.DataFrame({"dim": dim, "part": k, "cell": np.concatenate((home, cell)), "guest": pick.size * [False] if not len(row) else np.arange(len(pick)) >= len(part), "rep": some["rep"].to_numpy(), "w": some["w"].to_numpy()})

    dealt = store(good.mapInPandas(deal, "dim int, part int, cell int, guest boolean, rep long, w long"), "dups-cells")
    key = ["dim", "part", "cell"]
    tiles = dealt.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    cut = dealt.join(tiles, key).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    all_tiles = F.sequence(F.lit(0), F.col("tiles") - 1)
    as_right = F.transform(all_tiles, lambda i: F.struct(i.alias("i"), F.col("mine").alias("j"), F.lit(False).alias("left")))
    as_left = F.when(~F.col("guest"), F.transform(all_tiles, lambda j: F.struct(F.col("mine").alias("i"), j.alias("j"), F.lit(True).alias("left")))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>"))
    placed = cut.select(*key, "guest", "rep", "w", F.explode(F.concat(as_left, as_right)).alias("at")).select(*key, "at.*", "guest", "rep", "w")
    placed = placed.join(good.select("rep", "embedding"), "rep")

    def link(table: pa.Table) -> pa.Table:
        dim, part = table["dim"][0].as_py(), table["part"][0].as_py()
        is_left = table["left"].to_numpy()
        flat = table["embedding"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
        rep, w, guest = (table[c].to_numpy() for c in ("rep", "w", "guest"))
        l, r = is_left, ~is_left
        got = ([], [], [])
        if l.any() and r.any():
            a, b = splits(dim)[part]
            got = join_tile(rep[l], flat[l], rep[r], flat[r], w[l], w[r], guest[r], a, b, t, cosine)
        return pa.table({n: pa.array(g, pa.int64()) for n, g in zip(("rep", "n", "root"), got)})

    links = store(placed.groupBy(*key, "i", "j").applyInArrow(link, "rep long, n long, root long"), "dups-links")
    drop_stored(dealt)
    comp = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    total = links.groupBy("rep").agg(F.sum("n").alias("n"))
    reps = good.join(total, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = every.join(reps.withColumn("ok", F.lit(True)), ["ok", "embedding"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
