"""MinHash near-dedup with odd sketches.

Every document's set of word shingles gives ``SAMPLES`` MinHash samples. Bands
of them find candidates; the samples are also folded into a parity bitmap
(odd sketch), whose XOR population count estimates high similarities precisely,
so that only promising candidates are confirmed, on the full sets.

Documents with equal sets are one from the start. In every band bucket each
document is compared with one seeded pivot, which differs from band to band, so
a group of m near copies costs m comparisons a band, not m * m. In buckets that
still hold several components, the sketches of members outside the largest
component are then compared with all members, in tiles of bounded size; a pair
leaves its task only in the first band that it shares and only if its estimate
makes a link between two components possible. Links are confirmed on full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, frugal, mix, schema_with, slices, small_batches, store, word_hashes
from .components import connected_components

WORDS = 5
ROWS = 6
#: bands at a threshold of 85; lower thresholds take more, see :func:`band_count`
BANDS = 22
#: a pair at the threshold shares no band with at most this probability
MISS = 3.1e-5
#: samples in all; those beyond the bands serve the sketch alone
SAMPLES = 448
SKETCH_BITS = 2048
#: links whose estimate is this far below the threshold (more than four standard deviations at 85) are not confirmed; see :func:`slack`
SLACK = 0.075
#: members of a bucket compared in one task
TILE_LEFT, TILE_RIGHT = 1024, 4096

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1, 1 << 32, SAMPLES, np.uint64).astype(np.uint32) | np.uint32(1)
TERMS = _rng.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32)
PLACES = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def band_count(threshold: int) -> int:
    """Bands that miss a pair at ``threshold`` per cent with a probability of at most MISS, BANDS at least."""
    n = math.ceil(math.log(MISS) / math.log1p(-((threshold / 100) ** ROWS))) if 0 < threshold < 100 else BANDS if threshold >= 100 else SAMPLES
    if n * ROWS > SAMPLES:
        raise ValueError(f"a threshold of {threshold} takes more than {SAMPLES // ROWS} bands")
    return max(BANDS, n)


def slack(threshold: int) -> float:
    """How far below the threshold an estimate still makes a link possible: 4.2 standard deviations, SLACK at least.

    The variance is that of the samples and that of bits which several differing samples share.
    """
    far = max(0.0, 1 - threshold / 100)
    spread = far * (1 - far) / SAMPLES + 2 * far * far / SKETCH_BITS * math.exp(8 * SAMPLES * far / SKETCH_BITS)
    return max(SLACK, 4.2 * math.sqrt(spread))


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles.

    Fewer than WORDS words are one shingle; no words, or null, none.
    """
    words, counts = word_hashes(column)
    ends = np.cumsum(counts)
    n = len(words)
    rolled = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled += words[k : n - WORDS + 1 + k] * PLACES[k] if n >= WORDS else np.uint64(0)
    rolled = mix(rolled)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        start = end - count
        if count >= WORDS:
            out.append(np.unique(rolled[start : end - WORDS + 1]))
        elif count:
            out.append(mix((words[start:end] * PLACES[:count]).sum(keepdims=True, dtype=np.uint64) + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a non-empty set, in bounded pieces."""
    h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 2048):
        np.minimum(low, (h[a : a + 2048, None] * FACTORS + TERMS).min(0), out=low)
    return low


def band_keys(samples: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key of each band."""
    rows = samples[: bands * ROWS].reshape(bands, ROWS).astype(np.uint64)
    places = mix(np.arange(100, 100 + ROWS, dtype=np.uint64)) | np.uint64(1)
    return mix((mix(rows) * places).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each of SKETCH_BITS bits, as 64-bit words."""
    h = mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32)))
    parity = np.bincount((h % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def estimate(differing) -> F.Column:
    """Similarity estimated from the number of differing sketch bits."""
    rest = F.greatest(1 - 2 * differing / SKETCH_BITS, F.lit(1e-6))
    return 1 + SKETCH_BITS / (4.0 * SAMPLES) * F.log(rest)


def signatures(docs: DataFrame, id_col: str, text_col: str, n_bands: int = BANDS) -> DataFrame:
    """id, n_shingles, set_key, bands and sketch (both null for an empty set) of every row."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, batch.column(1)):
                sets = shingle_sets(some.column(1))
                keys, bands, sketches = [], [], []
                for s in sets:
                    if not len(s):
                        keys.append(None), bands.append(None), sketches.append(None)
                        continue
                    samples = minhashes(s)
                    with np.errstate(over="ignore"):
                        keys.append(np.array([mix(s).sum(dtype=np.uint64), mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)]).tobytes() + len(s).to_bytes(8, "little"))
                    bands.append(band_keys(samples, n_bands).view(np.int64))
                    sketches.append(odd_sketch(samples))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    names=["id", "n_shingles", "set_key", "bands", "sketch"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), schema_with(rows.select("id"), n_shingles="long", set_key="binary", bands="array<long>", sketch="array<long>"))


def full_sets(texts: DataFrame) -> DataFrame:
    """id and its sorted distinct shingle hashes, as binary."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, batch.column(1)):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.tobytes() for s in shingle_sets(some.column(1))], pa.binary())], names=["id", "items"])

    return texts.mapInArrow(frugal(run), schema_with(texts.select("id"), items="binary"))


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= threshold * union."""
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "items": "set_a"}), "a").join(sets.withColumnsRenamed({"id": "b", "items": "set_b"}), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum())
                keep.append(100 * common >= threshold * (len(p) + len(q) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    both = both.select("a", "b", "set_a", "set_b")
    return both.mapInArrow(frugal(run), schema_with(both.select("a", "b")))


#: candidate ids up to this number are broadcast (8 MB) to pick their texts; beyond it they are joined by a shuffle
BROADCAST_IDS = 1_000_000
def pivoted(buckets: DataFrame) -> DataFrame:
    """key, id, pivot of the buckets (key, id) with several members.

    The pivot is the member least under a mask made from the key: another
    member for every bucket of the same group, found by a plain minimum.
    """
    mask = F.xxhash64("key")
    best = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("id").bitwiseXOR(mask)).alias("low"))
    best = best.where("n > 1").select("key", F.col("low").bitwiseXOR(mask).alias("pivot"))
    return buckets.join(best, "key")


def estimated(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sketches make a link possible, with their estimate."""
    both = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("_x")), "a")
    both = both.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("_y")), "b")
    differing = F.aggregate(F.zip_with("_x", "_y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return both.withColumn("est", estimate(differing)).where(F.col("est") >= threshold / 100 - slack(threshold)).select("a", "b", "est")


class Linker:
    """Confirmed links and the components that they make so far."""

    def __init__(self, texts: DataFrame, sketches: DataFrame, threshold: int):
        self.texts, self.sketches, self.threshold = texts, sketches, threshold
        self.components: DataFrame | None = None

    def labelled(self, rows: DataFrame, *names: str) -> DataFrame:
        """``rows`` with the component c_<name> of every named id column."""
        for name in names:
            if self.components is None:
                rows = rows.withColumn(f"c_{name}", F.col(name))
            else:
                rows = rows.join(self.components.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}")), name, "left")
                rows = rows.withColumn(f"c_{name}", F.coalesce(f"c_{name}", name))
        return rows

    def join_components(self, links: DataFrame) -> None:
        """Merge the components that newly confirmed links (a, b) join."""
        new = connected_components(self.labelled(links, "a", "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
        if self.components is None:
            self.components = new
            return
        old = self.components
        step = new.select(F.col("node").alias("component"), F.col("component").alias("label"))
        moved = old.join(step, "component", "left").select("node", F.coalesce("label", "component").alias("component"))
        fresh = new.join(old.select("node"), "node", "left_anti")
        self.components = store(moved.union(fresh), "mh-components")
        drop_stored(old, new)

    def test(self, pairs: DataFrame, turns) -> None:
        """Confirm candidates (a, b, est) in turns: of each turn, so many per document, then per pair of components; None: all."""
        pairs = store(pairs, "mh-pairs")
        n = pairs.count()
        if not n:
            drop_stored(pairs)
            return
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        ids = F.broadcast(ids) if 2 * n <= BROADCAST_IDS else ids
        sets = store(full_sets(self.texts.join(ids, "id", "left_semi")), "mh-sets")
        todo = pairs
        for turn, most in enumerate(turns):
            if most:
                by = Window.partitionBy(F.least("c_a", "c_b"), F.greatest("c_a", "c_b")) if turn else Window.partitionBy("a")
                todo = self.labelled(todo.select("a", "b", "est"), "a", "b").where("c_a <> c_b")
                todo = todo.withColumn("rank", F.row_number().over(by.orderBy(F.desc("est"), "a", "b"))).where(F.col("rank") <= most)
            links = store(confirm(todo.select("a", "b"), sets, self.threshold), "mh-links")
            if not links.isEmpty():
                self.join_components(links)
            drop_stored(links)
            todo = pairs
        drop_stored(sets, pairs)

    def across(self, buckets: DataFrame, own: DataFrame) -> DataFrame:
        """Candidates (a, b, est) between different components of the same bucket (key, id), each once."""
        held = self.labelled(buckets.select("key", "id"), "id")
        part = held.groupBy("key", "c_id").agg(F.count(F.lit(1)).alias("n"))
        part = part.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c_id")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        tiles = part.select("key", F.col("top.c_id").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / TILE_LEFT).cast("int").alias("lefts"), F.ceil(F.col("n") / TILE_RIGHT).cast("int").alias("rights"))
        held = held.join(tiles, "key").withColumn("small", F.col("c_id") != F.col("main"))
        own_i, own_j = F.pmod(F.xxhash64("id"), "lefts").cast("int"), F.pmod(F.xxhash64("id"), "rights").cast("int")
        as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(i.alias("i"), own_j.alias("j"), F.lit(False).alias("left")))
        as_left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: F.struct(own_i.alias("i"), j.alias("j"), F.lit(True).alias("left")))
        both = F.when(F.col("small"), F.concat(as_left, as_right)).otherwise(as_right)
        placed = held.select("key", "id", "c_id", "small", F.explode(both).alias("at")).select("key", "at.*", "id", "c_id", "small").join(own, "id")
        least, n_bands = self.threshold / 100 - slack(self.threshold), band_count(self.threshold)

        def compare(table: pa.Table) -> pa.Table:
            is_left = table["left"].to_numpy()
            out = ([], [], [])
            if is_left.any() and not is_left.all():
                key = table["key"][0].as_py()
                ids, comp, small = (table[c].to_numpy() for c in ("id", "c_id", "small"))
                sketch = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_BITS // 64)
                bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, n_bands)
                l, r = np.flatnonzero(is_left), np.flatnonzero(~is_left)
                for at in range(0, len(l), 64):
                    x = l[at : at + 64]
                    differing = np.zeros((len(x), len(r)), np.int32)
                    for k in range(sketch.shape[1]):
                        differing += np.bitwise_count(sketch[x, k][:, None] ^ sketch[r, k][None])
                    est = 1 + SKETCH_BITS / (4.0 * SAMPLES) * np.log(np.maximum(1 - 2 * differing / SKETCH_BITS, 1e-6))
                    ok = (est >= least) & (comp[x][:, None] != comp[r][None]) & (~small[r][None] | (ids[x][:, None] < ids[r][None]))
                    p, q = np.nonzero(ok)
                    a, b = x[p], r[q]
                    first = bands[a, (bands[a] == bands[b]).argmax(1)] == key
                    for column, v in zip(out, (ids[a], ids[b], est[p, q])):
                        column.append(v[first])
            a, b, est = (np.concatenate(c) if c else np.zeros(0) for c in out)
            return pa.table({"a": pa.array(np.minimum(a, b).astype(np.int64)), "b": pa.array(np.maximum(a, b).astype(np.int64)), "est": pa.array(est.astype(np.float64))})

        return placed.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long, est double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85) -> DataFrame:
    """id_col, n_shingles, component_id and kept for every row of ``docs``.

    Ids are integers. Documents link where 100 * intersection >= threshold *
    union of their shingle sets; empty sets (null or empty texts) and null ids
    link with nothing. Repeated rows get equal results. A pair at the threshold
    is found in some band with probability 0.99997; thresholds that take more
    than SAMPLES // ROWS bands for that (below about 72) raise ValueError.
    """
    small_batches(docs.sparkSession)
    sig = store(signatures(docs, id_col, text_col, band_count(threshold)), "mh-signatures")
    real = sig.where("set_key is not null and id is not null")
    reps = store(real.groupBy("set_key").agg(F.min("id").alias("rep")), "mh-reps")
    own = real.join(reps.select("set_key", F.col("rep").alias("id")), ["set_key", "id"], "left_semi")
    own = store(own.select(F.col("id").cast("long").alias("id"), "bands", "sketch"), "mh-own")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    linker = Linker(texts, own.select("id", "sketch"), threshold)
    buckets = store(pivoted(own.select(F.explode("bands").alias("key"), "id")), "mh-buckets")
    star = buckets.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    linker.test(estimated(star, linker.sketches, threshold), (1, 4))
    linker.test(linker.across(buckets, own), (None,))
    drop_stored(buckets)
    out = sig.select("id", "n_shingles", "set_key").join(reps, "set_key", "left")
    out = linker.labelled(out.withColumn("rep", F.coalesce("rep", "id")), "rep")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("c_rep").alias("component_id"), F.coalesce(F.col("c_rep") == F.col("id"), F.lit(True)).alias("kept"))
