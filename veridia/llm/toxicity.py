"""Toxicity: subword-bag embeddings averaged into a linear softmax.

Words are bags of hashed character n-grams (3 to 5 bytes, with word borders)
plus the whole word; every n-gram has a small embedding, a document is the
average of its words, and a linear softmax reads that average. Embeddings and
softmax are trained jointly in numpy. An unseen misspelling shares most n-grams
with known words, hence their vectors. The same value is also averaged over
windows of ``WINDOW`` words, so that a toxic passage in a long text still
shows; a calibration learned on held-back sample rows joins the two.

Training takes at most ``sample`` labelled rows, chosen by a hash of doc_id, and
of them as many as have ``words`` distinct words in all; both bounds are
parameters. Texts stay on the executors, which send counted word hashes and the
n-gram buckets of the words to the driver. Scoring reads every word of every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, drop_stored, frugal, lower, mix, powers, schema_with, send, slabs, slices, small_batches, store, text_buffers, trim, trim_driver, word_bounds

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
WINDOW = 256
#: bags with fewer words average over this many
LEAST_WORDS = 24


def gram_events(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of every word of a slab with spaces around words."""
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((lower(buf).astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    lo, hi = starts - 1, ends + 1  # with one border byte on either side
    words, buckets = [], []
    of = np.arange(len(starts))
    for n in GRAMS:
        k = np.maximum(hi - lo - n + 1, 0)
        first = np.repeat(lo - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())
        words.append(np.repeat(of, k))
        buckets.append(mix((total[first + n] - total[first]) * down[first] + np.uint64(n)))
    words.append(of)
    buckets.append(mix((total[ends] - total[starts]) * down[starts] + np.uint64(99)))
    return np.concatenate(words), (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int32)


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the rows with a space before and after each, white space made plain."""
    raw, offsets = text_buffers(column)
    n = np.diff(offsets)
    at = np.concatenate(([0], np.cumsum(n + 2)))
    out = np.full(at[-1], 32, np.uint8)
    plain = np.where(SPACE[raw], np.uint8(32), raw)
    for i, start in enumerate((at[:-1] + 1).tolist()):
        out[start : start + n[i]] = plain[offsets[i] : offsets[i + 1]]
    return out, at


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((lower(buf).astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def slab_words(first: int, buf: np.ndarray, offs: np.ndarray):
    """A slab's bytes, word starts, word ends and rows; each word has a border byte on either side."""
    if buf[0] != 32 or buf[-1] != 32:  # a piece of a row cut elsewhere than at its ends
        buf, offs = np.concatenate(([32], buf, [32])).astype(np.uint8), np.array([0, len(buf) + 2])
    starts, ends = word_bounds(buf, offs)
    return buf, starts, ends, first + np.searchsorted(offs, starts, "right") - 1


def bag_values(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean word value of each row, and that of its highest window; ``table``: value of each bucket."""
    raw, offsets = padded(column)
    n = len(offsets) - 1
    total, words, best = np.zeros(n), np.zeros(n, np.int64), np.full(n, -np.inf)
    for first, buf, offs in slabs(raw, offsets):
        buf, starts, ends, row = slab_words(first, buf, offs)
        if not len(starts):
            continue
        word, bucket = gram_events(buf, starts, ends)
        value = np.bincount(word, table[bucket], len(starts)) / np.bincount(word, minlength=len(starts))
        total += np.bincount(row, value, n)
        index = np.arange(len(starts)) - np.searchsorted(row, row) + words[row]
        words += np.bincount(row, minlength=n)
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (index[1:] // WINDOW != index[:-1] // WINDOW)))
        cut = np.flatnonzero(new)
        size = np.diff(np.concatenate((cut, [len(row)])))
        np.maximum.at(best, row[cut], np.add.reduceat(value, cut) / np.maximum(size, LEAST_WORDS))
    return np.stack((total / np.maximum(words, LEAST_WORDS), np.where(words > 0, best, 0.0)), 1)


@dataclass
class ToxicityModel:
    table: np.ndarray  # logit of label 1 against 0 that each bucket adds
    slopes: tuple[float, ...]
    shift: float

    def features(self, column: pa.Array) -> np.ndarray:
        parts = [bag_values(some, self.table) for some in slices(column, column)]
        return np.concatenate(parts) if parts else np.zeros((0, 2))

    def score(self, column: pa.Array) -> np.ndarray:
        x = self.features(column) @ np.array(self.slopes) + self.shift
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def counted_words(column: pa.Array):
    """(words, hashes, counts) of each text: how many words it has, and its distinct ones with their counts."""
    raw, offsets = padded(column)
    n = len(offsets) - 1
    length, parts = np.zeros(n, np.int64), [[] for _ in range(n)]
    for first, buf, offs in slabs(raw, offsets):
        buf, starts, ends, row = slab_words(first, buf, offs)
        name = span_hash(buf, starts, ends)
        length += np.bincount(row, minlength=n)
        cut = np.flatnonzero(np.diff(row, prepend=-1))
        for i, j in zip(cut, [*cut[1:], len(row)]):
            parts[row[i]].append(name[i:j])
    for i in range(n):
        name, count = np.unique(np.concatenate(parts[i]), return_counts=True) if parts[i] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield int(length[i]), name, count.astype(np.int32)


def buckets_of(column: pa.Array, types: np.ndarray):
    """(hash, buckets) of the words of the texts that are among the sorted ``types``, each once per piece of text."""
    raw, offsets = padded(column)
    for first, buf, offs in slabs(raw, offsets):
        buf, starts, ends, _ = slab_words(first, buf, offs)
        name, one = np.unique(span_hash(buf, starts, ends), return_index=True)
        known = types[np.minimum(np.searchsorted(types, name), len(types) - 1)] == name
        name, one = name[known], one[known]
        of, bucket = gram_events(buf, starts[one], ends[one])
        order = np.argsort(of, kind="stable")
        ends_at = np.searchsorted(of[order], np.arange(len(name) + 1))
        for i in range(len(name)):
            yield name[i], bucket[order[ends_at[i] : ends_at[i + 1]]]


@dataclass
class Sample:
    """Counted words of the training documents, in order of doc_id."""

    labels: np.ndarray
    length: np.ndarray  # words of each document
    row: np.ndarray  # of each distinct word of each document: the document,
    name: np.ndarray  # the word's hash
    count: np.ndarray  # and how often it occurs

    def types(self) -> np.ndarray:
        """Words of two documents or more."""
        types, seen = np.unique(self.name, return_counts=True)
        return types[seen > 1]


def shuffled(n: int, seed: int = 7) -> tuple[np.ndarray, int]:
    """The documents in training order, and how many at its end are held back."""
    return np.random.default_rng(seed).permutation(n), max(1, n // 5)


def train(data: Sample, types: np.ndarray, word: np.ndarray, bucket: np.ndarray, dims: int = 4, steps: int = 100, smooth: float = 0.3, rate_e: float = 1.5, seed: int = 7) -> np.ndarray:
    """Joint training of embeddings and softmax; the logit that each bucket adds.

    ``word`` and ``bucket`` are the n-gram buckets of the words ``types``.
    Embeddings start from each n-gram's smoothed log odds, then they and the
    softmax are trained together. A fifth of the sample (in random order) is
    held back: the steps with the least loss there are kept.
    """
    y, n_types = data.labels, len(types)
    order, cut = shuffled(len(y), seed)
    order = np.concatenate((order[cut:], order[:cut]))
    rng = np.random.default_rng(seed + 1)
    kind = np.minimum(np.searchsorted(types, data.name), n_types - 1)
    use = types[kind] == data.name
    place = np.empty(len(y), np.int32)
    place[order] = np.arange(len(y))
    row, kind, count = place[data.row[use]], kind[use].astype(np.int32), data.count[use]
    length = data.length[order]
    fit = order[: len(y) - cut]
    per = np.bincount(word, minlength=n_types)
    share = (1 / per[word]).astype(np.float32)
    weight = (count / np.maximum(length, LEAST_WORDS)[row]).astype(np.float32)
    truth, n = np.stack((1 - y[order], y[order]), 1).astype(np.float64), len(fit)

    def bags(e: np.ndarray) -> np.ndarray:
        """Mean value of every document under one value per bucket."""
        return np.bincount(row, weight * np.bincount(word, share * e[bucket], n_types)[kind], len(order))

    def spread(v: np.ndarray) -> np.ndarray:
        """The gradient of each bucket from one of each document used for fitting."""
        return np.bincount(bucket, share * np.bincount(kind, weight * np.append(v, np.zeros(cut))[row], n_types)[word], BUCKETS)

    # start: smoothed log odds of every n-gram's rate in the two classes
    seen = np.minimum(count, 3) * (row < n)
    rates = []
    for label in (1, 0):
        c = np.bincount(kind, seen * (y[order][row] == label), n_types)
        rates.append(np.bincount(bucket, c[word], BUCKETS))
    odds = np.log((rates[0] + smooth * rates[0].sum() / rates[1].sum()) / (rates[1] + smooth)) - np.log(rates[0].sum() / rates[1].sum())
    x = bags(odds)[:n, None]
    (slope,), _ = calibrate(x, truth[:n, 1])
    scale = max(slope, 1e-6) * odds.std()
    emb = rng.standard_normal((dims, BUCKETS)) * 0.01
    emb[0] = odds / (odds.std() + 1e-12)
    out = rng.standard_normal((dims, 2)) * 0.1 * scale
    out[0] = -scale / 2, scale / 2
    bias = np.log(truth[:n].mean(0) + 1e-9)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, out, bias)]
    best = (np.inf, emb.copy(), out.copy())
    for step in range(1, steps + 1):
        h = np.stack([bags(e) for e in emb], 1)
        h -= h[:n].mean(0)
        z = h @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = -np.log((p[n:] * truth[n:]).sum(1) + 1e-12).mean()
        if loss < best[0]:
            best = (loss, emb.copy(), out.copy())
        err = (p[:n] - truth[:n]) / n
        back = err @ out.T
        back -= back.mean(0)
        grads = (np.stack([spread(b) for b in back.T]), h[:n].T @ err, err.sum(0))
        for param, grad, (m, v), rate in zip((emb, out, bias), grads, state, (rate_e, 0.01 * scale, 0.05)):
            m += 0.1 * (grad - m)
            v += 0.02 * (grad * grad - v)
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-12)
    _, emb, out = best
    return ((out[:, 1] - out[:, 0]) @ emb).astype(np.float32)


def calibrate(x: np.ndarray, t: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and shift of a lightly shrunk logistic regression of t on x."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    d = np.concatenate(((x - mean) / spread, np.ones((len(x), 1))), 1)
    shrink = np.diag([0.3] * x.shape[1] + [0.01])
    w = np.zeros(d.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d.T * np.maximum(p * (1 - p), 1e-6)) @ d + shrink, d.T @ (p - t) + shrink @ w)
        w -= np.clip(step, -1, 1)
        if np.abs(step).sum() < 1e-9:
            break
    slopes = w[:-1] / spread
    return tuple(map(float, slopes)), float(w[-1] - slopes @ mean)


def held_out_fold(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, words: int = 2_000_000) -> ToxicityModel:
    """Train on at most ``sample`` labelled rows outside the held-out fold.

    A doc_id labelled more than once counts as toxic if any label says so; null
    ids, labels and texts are not used. Of repeated ids the text that sorts last
    teaches. Rows are taken in order of a hash of doc_id; one whose distinct
    words would exceed ``words`` in all is left out whole. With labels of one
    class only, every text scores 0.02 or 0.98; without labels, 0.02; with two
    classes but no word in two documents, or one class among those that teach,
    the share of toxic rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(~held_out_fold(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` ids, hence small enough to broadcast
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")
    rows = store(rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").cast("int").alias("toxic")), "tox-sample")

    def count(batches):
        for batch in batches:
            for some in slices(batch, batch.column(1)):
                length, name, n = zip(*counted_words(some.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(2), pa.array(length, pa.int64()), pa.array([len(x) for x in name], pa.int64()), pa.array([x.tobytes() for x in name], pa.binary()), pa.array([x.tobytes() for x in n], pa.binary())],
                    names=["doc_id", "toxic", "length", "n", "names", "counts"],
                )

    counted = store(rows.mapInArrow(frugal(count), schema_with(rows.select("doc_id", "toxic"), length="long", n="long", names="binary", counts="binary")), "tox-words")
    taken, left = [], words
    for r in counted.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= left:
            taken.append(r["doc_id"])
            left -= r["n"]
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in taken], counted.select("doc_id").schema)) if taken else None
    if not taken:
        drop_stored(rows, counted)
        return ToxicityModel(np.zeros(BUCKETS, np.float32), (0.0, 0.0), -4.0)
    got = counted.join(chosen, "doc_id", "left_semi").orderBy("doc_id").toArrow()
    names = [np.frombuffer(x.as_buffer(), np.uint64) for x in got["names"]]
    counts = [np.frombuffer(x.as_buffer(), np.int32) for x in got["counts"]]
    data = Sample(np.asarray(got["toxic"], np.int64), np.asarray(got["length"]), np.repeat(np.arange(len(names), dtype=np.int32), [len(x) for x in names]), np.concatenate(names), np.concatenate(counts))
    y, types = data.labels, data.types()
    order, n_held = shuffled(len(y))
    fitted = y[order[n_held:]]
    if y.min() == y.max() or not len(types) or not len(fitted) or fitted.min() == fitted.max():
        drop_stored(rows, counted)
        shift = (-4.0 if not y.any() else 4.0) if y.min() == y.max() else float(np.log(y.mean() / (1 - y.mean())))
        return ToxicityModel(np.zeros(BUCKETS, np.float32), (0.0, 0.0), shift)
    ids = np.asarray(got["doc_id"])
    del got, names, counts
    texts = rows.join(chosen, "doc_id", "left_semi")
    sent = spark.sparkContext.broadcast(types)

    def spell(batches):
        for batch in batches:
            for some in slices(batch, batch.column(0)):
                found = list(buckets_of(some.column(0), sent.value))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([k for k, _ in found], np.uint64).view(np.int64)), pa.array([b.tobytes() for _, b in found], pa.binary())], names=["name", "buckets"])

    spelled = texts.select("text").mapInArrow(frugal(spell), "name long, buckets binary").groupBy("name").agg(F.min("buckets").alias("buckets")).toArrow()
    buckets = [np.frombuffer(x.as_buffer(), np.int32) for x in spelled["buckets"]]
    word = np.repeat(np.searchsorted(types, np.asarray(spelled["name"]).view(np.uint64)), [len(b) for b in buckets]).astype(np.int32)
    bucket = np.concatenate(buckets)
    del spelled, buckets
    sent.destroy()
    by = np.lexsort((bucket, word))  # whatever order the tasks' answers came in
    word, bucket = word[by], bucket[by]
    del by
    trim_driver(spark, collect=True)  # the JVM is idle while Python takes its most
    table = train(data, types, word, bucket)
    del data, word, bucket
    held = order[:n_held]
    sent = spark.sparkContext.broadcast(table)

    def features(batches):
        for batch in batches:
            x = ToxicityModel(sent.value, (), 0.0).features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["doc_id", "mean", "best"])

    # at most ``sample`` rows of three numbers
    x = texts.select("doc_id", "text").mapInArrow(frugal(features), schema_with(texts.select("doc_id"), mean="double", best="double")).toArrow()
    sent.destroy()
    drop_stored(rows, counted)
    at = {i: k for k, i in enumerate(x["doc_id"].to_pylist())}
    pick = [at[i] for i in ids[held].tolist()]
    both = np.stack((np.asarray(x["mean"]), np.asarray(x["best"])), 1)[pick]
    slopes, shift = calibrate(both, y[held].astype(np.float64))
    trim()
    return ToxicityModel(table, slopes, shift)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` plus score and predicted (existing ones of these names are replaced).

    Null and empty texts score as a text without any word; a score equal to
    ``threshold`` is toxic. Repeated rows and null ids are scored like any
    other row, very long texts whole; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    # plain values: a broadcast is unpickled where this package need not be installed
    kept = send(docs.sparkSession, (model.table, model.slopes, model.shift))

    def run(batches):
        own = ToxicityModel(*kept.value)
        for batch in batches:
            s = own.score(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "score"])

    schema = schema_with(docs, score="double")
    return docs.mapInArrow(frugal(run), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 4000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels, sample)
    out = score(docs.select("doc_id", "text"), model, threshold)
    return out.select("doc_id", held_out_fold(F.col("doc_id")).alias("held_out"), "score", "predicted")
