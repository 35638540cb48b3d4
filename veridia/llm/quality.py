"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Grams are strings of up to ``ORDER`` code points. The alphabet is open and no
gram is left out, so the count tables grow with the corpus. All trusted text is
counted with map-side partials; discounts, context sums and interpolated
probabilities come from joins of the count tables, sharded by gram, suffix and
context. A document is scored by its perplexity over its whole text, in which
words that repeat the word before them cost as much as such repeats are rare in
trusted text, and rejected where that lies above its language's quantile of the
perplexities of trusted texts that the model has not seen.

A probability table of at most ``table_rows`` rows is broadcast and looked up in
each task. Of a larger one only its most frequent rows are; all other grams of
a document meet the table in a sharded join, pre-aggregated per document. For
this join a document's log probability is written as a sum over its grams of
all orders, each with the gain over the back-off to the next shorter one. Both
ways give the same perplexities.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, frugal, mix, schema_with, send, slices, small_batches, store, texts, trim, unused, word_hashes

ORDER = 5
PAD = ORDER - 1
#: code points that one numpy pass takes
CHUNK = 1 << 17
#: distinct grams that a counting task holds before it emits them
HELD_GRAMS = 1 << 19
#: rows of the probability table that are broadcast (12 bytes each, 32 at most once indexed)
TABLE_ROWS = 1_500_000
#: probability of a code point below all orders
FLOOR = 1 / 0x110000
#: of trusted rows, those with crc32(doc_id as text) % FOLDS = 0 set thresholds and teach nothing
FOLDS = 8

_plain = np.arange(256, dtype=np.uint32)
_plain[[*range(0x09, 0x0E), 0x85, 0xA0]] = 0x20
_plain[0x30:0x3A] = 0x30
_POWERS = [pow(0x9E3779B97F4A7C15 | 1, n, 1 << 64) for n in range(ORDER + 1)]


def points(text: str) -> np.ndarray:
    """Code points, with white space as a space and digits as '0'."""
    out = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").copy()
    small = out < 256
    out[small] = _plain[out[small]]
    return out


def pieces(column: pa.Array):
    """(code points, ends of grams, owner rows) of a batch of texts in bounded pieces; null and empty texts have none.

    A text has white space around it: PAD spaces in front, one behind.
    """
    held, owners, size = [], [], 0

    def joined():
        lengths = np.array([len(t) for t in held])
        codes, starts = points("".join(held)), np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(held)), lengths)
        at = np.flatnonzero(np.arange(len(codes)) - starts[row] >= PAD)
        return codes, at, np.asarray(owners)[row[at]]

    for i, text in enumerate(texts(column)):
        n = len(text or "")
        for a in range(0, n, CHUNK):
            held.append(" " * max(0, PAD - a) + text[max(0, a - PAD) : a + CHUNK] + (" " if a + CHUNK >= n else ""))
            owners.append(i)
            size += len(held[-1])
            if size >= CHUNK:
                yield joined()
                held, owners, size = [], [], 0
    if held:
        yield joined()


def rolled(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the grams of 0..ORDER code points that end at each place."""
    c = codes.astype(np.uint64) + np.uint64(1)
    out = [np.zeros(len(c), np.uint64)]
    for n in range(1, ORDER + 1):
        h = out[-1].copy()
        h[n - 1 :] += c[: len(c) - n + 1] * np.uint64(_POWERS[n - 1])
        out.append(h)
    return out


def key(h: np.ndarray, n: int, context: bool) -> np.ndarray:
    """Table keys of grams of n code points, as symbols seen or as contexts."""
    return mix(h + np.uint64(((2 * n + context + 1) * 0xD6E8FEB86659FD93) % (1 << 64)))


def count_grams(rows: DataFrame) -> DataFrame:
    """gram, c: how often each gram of ORDER code points occurs in the one text column of ``rows``."""

    def emit(grams, counts):
        for a in range(0, len(grams), 1 << 16):
            flat = np.ascontiguousarray(grams[a : a + (1 << 16)]).tobytes().decode("utf-32-le")
            strings = [flat[i : i + ORDER] for i in range(0, len(flat), ORDER)]
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array(counts[a : a + (1 << 16)])], names=["gram", "c"])

    def merged(parts):
        hashes, counts, grams = (np.concatenate(x) for x in zip(*parts))
        hashes, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        return hashes, np.bincount(where, counts).astype(np.int64), grams[first]

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for codes, at, _ in pieces(batch.column(0)):
                hashes, first, counts = np.unique(rolled(codes)[ORDER][at], return_index=True, return_counts=True)
                parts.append((hashes, counts, codes[at[first][:, None] + np.arange(-PAD, 1)]))
                size += len(hashes)
                if size > 2 * HELD_GRAMS:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > HELD_GRAMS:
                        yield from emit(parts[0][2], parts[0][1])
                        parts, size = [], 0
        if parts:
            _, counts, grams = merged(parts)
            yield from emit(grams, counts)

    return rows.mapInArrow(frugal(run), "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(level: DataFrame) -> list[float]:
    """The discounts of counts 1, 2 and more of a level (gram, c)."""
    row = level.agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(row[k] or 0) for k in range(4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return [max(0.05, min(k - 0.01, k - (k + 1) * y * b / a)) if a and b else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """Stored tables (gram, n, context, value, gain, weight) of all orders.

    Rows of context = false hold the log probability of a gram's last code
    point after the others; rows of context = true the log weight of backing off
    from a gram as context. ``gain`` is what a row adds to the next shorter
    order, ``weight`` how often it was counted.
    """
    levels = [counts]
    for _ in range(ORDER - 1):  # continuation counts: distinct code points in front
        shorter = levels[-1].groupBy(F.substring("gram", 2, ORDER).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        levels.append(store(shorter, "kn-counts"))
    lower, tables = None, []
    for n, level in enumerate(reversed(levels), 1):
        one, two, more = discounts(level)
        d = F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).otherwise(more)
        left = level.select("gram", "c", d.alias("d"), F.substring("gram", 1, n - 1).alias("head"), F.substring("gram", 2, n).alias("suffix"))
        sums = store(left.groupBy("head").agg(F.sum("c").alias("s"), (F.sum("d") / F.sum("c")).alias("gamma")), "kn-sums")
        left = left.join(sums, "head")
        if lower is not None:  # every suffix of a seen gram was seen itself
            left = left.join(lower.select(F.col("gram").alias("suffix"), F.exp("value").alias("lower")), "suffix")
        else:
            left = left.withColumn("lower", F.lit(FLOOR))
        back = F.col("gamma") * F.col("lower")
        p = (F.col("c") - F.col("d")) / F.col("s") + back
        row = lambda gram, m, context, value, gain, weight: [gram.alias("gram"), F.lit(m).alias("n"), F.lit(context).alias("context"), value.alias("value"), gain.alias("gain"), weight.cast("long").alias("weight")]
        lower = store(left.select(*row(F.col("gram"), n, False, F.log(p), F.log(p / back), F.col("c"))), "kn-p")
        tables.append(lower)
        tables.append(sums.select(*row(F.col("head"), n - 1, True, F.log("gamma"), F.log("gamma"), F.col("s"))))
    drop_stored(*levels[1:])
    return tables


def keyed(table: DataFrame, value: str) -> DataFrame:
    """key, value of the rows of a table made by :func:`kneser_ney`."""

    def run(batches):
        for batch in batches:
            gram, n, context = batch.column(0).to_pylist(), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            keys = np.zeros(len(gram), np.uint64)
            for k in range(ORDER + 1):
                for kind in (False, True):
                    at = np.flatnonzero((n == k) & (context == kind))
                    if len(at):
                        codes = points("".join(gram[i] for i in at)).astype(np.uint64).reshape(len(at), k) + np.uint64(1)
                        h = (codes * np.array([_POWERS[k - 1 - j] for j in range(k)], np.uint64)).sum(1, dtype=np.uint64)
                        keys[at] = key(h, k, kind)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(3).cast(pa.float32())], names=["key", "value"])

    rows = table.select("gram", "n", F.col("context").cast("int").alias("context"), F.col(value).alias("value"))
    return rows.mapInArrow(frugal(run), "key long, value float")


class GramTable:
    """Values by key: one probe of a direct-address table, then a search among the few rows that share a slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.view(np.uint64)
        self.mask = np.uint64((1 << max(4, (2 * len(keys)).bit_length())) - 1)
        slots, first = np.unique(keys & self.mask, return_index=True)
        self.tags, self.values = np.zeros(int(self.mask) + 1, np.uint32), np.full(int(self.mask) + 1, np.nan, np.float32)
        slots = slots.astype(np.int64)
        self.tags[slots], self.values[slots] = (keys[first] >> np.uint64(32)).astype(np.uint32), values[first]
        rest = np.ones(len(keys), bool)
        rest[first] = False
        order = np.argsort(keys[rest])
        self.keys_left, self.values_left = keys[rest][order], values[rest][order]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, nan for those that are not there."""
        slots = (keys & self.mask).astype(np.int64)
        out = np.where(self.tags[slots] == (keys >> np.uint64(32)).astype(np.uint32), self.values[slots], np.float32(np.nan))
        if len(self.keys_left):
            miss = np.flatnonzero(np.isnan(out))
            at = np.minimum(np.searchsorted(self.keys_left, keys[miss]), len(self.keys_left) - 1)
            hit = self.keys_left[at] == keys[miss]
            out[miss[hit]] = self.values_left[at[hit]]
        return out


def table_of(value: dict) -> GramTable:
    """The index over a broadcast variable's keys and values, built once per Python worker."""
    if "index" not in value:
        value["index"] = GramTable(value.pop("keys"), value.pop("values"))
    return value["index"]


def log_probabilities(codes: np.ndarray, at: np.ndarray, table: GramTable) -> np.ndarray:
    """Log probability of the code points at the places ``at``, each after those in front of it."""
    h = rolled(codes)
    out, todo = np.zeros(len(at)), np.arange(len(at))
    for n in range(ORDER, 0, -1):
        end = at[todo]
        value = table.get(key(h[n][end], n, False))
        seen = ~np.isnan(value)
        out[todo[seen]] += value[seen]
        todo, end = todo[~seen], end[~seen]
        if not len(todo):
            return out
        out[todo] += np.nan_to_num(table.get(key(h[n - 1][end - 1], n - 1, True)))
    out[todo] += math.log(FLOOR)
    return out


def repeats(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many words of each text equal the word before them, and how many have a word before them."""
    parts = [repeats_of(some) for some in slices(column, column)]  # bounds the arrays of words
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def repeats_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, counts = word_hashes(column)
    same = np.zeros(len(words) + 1, np.int64)
    same[1:-1] = words[1:] == words[:-1]
    ends = np.cumsum(counts)
    same[(ends - counts)[counts > 0]] = 0  # a text's first word
    upto = np.concatenate(([0], np.cumsum(same[:-1])))
    return upto[ends] - upto[ends - counts], np.maximum(counts - 1, 0)


def repeat_rate(rows: DataFrame) -> float:
    """The share of words that equal the word before them in the one text column of ``rows``, strictly between 0 and 1."""

    def run(batches):
        for batch in batches:
            same, pairs = repeats(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([int(same.sum())]), pa.array([int(pairs.sum())])], names=["same", "pairs"])

    row = rows.mapInArrow(frugal(run), "same long, pairs long").agg(F.sum("same").alias("same"), F.sum("pairs").alias("pairs")).first()
    return ((row["same"] or 0) + 0.5) / ((row["pairs"] or 0) + 1)


def repeat_cost(column: pa.Array, rate: float | None) -> np.ndarray:
    """Log probability of each text's choices whether a word repeats the one before it.

    It does not make the spelling of a repeat free, so that repetition is
    improbable and not easy to predict.
    """
    if rate is None:
        return np.zeros(len(column))
    same, pairs = repeats(column)
    return same * np.log(rate) + (pairs - same) * np.log1p(-rate)


def perplexities(column: pa.Array, table: GramTable, rate: float | None = None) -> list[float | None]:
    """Per-symbol perplexity of each text; None for null and empty ones."""
    total, n = repeat_cost(column, rate), np.zeros(len(column), np.int64)
    for codes, at, rows in pieces(column):
        total += np.bincount(rows, log_probabilities(codes, at, table), len(total))
        n += np.bincount(rows, minlength=len(n))
    return [float(np.exp(-t / k)) if k else None for t, k in zip(total, n)]


def gram_sums(column: pa.Array, head: GramTable) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Log probabilities from the head's gains, symbols, and per text the other keys with their counts."""
    total, n, rest = np.zeros(len(column)), np.zeros(len(column), np.int64), [[] for _ in range(len(column))]
    for codes, at, rows in pieces(column):
        h = rolled(codes)
        n += np.bincount(rows, minlength=len(n))
        for k in range(ORDER + 1):
            for context in (False, True):
                if k == (0 if not context else ORDER):
                    continue
                keys = key(h[k][at - context], k, context)
                gain = head.get(keys)
                total += np.bincount(rows, np.nan_to_num(gain), len(total))
                miss = np.flatnonzero(np.isnan(gain))
                cut = np.flatnonzero(np.diff(rows[miss], prepend=-1))
                for a, b in zip(cut, [*cut[1:], len(miss)]):
                    rest[rows[miss[a]]].append(keys[miss[a:b]])
    total += n * math.log(FLOOR)
    return total, n, [np.unique(np.concatenate(r), return_counts=True) if r else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for r in rest]


#: label ids up to this number are broadcast (16 MB); beyond it they are joined by a shuffle
BROADCAST_IDS = 1_000_000
#: so are the thresholds of up to this number of languages
BROADCAST_LANGS = 10_000


def trusted_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang and text of the rows of ``docs`` whose doc_id is labelled quality 1 and never 0."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"))
    ids = ids.where("q = 1").select("doc_id")
    if labels.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.select("doc_id", "lang", "text").join(ids, "doc_id", "left_semi")


class Model:
    """A trained model: its tables, and perplexities by them."""

    def __init__(self, trusted: DataFrame, table_rows: int = TABLE_ROWS):
        spark = trusted.sparkSession
        small_batches(spark)
        counts = store(count_grams(trusted.select("text")), "kn-grams")
        self.tables = kneser_ney(counts)
        drop_stored(counts)
        self.rate = repeat_rate(trusted.select("text"))
        self.rows = sum(t.count() for t in self.tables)
        self.whole, self.least = self.rows <= table_rows, 0
        if not self.whole:  # rows above the least weight fit; few weights are that large
            union = self.tables[0].select("weight")
            for t in self.tables[1:]:
                union = union.unionAll(t.select("weight"))
            most = union.groupBy("weight").count().orderBy(F.desc("weight"))
            left = table_rows
            for row in most.toLocalIterator():
                left -= row["count"]
                if left < 0:
                    self.least = row["weight"]
                    break
        keys, values = [], []
        for t in self.tables:
            got = keyed(t.where(F.col("weight") > self.least) if not self.whole else t, "value" if self.whole else "gain").toArrow()
            keys.append(np.asarray(got["key"], np.int64))
            values.append(np.asarray(got["value"], np.float32))
        self.table = send(spark, {"keys": np.concatenate(keys), "values": np.concatenate(values)})
        del keys, values
        trim()

    def with_perplexity(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the perplexity of their text column."""
        return self._looked_up(rows, name) if self.whole else self._joined(rows, name)

    def _looked_up(self, rows: DataFrame, name: str) -> DataFrame:
        table, rate = self.table, self.rate

        def run(batches):
            own = table_of(table.value)
            for batch in batches:
                x = perplexities(batch.column(batch.schema.get_field_index("text")), own, rate)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.float64())], names=[*batch.schema.names, name])

        return rows.mapInArrow(frugal(run), schema_with(rows, **{name: "double"}))

    def _joined(self, rows: DataFrame, name: str) -> DataFrame:
        table, rate = self.table, self.rate

        def run(batches):
            own = table_of(table.value)
            for batch in batches:
                for a in range(0, batch.num_rows, 64):
                    some = batch.slice(a, 64)
                    total, n, rest = gram_sums(some.column(2), own)
                    total += repeat_cost(some.column(2), rate)
                    k1, k2 = np.asarray(some.column(0)), np.asarray(some.column(1))
                    yield part(k1, k2, None, n, total)
                    of = np.repeat(np.arange(len(rest)), [len(keys) for keys, _ in rest])
                    if len(of):
                        yield part(k1[of], k2[of], np.concatenate([keys for keys, _ in rest]).view(np.int64), np.concatenate([c for _, c in rest]), None)

        def part(k1, k2, keys, n, total):
            nothing = lambda kind: pa.nulls(len(k1), kind)
            columns = [pa.array(k1), pa.array(k2), nothing(pa.int64()) if keys is None else pa.array(keys), pa.array(n.astype(np.int64)), nothing(pa.float64()) if total is None else pa.array(total)]
            return pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "key", "n", "total"])

        # equal texts share a key; as both sums grow alike, their perplexity does not change
        first, second = unused(rows, "k1"), unused(rows, "k2")
        named = rows.withColumns({first: F.xxhash64("text"), second: F.xxhash64(F.lit(7), "text")})
        texts_only = named.where(F.length("text") > 0).select(F.col(first).alias("k1"), F.col(second).alias("k2"), "text")
        sums = store(texts_only.mapInArrow(frugal(run), "k1 long, k2 long, key long, n long, total double"), "kn-sums")
        rest = None
        for t in self.tables:
            tail = keyed(t.where(F.col("weight") <= self.least), "gain")
            rest = tail if rest is None else rest.unionAll(tail)
        found = sums.where("key is not null").join(rest, "key").select("k1", "k2", (F.col("n") * F.col("value").cast("double")).alias("total"), F.lit(0).cast("long").alias("n"))
        both = sums.where("key is null").select("k1", "k2", "total", "n").unionByName(found)
        score = both.groupBy("k1", "k2").agg(F.exp(-F.sum("total") / F.sum("n")).alias(name)).withColumnsRenamed({"k1": first, "k2": second})
        return named.join(score, [first, second], "left").select(*rows.columns, name)


def thresholds(model: Model, trusted: DataFrame, quantile: float) -> tuple[float | None, DataFrame]:
    """The threshold of all trusted text, and a stored table (lang, threshold).

    ``trusted`` are texts that the model has not seen.
    """
    known = store(model.with_perplexity(trusted.select("lang", "text"), "x").drop("text").where("x is not null"), "kn-trusted")
    q = F.percentile_approx("x", F.lit(quantile), F.lit(10000))
    overall = known.agg(q.alias("t")).first()["t"]
    each = store(known.where("lang is not null").groupBy("lang").agg(q.alias("threshold")), "kn-thresholds")
    drop_stored(known)
    return overall, each


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.98, margin: float = 1.2, table_rows: int = TABLE_ROWS) -> DataFrame:
    """``docs`` with perplexity, threshold and kept (columns of these names are replaced).

    A language's threshold is ``margin`` times the ``quantile`` of the
    perplexities of its trusted texts of a fold that teaches nothing; a language
    without such texts, or a null one, takes that of all of them; without any,
    the taught texts set it. Null and empty texts have no perplexity and are not
    kept, unless there is no trusted text at all, in which case everything is.
    Repeated rows and null ids are scored like any other row; very long texts
    are scored whole; an empty table gives an empty one.
    """
    docs = docs.drop("perplexity", "threshold", "kept")
    trusted = trusted_text(docs, labels)
    aside = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    model = Model(trusted.where(~aside), table_rows)
    overall, each = thresholds(model, trusted.where(aside), quantile)
    if overall is None:
        overall, each = thresholds(model, trusted, quantile)
    lang = unused(docs, "lang_of")
    few = each.select(F.col("lang").alias(lang), (F.col("threshold") * margin).alias("threshold"))
    few = F.broadcast(few) if each.count() <= BROADCAST_LANGS else few
    rows = model.with_perplexity(docs, "perplexity").join(few, F.col("lang") == F.col(lang), "left").drop(lang)
    rows = rows.withColumn("threshold", F.coalesce("threshold", F.lit(None if overall is None else overall * margin).cast("double")))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("threshold").isNull())
    return rows.withColumn("kept", kept)
