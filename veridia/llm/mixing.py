"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length; every source gets a target by water
filling, takes whole passes over its documents, and fits the remaining budget
with a proportional share of every length plus a bounded-knapsack dynamic
program over the lengths left. Seeded hashes choose the documents of a length.

Only the table of distinct (source, length) counts is worked on per source;
documents are chosen inside hash buckets of a length, so neither a hot source
nor a hot length meets in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

WORD = r"[^\x20\x09-\x0D]+"
#: documents of one source and length are chosen in hash buckets of about this many rows, were all rows alike
SLOT_ROWS = 50_000
#: sources beyond this number are an error: their sizes are held on the driver
MOST_SOURCES = 1_000_000
#: budgets up to this go to the dynamic program
DP_BUDGET = 1 << 16
WEIGHTS = (5, 2, 1)


def targets(sizes: dict, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict:
    """Target of each source: ``share`` of all sizes by weight, none above ``most`` times its own.

    Sources are ordered by code point with null last and weigh 5, 2, 1, 5, ...
    The excess of sources above their limit goes to the others by weight until
    no source is above.
    """
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def fit_budget(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that lengths sum as near ``budget`` from below as can be found.

    A proportional share of each length is taken first; what remains is filled
    from the longest length down to ``DP_BUDGET`` and then by bounded knapsack,
    whose reachable sums are bit sets.
    """
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget >= total:
        return list(counts)
    take = [c * budget // total if s else 0 for s, c in zip(sizes, counts)]
    rest = budget - sum(s * t for s, t in zip(sizes, take))
    order = sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: -sizes[i])
    for i in order:
        if rest <= DP_BUDGET:
            break
        more = min(counts[i] - take[i], (rest - DP_BUDGET // 2) // sizes[i])
        if more > 0:
            take[i] += more
            rest -= more * sizes[i]
    for i, more in fill([(i, sizes[i], counts[i] - take[i]) for i in order], rest).items():
        take[i] += more
    if budget <= DP_BUDGET and sum(s * t for s, t in zip(sizes, take)) < budget:  # small enough to start from nothing
        best = fill([(i, sizes[i], counts[i]) for i in order], budget)
        if sum(sizes[i] * k for i, k in best.items()) > sum(s * t for s, t in zip(sizes, take)):
            return [best.get(i, 0) for i in range(len(sizes))]
    return take


def fill(items: list[tuple[int, int, int]], budget: int) -> dict[int, int]:
    """How many of each (name, size, count) make the largest sum up to ``budget``: bounded knapsack on bit sets of sums."""
    reach, steps, mask = 1, [], (1 << (budget + 1)) - 1
    for i, size, count in sorted(items, key=lambda x: (-min(x[2], 8), x[1])):
        left, power = min(count, budget // size), 1
        while left > 0 and not reach >> budget & 1:
            k = min(power, left)
            steps.append((i, size, k, reach))
            reach |= (reach << (k * size)) & mask
            left -= k
            power *= 2
    at, out = reach.bit_length() - 1, {}
    for i, size, k, before in reversed(steps):
        if not before >> at & 1:
            out[i] = out.get(i, 0) + k
            at -= k * size
    return out


def mix_sources(docs: DataFrame, seed: int = 13, weights=WEIGHTS, share: float = 1.5) -> DataFrame:
    """doc_id, size, source_size, target and taken (words taken, repeats counted) for every row.

    Null texts have size 0 and are never taken; a null source is a source of
    its own. Equal rows are separate documents. Nothing is taken more than
    twice. The choice depends on ``seed``, doc_id, size and source alone.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = store(docs.select("doc_id", "source", size.alias("size")), "mix-sizes")
    return mix_sized(rows, seed, weights, share)


def mix_sized(rows: DataFrame, seed: int = 13, weights=WEIGHTS, share: float = 1.5) -> DataFrame:
    """As mix_sources, for a stored table with a size column; further columns are carried along."""
    n_slots = max(64, -(-rows.count() // SLOT_ROWS))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    rows = rows.withColumn("_slot", F.pmod("_h", F.lit(n_slots))).withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    slots = rows.groupBy("_s", "size", "_slot").agg(F.count(F.lit(1)).alias("n"))
    lengths = slots.groupBy("_s", "size").agg(F.sum("n").alias("n"))
    # one row per source: the number of sources, not of documents
    per_source = lengths.groupBy("_s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sizes = {r["_s"]: int(r["source_size"] or 0) for r in per_source.limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    goal = {("s" + s if s is not None else ""): t for s, t in targets({(k[1:] if k else None): v for k, v in sizes.items()}, weights, share).items()}

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total, target = sizes[key[0]], goal[key[0]]
        part = part.sort_values("size", ignore_index=True)
        passes = int(target // total) if total else 0
        budget = int(round(target - passes * total))
        extra = fit_budget(part["size"].astype(int).tolist(), part["n"].astype(int).tolist(), budget) if budget > 0 else [0] * len(part)
        return pd.DataFrame({"_s": part["_s"], "size": part["size"], "passes": passes, "extra": extra, "source_size": total, "target": float(target)})

    plan = lengths.groupBy("_s").applyInPandas(fit, "_s string, size long, passes long, extra long, source_size long, target double")
    before = F.sum("n").over(Window.partitionBy("_s", "size").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    quota = slots.withColumn("_before", F.coalesce(before, F.lit(0))).join(plan, ["_s", "size"])
    quota = quota.withColumn("_quota", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("_before"))))
    whole = quota.select("_s", "size", "_slot", "passes", "source_size", "target", "_quota", "n")
    chosen = rows.join(whole, ["_s", "size", "_slot"])
    rank = F.row_number().over(Window.partitionBy("_s", "size", "_slot").orderBy("_h", "doc_id"))
    copies = F.col("passes") + F.when(F.col("_quota") >= F.col("n"), 1).when(F.col("_quota") <= 0, 0).otherwise((rank <= F.col("_quota")).cast("int"))
    chosen = chosen.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    return chosen.withColumn("taken", F.col("copies") * F.col("size")).drop("_s", "_h", "_slot", "passes", "_quota", "n")


def mix_documents(docs: DataFrame, seed: int = 13, weights=WEIGHTS, share: float = 1.5) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text and any others), each as often as the mix takes it."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = store(docs.select("doc_id", "source", size.alias("size"), F.struct(*docs.columns).alias("_row")), "mix-rows")
    taken = mix_sized(rows, seed, weights, share).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
