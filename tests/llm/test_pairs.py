"""Near-duplicate and nearest-neighbour operators against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest

from veridia.llm import ann, embdedup, minhash
from veridia.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def roots(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_links(docs, threshold=85):
    s = {i: sets_of(t) for i, t in docs}
    return s, [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= threshold * len(s[a] | s[b])]


def made_documents(seed=1):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for base in range(8):
        words = list(rng.choice(vocab, 120))
        for copy in range(12):
            w = list(words)
            for at in rng.integers(0, len(w), copy % 5):
                w[at] = "X" + str(rng.integers(1000))
            docs.append((len(docs) * 7 % 1009, " ".join(w)))
    return docs


def test_minhash_matches_brute_force(spark):
    docs = made_documents() + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One two"), (2004, "one  TWO"), (2005, "a"), (2006, "long " * 30000)]
    rows = spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], DOCS)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(rows).collect()}
    s, links = brute_links(docs)
    want = roots(s, links)
    assert len(got) == len(docs)
    for i in s:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s[i]), want[i], want[i] == i)


def test_minhash_empty_repeats_and_nulls(spark):
    empty = spark.createDataFrame([], DOCS)
    assert minhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f", "x", "y", 1), (1, "a b c d e f", "x", "y", 1), (None, "a b c d e f", None, None, None)], DOCS)
    got = sorted(minhash.near_duplicates(rows).collect(), key=str)
    assert len(got) == 3 and {r["component_id"] for r in got} <= {1, None}


def test_odd_sketch_estimates(spark):
    rng = np.random.default_rng(5)
    for share in (0.7, 0.85, 0.95):
        a = rng.integers(0, 1 << 62, 4000, np.int64).astype(np.uint64)
        n = int(4000 * 2 * share / (1 + share))
        b = np.concatenate((a[:n], rng.integers(0, 1 << 62, 4000 - n, np.int64).astype(np.uint64)))
        x, y = (minhash.odd_sketch(minhash.minhashes(np.unique(v))).view(np.uint64) for v in (a, b))
        z = int(np.bitwise_count(x ^ y).sum())
        est = 1 + minhash.SKETCH_BITS / (4 * minhash.SAMPLES) * np.log(1 - 2 * z / minhash.SKETCH_BITS)
        assert abs(est - share) < minhash.SLACK


def test_shingles_of_slices_and_long_words():
    column = pa.array(["skip", "A b C d E f", None, "x" * (3 << 20) + " y"])
    got = minhash.shingle_sets(column.slice(1))
    assert [len(s) for s in got] == [2, 0, 1]
    assert (got[0] == minhash.shingle_sets(pa.array(["a B c D e F"]))[0]).all()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(1, 40)] + [(700, 700), (None, 3), (900, 901), (901, 900)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e if x is not None and e[0] != e[1] and None not in e}, [e for e in edges if None not in e and e[0] != e[1]])
    assert got == want


def vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 64))
    for i in range(100, 200):
        x[i] = x[i % 7] + rng.standard_normal(64) * 0.3
    rows = [(int(i), [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 64), (302, [float("nan")] + [1.0] * 63), (303, [None] + [1.0] * 63), (304, rows[5][1]), (305, rows[5][1]), (306, [1.0, 2.0])]
    return rows


def test_embedding_dedup_matches_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "7 as label", "1 as n")
    got = {r["vec_id"]: r for r in embdedup.near_duplicates(df).collect()}
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.9]
    want = roots([i for i, _ in rows], links)
    assert len(links) > 100 and len(got) == len(rows)
    for i, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(i in e for e in links), want[i], want[i] == i)


def test_embedding_dedup_of_nothing(spark):
    assert embdedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(9)
    x = np.float32(rng.standard_normal((6000, 64)))
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(-1, None), (-2, [0.0] * 64), (7000, [float(v) for v in x[100]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = ann.search(df, df.where("vec_id % 100 = 0"), k=10).collect()
    x = np.concatenate((x, x[100:101])).astype(float)
    ids = np.append(np.arange(6000), 7000)
    hits = 0
    for q in [int(i) for i in ids if i % 100 == 0]:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in mine) and all(v != q for _, v, _ in mine)
        d[ids == q] = np.inf
        hits += len({v for _, v, _ in mine} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits / (10 * 61) >= 0.9
    assert next(r for r in got if r["query_id"] == 100 and r["rank"] == 1)["vec_id"] == 7000


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, None)]])
def test_nearest_neighbours_of_few(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert ann.search(df, df).count() == 0


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    c = rng.standard_normal((256, 16))
    g = ann.CentroidGraph(c, ann.graph_links(c))
    q = rng.standard_normal((100, 16))
    d = ((q[:, None] - c[None]) ** 2).sum(2)
    ids, dist = g.beam(q, 32)
    assert (ids[:, 0] == d.argmin(1)).mean() > 0.97 and np.allclose(dist[:, 0], np.take_along_axis(d, ids[:, :1], 1)[:, 0])
    row, found = g.within(q, 0.3, width=8)
    limit = np.sort(np.sqrt(d), 1)[:, 7] * 1.3  # the eighth: half the root of 256
    want = {(i, j) for i in range(100) for j in range(256) if np.sqrt(d[i, j]) <= limit[i]}
    got = set(zip(row.tolist(), found.tolist()))
    assert got <= want and len(got) > 0.97 * len(want)


def test_nearest_neighbours_in_small_blocks_ties_repeats_and_other_lengths(spark):
    rng = np.random.default_rng(4)
    x = [[float(v) for v in r] for r in np.float32(rng.standard_normal((400, 8)))]
    rows = [(i, v) for i, v in enumerate(x)] + [(1000 + i, x[7]) for i in range(15)] + [(3, x[3])] * 3 + [(5, x[9])] + [(2000 + i, [float(i), 1.0]) for i in range(4)] + [(None, x[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as list", "'a' as v", "2 as shard")
    few, whole = (ann.search(df, df.where("vec_id in (7, 3, 5, 2000)"), k=12, ratio=50.0, block_rows=n).orderBy("query_id", "rank").collect() for n in (20, 4096))
    assert few == whole
    by = {q: [(r["vec_id"], r["score"]) for r in whole if r["query_id"] == q] for q in (7, 3, 5, 2000)}
    assert by[7] == [(5, by[7][0][1])] + [(1000 + i, 0.0) for i in range(11)] or [v for v, _ in by[7]] == [1000 + i for i in range(12)]
    assert [v for v, _ in by[2000]] == [2001, 2002, 2003]
    assert by[5][0] == (9, 0.0) and all(v != 5 for v, _ in by[5]) and len(by[3]) == 12
    vec = {}
    for i, v in rows:
        if i is not None and len(v) == 8:
            vec.setdefault(i, []).append(np.array(v))
    for q in (7, 3, 5):
        best = sorted((min(np.linalg.norm(a - b) for a in vec[q] for b in vec[i]), i) for i in vec if i != q)[:12]
        assert [v for v, _ in by[q]] == [i for _, i in best] and all(abs(s - d) < 1e-12 for (_, s), (d, _) in zip(by[q], best))


def test_embedding_dedup_of_repeats_null_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rep", "2 as w", "3 as n_links", "true as ok", "4 as component_id")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embdedup.near_duplicates(df).collect())
    assert got == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 2, 1, False), (4, 0, 4, True)]


def test_minhash_with_clashing_columns_and_a_large_bucket_without_links(spark):
    rng = np.random.default_rng(3)
    head = " ".join(f"h{i}" for i in range(40))
    texts = [head + " " + " ".join(f"t{i}_{j}" for j in range(14)) for i in range(300)]  # they share bands, yet no two link
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, texts[5])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as key", "3 as bands", "4 as n_shingles", "'x' as component_id", "5 as rep", "6 as kept")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    s, links = brute_links(docs)
    want = roots(s, links)
    assert links == [(5, 900)] and got == {i: (len(s[i]), want[i], want[i] == i) for i in s} and rng is not None
