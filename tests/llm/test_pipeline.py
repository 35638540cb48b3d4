"""The corpus pipeline, stage by stage, against what each stage promises."""

import re
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from veridia.llm import minhash, mixing
from veridia.llm.common import store

from .test_pairs import brute_links, roots

WORDS = np.array(["the", "cat", "house", "river", "green", "runs", "over", "stone", "and", "with", "meadow", "tall", "sings"])


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    rows, labels = [], []

    def add(text, source, quality=None, toxic=None):
        i = len(rows)
        rows.append((i, text, ["en", "de", None][i % 3], source, len(text or ""), "own", 0.5))
        if quality is not None:
            labels.append((i, quality, toxic))
        return i

    clean = [add(" ".join(rng.choice(WORDS, int(rng.integers(40, 90)))), ["a", "b", None][i % 3], 1, 0) for i in range(500)]
    toxic = []
    for i in range(160):
        w = list(rng.choice(WORDS, 60))
        for at in (5, 20, 40):
            w[at] = ["blockhead", "nitwit", "scumbag"][i % 3]
        toxic.append(add(" ".join(w), "a", 1, 1))
    junk = [add(" ".join(w + "###$$%" for w in rng.choice(WORDS, 50)), "b", 0, 0) for _ in range(30)]
    copies = [add(rows[clean[k % 5]][1], "a") for k in range(40)]
    add(None, "a")
    add("", None)
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, kept double").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {"clean": clean, "toxic": toxic, "junk": junk, "copies": copies}


def test_stages_and_run(spark, corpus):
    path, ids = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, steps = docs.columns, [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == columns
        steps.append(docs.collect())
    kept = [{r["doc_id"] for r in s} for s in steps]
    assert len(kept[0] & set(ids["toxic"]) - kept[1]) > 0.9 * len(ids["toxic"]) and len(set(ids["clean"]) - kept[1]) < 15
    assert not kept[2] & set(ids["junk"]) and len(kept[1] & set(ids["clean"]) - kept[2]) < 10
    assert all(r["score"] == "own" and r["kept"] == 0.5 for r in steps[2])
    texts = [(r["doc_id"], r["text"]) for r in steps[2]]
    s, links = brute_links(texts)
    assert kept[3] == {i for i, c in roots(s, links).items() if i == c} and len(kept[3]) < len(kept[2])
    size = lambda r: len((r["text"] or "").split())
    sources = {r["source"] for r in steps[3]}
    goal = mixing.targets({q: sum(size(r) for r in steps[3] if r["source"] == q) for q in sources})
    for q in sources:
        assert abs(sum(size(r) for r in steps[4] if r["source"] == q) - goal[q]) <= 1
    final = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert len(final) == len(steps[4]) and all(r["decoded_ok"] and r["n_tokens"] > 0 for r in final)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, path).collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in final)


def test_near_copies_from_80_per_cent_go(spark):
    rng = np.random.default_rng(12)
    vocab = [f"w{i}" for i in range(3000)]
    docs = []
    for base in range(40):
        w = list(rng.choice(vocab, 104))
        docs.append((2 * base, " ".join(w)))
        w[base % 5 + 40 : base % 5 + 43 + base % 4] = [f"x{base}_{k}" for k in range(3 + base % 4)]
        docs.append((2 * base + 1, " ".join(w)))
    s, links = brute_links(docs, 80)
    assert len(links) > len(brute_links(docs)[1])
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert kept == {i for i, c in roots(s, links).items() if i == c}


def test_bands_miss_few_pairs_at_the_threshold():
    for threshold in (75, 80, 85, 95):
        assert (1 - (threshold / 100) ** minhash.ROWS) ** minhash.band_count(threshold) <= 3.1e-5
    assert minhash.band_count(85) == minhash.BANDS and minhash.slack(85) == minhash.SLACK < minhash.slack(80)
    with pytest.raises(ValueError):
        minhash.band_count(50)


def test_a_stored_table_leaves_no_freed_memory_in_the_driver(spark):
    """Memory outside the JVM's heap that was freed between pieces still in use goes back to the system."""
    pid = spark._jvm.ProcessHandle.current().pid()
    held = lambda: sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024
    store(spark.range(1), "test-first")  # with what any first write takes
    made = [spark._jvm.java.util.zip.Deflater() for _ in range(600)]
    full = held()
    for i, x in enumerate(made):
        if i % 20:
            x.end()
    store(spark.range(1), "test-second")
    assert held() < full - 40
