"""Operators on texts and pages: round trips, brute force, held-out accuracy, odd inputs."""

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pytest

from veridia.llm import html_extract, mixing, packing, quality, queries, sentencepiece_tok, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DOCS_NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
MODEL, RANKS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken"
ODD = [(1, None), (2, ""), (3, "  \n"), (4, "word"), (4, "word"), (None, "null id 🙂 日本"), (5, "long " * 40000), (6, "ü" * 100)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def test_sentencepiece_parity_and_round_trip(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sentencepiece_tok.encode_documents(docs(spark, ODD), MODEL).collect()
    assert len(got) == len(ODD)
    texts = {i: t for i, t in ODD}
    for r in got:
        assert list(r["ids"]) == own.encode(texts[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"]) and r["decoded_ok"]
    assert sentencepiece_tok.encode_documents(docs(spark, []), MODEL).count() == 0
    every = sentencepiece_tok.encode_documents(docs(spark, ODD), MODEL, verify_all=True).collect()
    assert sorted(map(str, every)) == sorted(map(str, got))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def unigram_model():
    """A small unigram model with byte fallback, as a protobuf written here."""
    import struct

    def field(n, kind, v):
        key = bytes([n << 3 | kind]) if n < 16 else bytes([(n << 3 | kind) & 127 | 128, n >> 4])
        return key + (bytes([len(v)]) + v if kind == 2 else v)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("a", -2.5, 1), ("b", -2.7, 1), ("ab", -3.1, 1), ("▁ab", -3.3, 1), ("ba", -4.0, 1), ("▁a", -3.9, 1), ("c", -5.0, 1)]
    out = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    trainer = field(3, 0, b"\x01") + field(35, 0, b"\x01")
    normal = field(3, 0, b"\x01") + field(4, 0, b"\x01") + field(5, 0, b"\x01")
    return out + field(2, 2, trainer) + field(3, 2, normal)


def test_sentencepiece_unigram_scores():
    data = unigram_model()
    backend = sentencepiece_tok.Backend(data, verify=False)
    backend.verify(["abab ba", "a b  ab", "cab", "  ab", "abz é", ""])


def test_packing_is_lossless_and_tight(spark):
    import base64

    import tiktoken

    rows = [(i, "some words here " * (i % 37)) for i in range(200)] + [(500, None), (501, ""), (502, "overlong text " * 3000)]
    got = packing.pack_tokens(docs(spark, rows), RANKS, length=256).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb").read().splitlines())}
    own = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = {}
    for r in got:
        ids, pos = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["position_ids"], "<i4")
        assert len(ids) == 256 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 256
        for d, start, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            parts.setdefault(d, []).append((start, ids[a:b].tolist()))
            assert pos[a:b].tolist() == list(range(b - a))
        assert (ids[r["n_tokens"] :] == 50256).all()
    for i, t in rows:
        assert sum((p for _, p in sorted(parts[i])), []) == own.encode_ordinary(t or "") + [50256]


def test_best_fit_decreasing_against_a_scan():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = rng.integers(1, 101, 300).tolist()
        rows, free = [], []
        for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
            fits = [k for k in range(len(rows)) if free[k] >= lengths[i]]
            if fits:
                k = min(fits, key=lambda k: free[k])
            else:
                rows.append([])
                free.append(100)
                k = len(rows) - 1
            rows[k].append(i)
            free[k] -= lengths[i]
        got = packing.best_fit_decreasing(lengths, 100)
        assert len(got) == len(rows) and sorted(sum(got, [])) == list(range(300)) and all(sum(lengths[i] for i in r) <= 100 for r in got)


def levelled(size):
    """Targets by their definition: every source takes its weight of a common level, up to twice its size."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, low, high = 1.5 * sum(size.values()), 0.0, 2.0 * sum(size.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (low, level) if sum(min(2 * size[s], level * weight[s]) for s in names) > want else (level, high)
    return {s: min(2 * size[s], low * weight[s]) for s in names}


def test_mixing_targets_and_budget(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "en", [None, "a", "b", "Z", "é"][int(rng.integers(5))], 0) for i in range(600)]
    rows += [(1000 + i, "same size text", "en", "a", 0) for i in range(300)] + [(2000, None, None, None, None)] + [(7, "one id again", "en", "b", 0)] * 2 + [(None, "no id", "en", "b", 0)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as size", "2 as n", "3 as _s", "4 as _h", "5 as _slot", "6 as target", "7 as taken", "8 as copies")
    got = [r.asDict() for r in mixing.mix_sources(df).collect()]
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in mixing.mix_sources(df.repartition(7)).collect())
    size = {s: sum(len((t or "").split()) for _, t, _, q, _ in rows if q == s) for s in {r[3] for r in rows}}
    goal = levelled(size)
    assert abs(sum(goal.values()) - 1.5 * sum(size.values())) < 1e-3
    assert len(got) == len(rows)
    taken = dict.fromkeys(size, 0)
    for r in got:
        s = r["source"]
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["source_size"] == size[s] and abs(r["target"] - goal[s]) < 1e-3
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in size), (taken, goal)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    words = dict.fromkeys(size, 0)
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].split())
    assert words == taken
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("size", [{"a": 10, "b": 1000, "c": 5, None: 300}, {"x": 0, "y": 7}, {None: 4}, {"a": 1, "b": 1, "c": 1, "d": 1000}])
def test_targets_by_water_filling(size):
    assert all(abs(t - levelled(size)[s]) < 1e-6 for s, t in mixing.targets(size).items())


def test_budget_against_all_subsets():
    rng = np.random.default_rng(6)
    for _ in range(200):
        sizes = sorted(set(rng.integers(1, 40, 5).tolist()))
        counts = rng.integers(1, 4, len(sizes)).tolist()
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        budget = int(rng.integers(0, sum(s * c for s, c in zip(sizes, counts)) + 1))
        take = mixing.fit_budget(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert sum(s * t for s, t in zip(sizes, take)) == max(x for x in sums if x <= budget)


PAGES = "page_id long, url string, html string"


def test_warc_round_trip_with_magic_inside(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    inner = "x" * 50 + fake + "WARC/1.0\r\nContent-Length: 999999\r\n\r\n" + "é" * 80
    pages = [(3, "http://a/", inner), (1, "http://b/ x\r\ny", inner), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "\r\n\r\n" * 60), (8, "u", fake * 30), (None, "u", "no id " * 40)]
    df = spark.createDataFrame(pages, PAGES)
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(pages)
    for i, _, h in pages:
        raw = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert (got[3]["record_type"], got[3]["refers_to"]) == ("revisit", 1) and got[1]["record_type"] == "response"
    assert got[2]["record_type"] == got[4]["record_type"] == "response" and got[4]["refers_to"] is None
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("span", [700, 5000])
def test_warc_reading_in_small_ranges(spark, span, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    pages = [(i, f"http://h/{i}", (fake + f"page {i} ") * (1 + i % 9)) for i in range(60)]
    path = "file://" + str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(pages, PAGES).coalesce(2), path, file_bytes=25 * warc.CLASSES[0])
    got = warc.read_archives(spark, path, span=span).collect()
    assert sorted((r["page_id"], r["payload"].decode()) for r in got) == sorted((i, h) for i, _, h in pages)


def test_warc_large_pages_long_urls_and_repeated_ids(spark, tmp_path):
    pages = [(1, "http://h/" + "u" * 200_000, "small"), (2, "http://h/2", "x" * (warc.RANGE + 100)), (2, "http://h/2", "x" * (warc.RANGE + 100)), (3, "http://h/3", "x" * (warc.RANGE + 100)), (4, "h", "y" * 100_000), (5, "h", "z")]
    df = spark.createDataFrame(pages, PAGES).selectExpr("*", "1 as digest", "2 as bytes", "'x' as refers_to")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    assert got == [(1, 5, "response", None), (2, warc.RANGE + 100, "response", None), (2, warc.RANGE + 100, "response", None), (3, warc.RANGE + 100, "revisit", 2), (4, 100_000, "response", None), (5, 1, "response", None)]
    path = str(tmp_path / "warc")
    warc.write_archives(df, "file://" + path, file_bytes=1 << 20)
    sizes = [f.stat().st_size for f in (tmp_path / "warc").rglob("part-*")]
    assert sum(n > 1 << 20 for n in sizes) == 2  # one record each


@pytest.mark.parametrize("span", [3000, warc.RANGE])
def test_warc_headers_of_any_length(spark, span, tmp_path):
    long = "http://h/" + "p" * (5 * warc.HEADER)
    pages = [(i, long + "WARC/1.1" if i % 4 == 1 else f"http://h/{i}", f"page {i} " * 40) for i in range(12)]
    df = spark.createDataFrame(pages, PAGES)
    path = "file://" + str(tmp_path / "warc")
    warc.write_archives(df.coalesce(1), path)
    got = warc.read_archives(spark, path, span=span).collect()
    assert sorted((r["page_id"], r["url"], r["payload"].decode()) for r in got) == sorted(pages)
    assert warc.round_trip(df).count() == len(pages)


def test_warc_broken_archives_fail(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\nContent-Length: 50\r\n\r\nabc\r\n\r\n")
    with pytest.raises(ValueError, match="stop before its end"):
        warc.read_archives(spark, "file://" + str(tmp_path))


def test_range_exits_by_walking():
    rng = np.random.default_rng(0)
    offsets = np.sort(rng.choice(5000, 300, False))
    nexts = offsets + rng.integers(1, 400, 300)
    nexts = np.where(rng.random(300) < 0.8, offsets[np.minimum(np.searchsorted(offsets, nexts), 299)], nexts)
    nexts = np.maximum(nexts, offsets + 1)
    known = dict(zip(offsets.tolist(), nexts.tolist()))
    for o, e in zip(offsets.tolist(), warc.range_exits(offsets, nexts, 4500).tolist()):
        while o in known:
            o = known[o]
        assert e == (o if o >= 4500 else -1)


def test_html_main_text(spark):
    noise = '<nav><a>m</a></nav><div class="cookie-notice">c</div><script>var a="</p>";</script><style>p{}</style>'
    page = f"<html><head><title>T</title></head><body><header>h</header>{noise}<article><h1>A &amp; B</h1><p>one <b>t</b>wo<br>three<p>four&nbsp;&lt;x&gt;<!-- c --><form>f</form><div id=comments><p>bad</p></div></article><aside>s</aside><footer>f</footer>"
    rows = [(1, "http://h/1", page), (2, None, None), (3, "x", ""), (4, "http://h/2", "plain text"), (4, "http://h/2", "plain text"), (5, "http://h/", "<p>open <div>unclosed"), (6, "http://h/", "<" * 50 + "a" * 100)]
    got = html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and by[1]["text"] == "A & B one two three four <x>" and by[1]["n_chars"] == len(by[1]["text"])
    assert by[2]["text"] == by[3]["text"] == "" and by[4]["text"] == "plain text" and by[5]["text"] == "open unclosed"


def test_html_article_inside_a_wrapper_with_a_telling_name():
    page = '<body><div class="has-sidebar"><main><article><p>story</p><article class="comment">no</article></article></main><div id="sidebar">x</div></div>'
    assert html_extract.main_text(page) == "story"


def test_names_inside_an_article():
    keep = '<article><div class="story related-events">one</div><p class="share-price">two</p><ul class="menu"><li>three</ul><p class="commentary">four</p></article>'
    assert html_extract.main_text(keep) == "one two three four"
    drop = '<article><p>x</p><div class="ad-slot">a</div><div class="related">b</div><div id="comments">c</div><div class="newsletter-signup">d</div><p hidden>e</p></article>'
    assert html_extract.main_text(drop) == "x"


@pytest.mark.parametrize("part", ["<a ", '<div class="x">', "<b></i>", '<a x="><a ', "<td>", "<div><p>", "<!--", "</p>", "<script>", "&amp", "<li class=a>", "<p><b>"])
def test_parsing_is_linear(part):
    import time

    def seconds(n):
        began = time.process_time()
        html_extract.main_text(part * n)
        html_extract.style_nodes(part * n)
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 60 * (seconds(4_000) + 0.02)


def site(spark):
    rows = [(i, "http://site.org/%d" % i, f'<body><div class="box7">Read our house rules</div><div class="body3"><p>story {i} is told</p><i>{i % 3}</i></div></body>') for i in range(30)]
    rows += [(100 + i, "http://small.org/%d" % i, '<body><div class="box7">kept here</div></body>') for i in range(3)]
    rows += [(200 + i, "HTTP://Third.net:80/", f'<body><nav><ul><li><a>{"ab"[i % 2]}</a></ul></nav><article><p>new {i}</p><div class="x{i}">same in all</div><p>also the same</p></article></body>') for i in range(20)]
    rows += [(300, None, "<nav>m</nav><p>no host</p>"), (301, "http://one.org/", "<div>single</div>"), (302, "http://site.org/", ""), (303, "http://site.org/", None), (None, "http://site.org/", "x < y"), (301, "http://one.org/", "<div>single</div>")]
    return rows, spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as host", "2 as path", "3 as text", "4 as low")


def test_site_style_tree_removes_repeated_branches(spark):
    rows, pages = site(spark)
    out = html_extract.extract(pages)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == len(rows)
    assert all(got[i] == f"story {i} is told {i % 3}" for i in range(30)) and got[100] == "kept here"
    assert got[205] == "new 5 also the same" and got[300] == "no host" and got[301] == "single" and got[None] == "x < y"
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_templates_without_broadcast(spark, monkeypatch):
    _, pages = site(spark)
    want = sorted(map(str, html_extract.extract(pages).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_PATHS", 0)
    assert sorted(map(str, html_extract.extract(pages).collect())) == want


def test_site_style_tree_by_its_definition(spark):
    from collections import Counter

    rows, pages = site(spark)
    seen = {}  # host: path: (kind: values of the pages), parent, role
    for _, url, page in rows:
        host = re.match(r"\w+://([^/:]*)", url)[1].lower() if url else ""
        for chain, role, content, shape in html_extract.style_nodes(page) if host else ():
            node = seen.setdefault((host, chain), ([], [], role))
            node[0].extend([content] if content is not None else [])
            node[1].extend([shape] if shape is not None else [])

    def entropy(values):
        m = len(values)
        return 1.0 if m < 2 else -sum(n / m * np.log(n / m) for n in Counter(values).values()) / np.log(m)

    want = {}
    for (host, chain), (content, shape, role) in seen.items():
        below = [c for (h, other), (c, _, _) in seen.items() if h == host and other[: len(chain)] == chain and c]
        mean = sum(len(c) * entropy(c) for c in below) / sum(map(len, below)) if below else None
        own = entropy(shape) if shape else None
        value = mean if own is None else own if mean is None else 0.1 * own + 0.9 * mean
        want[host, chain[-1]] = (chain[-2] if len(chain) > 1 else 0, role, max(len(content), len(shape)), value)
    got = {(r["host"], r["path"]): (r["parent"], r["role"], r["pages"], r["importance"]) for r in html_extract.site_style_tree(pages).collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items() if v[2]}
    assert all(abs(got[k][3] - want[k][3]) < 1e-9 for k in got)
    low = {(r["host"], r["path"]) for r in html_extract.templates(html_extract.site_style_tree(pages)).collect()}
    top = {}
    for (host, _), (parent, _, _, value) in got.items():
        top[host, parent] = max(value, top.get((host, parent), 0))
    for k, (parent, role, m, value) in got.items():
        small = value < (1 - 2 / m) * 0.9 * top[k[0], parent]
        assert (k in low) == (role == 0 and small or role == 1 and small and value < (1 - 2 / m) * 0.25)
    assert low


def brute_toxicity(text, model):
    """A text's score from the trained table, word by word in plain Python."""
    base, mask = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def bucket(gram, n):
        return mixed((sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(gram)) + n) & mask) % toxicity.BUCKETS

    values = []
    for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        word = re.sub(rb"[A-Z]", lambda m: m[0].lower(), word)
        edged = b" " + word + b" "
        found = [bucket(edged[i : i + n], n) for n in toxicity.GRAMS for i in range(len(edged) - n + 1)] + [bucket(word, 99)]
        values.append(np.mean([model.table[b] for b in found]))
    windows = [values[a : a + toxicity.WINDOW] for a in range(0, len(values), toxicity.WINDOW)]
    mean = sum(values) / max(len(values), toxicity.LEAST_WORDS)
    best = max((sum(w) / max(len(w), toxicity.LEAST_WORDS) for w in windows), default=0.0)
    return 1 / (1 + np.exp(-(mean * model.slopes[0] + best * model.slopes[1] + model.shift)))


def test_toxicity_scores_by_hand(spark):
    table = np.random.default_rng(3).standard_normal(toxicity.BUCKETS).astype(np.float32)
    model = toxicity.ToxicityModel(table, (0.7, 1.1), -0.4)
    asked = [(1, "You BLOCKHEAD, nïtwit 日本 a"), (2, None), (3, ""), (4, "word " * 900 + "Bad"), (4, "x"), (None, "null id"), (5, "y" * 2000), (6, "\t a\x1fb \n")]
    rows = docs(spark, asked).selectExpr("*", "'own' as score", "3 as predicted", "4 as mean")
    out = toxicity.score(rows, model)
    assert out.columns == [*DOCS_NAMES, "mean", "score", "predicted"]
    got = sorted((str(r["doc_id"]), r["text"] or "", r["score"], r["predicted"]) for r in out.collect())
    want = sorted((str(i), t or "", brute_toxicity(t, model)) for i, t in asked)
    for (i, t, score, predicted), (j, u, value) in zip(got, want):
        assert (i, t) == (j, u) and abs(score - value) < 1e-6 and predicted == int(score >= 0.3)
    even = toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS, np.float32), (0.0, 0.0), float(np.log(0.3 / 0.7)))
    tied = toxicity.score(docs(spark, [(1, "a")]), even, threshold=toxicity.score(docs(spark, [(1, "a")]), even).first()["score"]).first()
    assert tied["predicted"] == 1


@pytest.mark.parametrize("labels,low,high", [([], 0.01, 0.03), ([(i, 1, 0) for i in range(40)], 0.01, 0.03), ([(i, 1, 1) for i in range(40)], 0.97, 0.99)])
def test_toxicity_without_two_classes(spark, labels, low, high):
    rows = docs(spark, [(i, f"word{i} and more") for i in range(40)] + [(0, "again"), (None, "x")])
    got = toxicity.toxicity(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 42 and all(low <= r["score"] <= high for r in got)


def test_sample_of_toxicity_is_bounded_and_repeatable(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(30)) + (" badword" if i % 3 == 0 else "")) for i in range(120)] + [(3, "another text of three")] * 3
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows[:120]], "doc_id long, quality int, toxic int")
    a, b = (toxicity.fit(docs(spark, rows).repartition(n), labels, words=1500) for n in (2, 5))
    assert (a.table == b.table).all() and a.slopes == b.slopes and a.table.any()
    assert not toxicity.fit(docs(spark, rows), labels, words=10).table.any()


def test_packing_and_tokens_of_nothing_repeats_and_extra_columns(spark):
    few = docs(spark, [(1, "a b"), (1, "a b"), (None, "c"), (2, None)]).selectExpr("*", "1 as ids", "2 as block", "3 as n_tokens", "4 as row")
    got = packing.pack_tokens(few, RANKS, length=64).collect()
    assert sorted(str(d) for r in got for d in r["doc_ids"]) == ["1", "1", "2", "None"] and packing.pack_tokens(few.limit(0), RANKS).count() == 0
    encoded = sentencepiece_tok.encode_documents(few, MODEL).collect()
    assert len(encoded) == 4 and sentencepiece_tok.encode_documents(few.limit(0), MODEL).count() == 0


def test_toxicity_catches_misspellings(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(300)]
    bad = ["blockhead", "nitwit", "scumbag"]

    def text(toxic, n):
        w = list(rng.choice(words, n))
        for _ in range(max(2, n // 40) if toxic else 0):
            w.insert(int(rng.integers(len(w))), str(rng.choice(bad)))
        return " ".join(w)

    rows = [(i, text(i % 4 == 0, int(rng.integers(30, 200)))) for i in range(1200)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    extra = [(5000, " ".join(rng.choice(words, 60)) + " you blockheadd and nittwit"), (5001, None), (5002, "")]
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, rows + extra), labels).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 1200]
    right = sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) / len(held)
    assert right > 0.95 and got[5000]["score"] > got[5001]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.toxicity(docs(spark, []), labels.limit(0)).count() == 0


def spelled(text):
    """A text as the model reads it: white space as spaces, digits as 0, with white space around it."""
    return " " * quality.PAD + re.sub(r"[\x09-\x0D\x85\xA0]", " ", re.sub("[0-9]", "0", text)) + " "


def brute_kneser_ney(texts):
    """Modified Kneser-Ney by its definition, on dictionaries."""
    from collections import Counter

    order, level = quality.ORDER, Counter()
    for t in texts:
        s = spelled(t)
        level.update(s[i : i + order] for i in range(len(s) - order + 1))
    levels = [level]
    for n in range(order - 1, 0, -1):
        levels.append(Counter(g[-n:] for g in levels[-1]))
    tables = []
    for c in reversed(levels):
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [max(0.05, min(k - 0.01, k - (k + 1) * y * b / a)) if a and b else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        sums, cut = Counter(), Counter()
        for g, v in c.items():
            sums[g[:-1]] += v
            cut[g[:-1]] += d[min(v, 3) - 1]
        tables.append((c, sums, cut, d))

    def p(gram):
        if not gram:
            return 1 / 0x110000
        c, sums, cut, d = tables[len(gram) - 1]
        h = gram[:-1]
        if not sums[h]:
            return p(gram[1:])
        v = c[gram]
        return (max(0, v - d[min(v, 3) - 1]) if v else 0) / sums[h] + cut[h] / sums[h] * p(gram[1:])

    return p


@pytest.mark.parametrize("table_rows", [quality.TABLE_ROWS, 60, 0])
def test_perplexities_match_the_definition(spark, table_rows):
    taught = ["the cat sat on the mat.", "A cat, the hat; the CAT!", "é è ß 12 日本語 日本", "aaaa bbb", "Привет мир"]
    asked = [*taught, "the mat sat", "Z", "日本の", "привет", "the  cat\t99", None, "", "x" * 300, "мир\U0010ffff", "the mat sat"]
    model = quality.Model(docs(spark, [(i, t) for i, t in enumerate(taught)]), table_rows)
    assert model.whole == (table_rows == quality.TABLE_ROWS)
    model.rate = None
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(asked)], "doc_id long, text string, k1 string")
    got = {r["doc_id"]: r["x"] for r in model.with_perplexity(rows, "x").collect()}
    p = brute_kneser_ney(taught)
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        if not t:
            assert got[i] is None
            continue
        s = spelled(t)
        logs = [np.log(p(s[k - quality.ORDER : k])) for k in range(quality.ORDER, len(s) + 1)]
        assert abs(got[i] / np.exp(-np.mean(logs)) - 1) < 1e-4


def test_probabilities_sum_to_one():
    p = brute_kneser_ney(["the cat sat on the mat.", "ab ab"])
    seen = {c for t in ("the cat sat on the mat.", "ab ab") for c in spelled(t)}
    for h in ("the ", " cat", "zzzz", "atsa"):
        rest = p(h + "\U0010ffff") * (0x110000 - len(seen))
        assert abs(sum(p(h + c) for c in seen) + rest - 1) < 1e-6


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = np.random.default_rng(2)
    words = ["the", "cat", "house", "river", "green", "runs", "over", "stone", "and", "with"]
    good = [(i, " ".join(rng.choice(words, 60)) + ".") for i in range(200)]
    junk = [(1000 + i, " ".join(w + "###$$%" for w in rng.choice(words, 60))) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:150]] + [(1000, 0, 0)], "doc_id long, quality int, toxic int")
    rows = docs(spark, good + junk + [(3000, None), (3001, ""), (0, good[0][1]), (None, good[1][1]), (3002, good[2][1] * 3000)])
    rows = rows.selectExpr("*", "'own' as _lang", "1 as lang_of", "2 as KEPT", "'a' as k1").drop("KEPT")
    out = quality.classify(rows, labels)
    assert out.columns == [*rows.columns, "perplexity", "threshold", "kept"] and out.count() == rows.count()
    assert quality.classify(rows.limit(0), labels).count() == 0
    got = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert got[None] and got[3002]
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in junk) and not got[3000] and not got[3001]
    assert all(r["kept"] for r in quality.classify(docs(spark, good[:3]), labels.limit(0)).collect())


def test_long_text_counts_like_short_ones():
    t = "ab c" * 100_000 + "é"
    parts = [(codes[at], rows) for codes, at, rows in quality.pieces(pa.array(["x", t, None, "", "yz"]))]
    assert "".join(map(chr, np.concatenate([c for c, _ in parts]))) == "x " + t + " yz "
    assert np.bincount(np.concatenate([r for _, r in parts])).tolist() == [2, len(t) + 1, 0, 0, 3]
    codes, at, _ = next(quality.pieces(pa.array(["ab"])))
    assert [int(codes[i - 1]) for i in at] == [32, 97, 98]


def test_table_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, np.int64))
    keys = np.concatenate((keys, keys[:500] ^ (np.int64(1) << np.int64(40))))  # these share slots
    values = rng.random(len(keys)).astype(np.float32)
    table = quality.GramTable(keys, values)
    assert (table.get(keys.view(np.uint64)) == values).all()
    assert np.isnan(table.get(rng.integers(0, 1 << 63, 1000, np.int64).astype(np.uint64) ^ np.uint64(1 << 63))).all()


def test_repeats_of_words():
    same, pairs = quality.repeats(pa.array(["a a A b", None, "b b", "", "x", "x y x"]))
    assert same.tolist() == [2, 0, 1, 0, 0, 0] and pairs.tolist() == [3, 0, 1, 0, 0, 2]


def test_quality_drops_repetition(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(300)]
    good = [(i, " ".join(rng.choice(words, 80))) for i in range(200)]
    again = [(1000 + i, " ".join(w for w in rng.choice(words, 5) for _ in range(16))) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs(spark, good + again), labels).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in again)
