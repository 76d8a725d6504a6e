"""The operators against brute force, on documents with nulls, repeated rows, empty and long texts and clashing columns."""

import hashlib
import random
import re
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from symbolith.llm import bpe, bwt, exact_dedup, html_blocks, html_extract, html_training, langid, mixing, passages, pii, quality, registry, simhash, suffix_dedup
from symbolith.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, file string, recipe string, shard int"
SPACES = " \t\n\r\x0b\x0c"


def make():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgéñ") for _ in range(r.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = prose(400), prose(80)
    near = base.split(" ")
    near[200] = "changed"
    texts = [base, base, base.replace(" ", "\n "), " ".join(near), None, None, "", " \t", "?", "x", prose(60), passage, prose(50) + " " + passage + " " + prose(40), passage + prose(30)]
    texts += ["As " * 400, "ab" * 3000, prose(9000), "中文" * 40 + " é\U0001f600", "a<|endoftext|>b", "l1 one two\nl2\nl1 one two\nl2\n" * 9, base[:49], base[:50], "THE LOUD " * 60, "a### b*** " * 60]
    texts += ["mail me.x@b.example.com, call +1 (743) 555-3824 or 4111 1111 1111 1111 from 10.0.0.1 and 1.2.3.999"]
    ids = [7, 3, 9, 12, None, 4, 4, 4, 100, 101, 102, 20, 21, 22, 30, 31, 32, 33, 34, 35, 1, 2, 40, 41, 50]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["s", "t", "u", None]), 0, 1, "f", "r", 2) for i, t in zip(ids, texts, strict=True)]
    return rows + rows[:2] + rows[4:5]


ROWS = make()
LABEL_SCHEMA, VECTOR_SCHEMA = "doc_id long, quality int, toxic int", "vec_id long, embedding array<float>, label int, block int, score string"
LABELS = [(7, 1, 0), (3, 1, 1), (4, None, 1), (4, 1, None), (None, 1, 1), (30, 0, 0), (999, 1, 1)]
VECTORS = [(i, [((i * 37 + k * 11) % 23 - 11) / 16 for k in range(6)], 0, 1, "s") for i in [*range(95, 140), 100, 200, 200, 300]]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "<p>x")], "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    spark.createDataFrame(LABELS, LABEL_SCHEMA).write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(VECTORS, VECTOR_SCHEMA).repartition(3).write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    spark.createDataFrame([], LABEL_SCHEMA).write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([], VECTOR_SCHEMA).write.parquet(f"{out}/embeddings.parquet")
    return out


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_table(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_runs_agree(spark, sf, name):
    run = registry.QUERIES[name]
    assert rows(run(spark, sf)) == rows(run(spark, sf))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    asked = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in asked.description]
    want = asked.fetchall()
    got = [tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, sf).collect()]
    assert len(want) > 20
    assert Counter(got) == Counter(want)


def test_exact(spark, sf):
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    group = {}
    for r in ROWS:
        group.setdefault(strip(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    got = registry.QUERIES["op4_exact_dedup"](spark, sf).collect()
    want = Counter()
    for r in ROWS:
        key = strip(r[1])
        best = min(group[key])
        want[r[0], None if best[1] else best[2], len(group[key]), hashlib.sha256(key.encode()).hexdigest()] += 1
    assert Counter((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got) == want
    assert sum(g.kept for g in got) == len(group) and all(g.doc_id == g.keep_id for g in got if g.kept)
    kept = exact_dedup.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet"))
    assert kept.count() == len(group) and kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_exact_without_files(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).count() == len({re.sub(r"[\x20\x09-\x0D]+", "", r[1] or "") for r in ROWS})


def test_mixing(spark, sf):
    got = registry.QUERIES["op2_mixing"](spark, sf).toPandas()
    size = {}
    for r in ROWS:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").encode().split())
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while open_:  # shares are handed out until none is above its cap
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s] + 1e-9}
        for s in over or open_:
            target[s] = 3 * size[s] if over else level * weight[s]
            left -= target[s]
        open_ -= over or open_
    assert sum(got["size"]) == sum(size.values()) and (got.taken <= 3 * got["size"]).all()
    assert sorted({(a, round(b, 6)) for a, b in zip(got.source_size, got.target)}) == sorted({(size[s], round(target[s], 6)) for s in order})
    for s in order:
        own = got[(got.source_size == size[s]) & ((got.target - target[s]).abs() < 1e-6)]
        assert abs(own.taken.sum() - target[s]) <= 1
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mix = mixing.mixture(docs)
    assert mix.agg({"taken": "sum"}).first()[0] == got.taken.sum() and mix.columns.count("shard") == 1
    assert mixing.mix_documents(docs).columns == docs.columns


def test_mixing_goes_through_the_tree(spark, sf, monkeypatch):
    """Draws are dealt as the tree says: shards are disjoint, hold its quotas, are in the order of their places; another tree mixes otherwise."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    how = {"blocks": 16, "levels": 2}
    mix = mixing.mixture(docs, **how).select("*", F.spark_partition_id().alias("part")).collect()
    for part in {m.part for m in mix}:
        own = [(m["shard"], m["place"]) for m in mix if m.part == part]
        assert own == sorted(own)
    assert len({(m.doc_id, m.text, m["shard"], m["place"]) for m in mix}) > 20
    _, target, drawn = mixing.plan(docs, **how)
    per = [d.asDict() for d in drawn.collect()]
    ranks = {t["source"]: t["rank"] for t in target.collect()}
    counts = Counter((ranks[d["source"]], d["shard"]) for d in per)
    draws = Counter(ranks[d["source"]] for d in per)
    quota = mixing.shard_quotas(spark.createDataFrame(list(draws.items()), "rank int, draws long"), 2, mixing.SEED).collect()
    assert counts == Counter({(q["rank"], q["shard"]): q.end - q.start for q in quota if q.end > q.start})
    assert max(Counter((d["source"], d["block"]) for d in per).values()) <= mixing.MOST
    before = rows(registry.QUERIES["op2_mixing"](spark, sf))
    tree = mixing.shard_quotas
    monkeypatch.setattr(mixing, "shard_quotas", lambda per, levels, seed: tree(per, levels, seed + 100))
    assert rows(registry.QUERIES["op2_mixing"](spark, sf)) != before


def test_hypergeometric_draws(spark):
    """The splitting tree keeps quotas, splits evenly, and its draws have the right mean and spread."""
    per = spark.createDataFrame([(0, 600), (1, 300), (2, 100), (3, 0)], "rank int, draws long")
    left = []
    for seed in range(40):
        ends = {}
        for x in sorted(mixing.shard_quotas(per, 3, seed * 10).collect()):
            ends.setdefault(x["rank"], []).append(x.end)
        assert [ends[k][-1] for k in range(4)] == [600, 300, 100, 0] and all(e == sorted(e) for e in ends.values())
        sizes = np.diff(np.array([[0, *ends[k]] for k in range(4)]), axis=1).sum(0)
        assert sizes.tolist() == [125] * 8
        left.append(ends[2][3])
    assert abs(np.mean(left) - 50) < 3 and 2 < np.std(left) < 8  # the deviation is 4.7


def test_languages(spark, sf):
    got = {(g.doc_id, g.lang_pred, g.score) for g in registry.QUERIES["op1_langid"](spark, sf).collect()}
    none = {r[0] for r in ROWS if not any(c.isalpha() for c in r[1] or "")}
    assert {g[0] for g in got if g[1] == "und"} == none - {4} | {4, None}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.op1_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()
    a, b = langid.profiles().vectors(["the cat sat", "abc"])[0], langid.Profiles().vectors(["the cat sat"])[0]
    assert (a[0] == b[0]).all()  # any machine draws the same vectors


def spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_personal_data(spark, sf):
    r = random.Random(2)
    for _ in range(30_000):
        text = "".join(r.choice("aB.@@-0159+ ()_%x\n.4") for _ in range(r.randrange(1, 60)))
        assert [s[:3] for s in pii.detect(text) if s[0] in pii.BASE] == spans(text), text
    for text in ("9" * 6000 + ".1.1.1", "1.1." * 500, "1 " * 1000, "a@" * 1000, "+1" * 1000, "(1) " * 500):
        assert [s[:3] for s in pii.detect(text) if s[0] in ("email", "card", "phone")] == [s for s in spans(text.replace(".1.1.1", "")) if s[0] != "ip"]
    for text in ("9" * 1_000_000, "1 " * 500_000, "a@" * 500_000, "+1" * 500_000, "1.1." * 250_000):
        assert len(pii.detect(text)) <= 125_000  # linear: it ends
    assert [s[:3] for s in pii.detect("0" * 5000 + ".1.2.3")] == [("ip", 0, 5006)] and pii.detect("1.2.3.256") == []
    got = {(g.doc_id, g.base_sha256) for g in registry.QUERIES["op3_pii"](spark, sf).collect()}
    assert got == {(x[0], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans(x[1] or "")).encode()).hexdigest()) for x in ROWS}
    assert [s[0] for s in pii.detect("bank account GB82 WEST 1234 5698 7654 32 here")] == ["iban"]
    assert pii.detect("bank account GB83 WEST 1234 5698 7654 32 here") == [] and pii.mod97("DE89370400440532013000")
    assert [s[0] for s in pii.detect("743 555 3824 is my phone")] == ["tel"]
    assert [s[0] for s in pii.detect("call 743 555 3824 now")] == ["tel"] and pii.detect("row 743 555 3824 now") == []
    masked = pii.redact(spark.read.parquet(f"{sf}/documents.parquet")).filter("doc_id = 50").first().text
    assert masked == "mail <EMAIL>, call <PHONE> or <CARD> from <IP> and 1.2.3.999"


def prints(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(len(w) - 2)] or [xxhash.xxh64_intdigest(b" ".join(w), 42)] * bool(w)
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, sf):
    got = registry.QUERIES["op5_simhash"](spark, sf).collect()
    fps = [prints(r[1]) for r in ROWS]
    label = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label = [label[i] if x == label[j] else x for x in label]
    least = {x: min((r[0] for r, y in zip(ROWS, label, strict=True) if x == y and r[0] is not None), default=None) for x in label}
    assert Counter((g.doc_id, g.fingerprint, g.component_id) for g in got) == Counter((r[0], f"{f:016x}", least[x]) for r, f, x in zip(ROWS, fps, label, strict=True))
    kept = simhash.near_dedup(spark.read.parquet(f"{sf}/documents.parquet"))
    ids = [r.doc_id for r in kept.collect()]
    assert 3 in ids and not {7, 9, 12} & set(ids) and {20, 21, 30, 31, 32} <= set(ids)


@pytest.mark.parametrize("n,bits,similarity,block", [(10**10, 3, None, 10**6), (300, 6, None, 40), (300, 6, 0.0, 40)])
def test_links(spark, n, bits, similarity, block, monkeypatch):
    """Partitions with thresholds above 0, and buckets cut into blocks, find the components of brute force."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = np.random.default_rng(3)
    centres = r.integers(-(2**63), 2**63, 60)
    fps = np.unique(np.concatenate([centres, *(centres ^ (np.int64(1) << r.integers(0, 62)) ^ (np.int64(1) << r.integers(0, 62)) ^ (np.int64(1) << r.integers(0, 62)) for _ in range(4))]))
    nodes = spark.createDataFrame([(int(f), bytes([1] * simhash.BINS)) for f in fps], "fp long, sketch binary")
    got = {x.vertex: x.root for x in components(simhash.links(nodes, n, fps, bits, similarity)).collect()}
    label = dict.fromkeys(fps.tolist())
    label = {f: f for f in label}
    for a in fps.tolist():
        for b in fps[np.bitwise_count(fps.view(np.uint64) ^ np.int64(a).view(np.uint64)) <= bits].tolist():
            x, y = sorted((label[a], label[b]))
            if x != y:
                label = {k: x if v == y else v for k, v in label.items()}
    assert got == {f: x for f, x in label.items() if sum(v == x for v in label.values()) > 1}


def test_thresholds():
    assert simhash.thresholds([[0, 1, 9], [0, 1, 9], [0, 50, 90]], 3)[1] in ([1, 1, -1], [0, 0, 1])
    parts = simhash.plan(np.random.default_rng(0).integers(-(2**63), 2**63, 500), 10**6, 5)
    assert sum(t + 1 for _, t in parts) == 6 and len({b for g, _ in parts for b in g}) == sum(len(g) for g, _ in parts)
    a, b = ({hash((k, "s")) for k in range(0, 900)}, {hash((k, "s")) for k in range(100, 1000)})
    h = lambda s: np.array([x & (2**64 - 1) for x in s], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x, y = (np.frombuffer(simhash.sketch(h(s)), np.uint8)[None] for s in (a, b))
    assert abs(simhash.likeness(x, y)[0] - 0.8) < 0.1


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(4000, 4100)]
    label = {v: v for e in edges for v in e}
    for a, b in edges:
        x, y = sorted((label[a], label[b]))
        label = {k: x if v == y else v for k, v in label.items()}
    size = Counter(label.values())
    got = {x.vertex: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: x for v, x in label.items() if size[x] > 1}


def test_bpe(spark, sf):
    from tokenizers import Tokenizer

    known, own = Tokenizer.from_file(bpe.vocabulary()), bpe.PairIndexBpe(bpe.vocabulary())
    r = random.Random(4)
    signs = [*"aaabbe  \n\t'sd'llve12３é̃中文😀#\x1c\x85  ſ", "<|endoftext|>", "th", "the ", "  ", "\r\n", "١٢"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(3000)] + [x[1] or "" for x in ROWS]
    for text, (ids, n, decoded) in zip(texts, own.encode_batch(texts), strict=True):
        want = known.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want)) and n == len(want) and decoded == known.decode(want, skip_special_tokens=False), text
    assert own.decode([own.byte_ids[0xFF]]) == "�" and own.encode("") == []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for g in bpe.encoded(docs, bpe.vocabulary()).collect():
        assert g.token_ids == known.encode(g.text or "", add_special_tokens=False).ids


def test_html(spark, sf):
    pages = html_training.pages(200, 77)
    right = [html_extract.field().labels(html_blocks.blocks(p)) == y for p, y in pages]
    assert np.mean(right) > 0.95  # pages none of which it was fitted on
    page = '<body><nav><ul><li><a href=x>Home</a></ul></nav><div class=ad>Buy it now.</div><article><h1>A &amp; B</h1><p>One\n  two<b>three</b>.<br><p>Four &lt;five&gt;.</article><footer>&copy; us</footer>'
    assert html_extract.field().extract(page) == "A & B One twothree. Four <five>."
    assert html_extract.field().extract(page.split("five")[0] + "</artic") == "A & B One twothree. Four <"
    got = {(g.page_id, g.url, g.n_chars == len(g.text)) for g in registry.QUERIES["op7_html"](spark, sf).collect()}
    assert got == {(1, "u", True), (2, None, True), (None, "v", True)}
    raw = "<p>a<script>if (x<y) '</p>'</script>b<!-- c --><textarea>d</textarea>e</p><style>f"
    assert [b.text for b in html_blocks.blocks(raw)] == ["a", "b", "e"]


class Article(HTMLParser):
    """The text of the article element by Python's own parser, without the parts that aren't the article's."""

    def __init__(self):
        super().__init__()
        self.depth, self.skip, self.out = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in html_blocks.VOID:
            self.out.append(" " if tag == "br" else "")
            return
        foreign = tag in ("script", "style", "aside", "nav", "form", "footer", "header", "section") or any(w in (v or "") for k, v in attrs if k in ("class", "id") for w in ("ad", "share", "comment", "cookie", "notice") if "article" in self.depth)
        self.depth.append(tag)
        self.skip += foreign and "article" in self.depth or self.skip > 0
        if tag not in html_blocks.INLINE:
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in self.depth:
            while self.depth.pop() != tag:
                self.skip -= self.skip > 0
            self.skip -= self.skip > 0
            if tag not in html_blocks.INLINE:
                self.out.append(" ")

    def handle_data(self, data):
        if "article" in self.depth and not self.skip:
            self.out.append(data)


def test_html_against_the_article_element(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("html like '%<article%'")
    got = {g.page_id: g.text for g in html_extract.extract(pages).select("page_id", "text").collect()}
    same = []
    for page in pages.collect():
        parser = Article()
        parser.feed(page.html)
        same.append(" ".join("".join(parser.out).split()) == got[page.page_id])
    print(f"{sum(same)} of {len(same)} pages as their article element")
    assert len(same) > 100 and np.mean(same) > 0.95


def test_html_of_any_depth():
    import resource
    import time

    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    for page in ("<div class=content>x " * 100_000, "<ul><li>y " * 50_000, "</b></td>z <p>" * 100_000, "<table><tr><td>q" * 30_000, "<a>" * 100_000):
        html_extract.field().extract(page)
    assert time.perf_counter() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
    long = "<article><p>" + "One sentence of the article. " * 40 + "We use cookies.</article>"
    assert html_extract.field().extract(long).endswith("We use cookies.")
    for page, _ in html_training.pages(30, 9):
        for block in html_blocks.blocks(page):
            field = html_extract.field()
            assert abs(field.of_path(block.node) - sum(field.weights.get(f, 0.0) for f in html_extract.path_features(block.node))) < 1e-9


def test_viterbi_against_all_labellings():
    from itertools import product

    field, r = html_extract.field(), random.Random(3)
    for page, _ in html_training.pages(60, 5):
        found = html_blocks.blocks(page)[:8]
        field.step = np.array([[r.uniform(-1, 1) for _ in "ab"] for _ in "ab"])
        scores = [field.score(b, i, len(found)) for i, b in enumerate(found)]
        value = lambda y: sum(s * v for s, v in zip(scores, y)) + sum(field.step[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert abs(value(field.labels(found)) - max(map(value, product((0, 1), repeat=len(found))))) < 1e-9
    html_extract.field.cache_clear()


def test_blocks_of_transforms():
    r = np.random.default_rng(0)
    for depth in (1, 3, 4, 12, 50):
        shards = [r.integers(97, 97 + r.integers(1, 4), r.integers(1, 150)).astype(np.uint8) for _ in range(4)]
        shards.append(shards[0].copy())
        got = np.concatenate(bwt.merged_blocks(shards, depth)).tolist()
        want = [(x.tobytes() * (depth // len(x) + 2))[k : k + depth] for x in shards for k in range(len(x))]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("large,long", [(2_000_000, 65_536), (200, 2_000)])
def test_suffixes(spark, sf, large, long, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    monkeypatch.setattr(suffix_dedup, "LONG", long)
    got = Counter(map(tuple, suffix_dedup.reports(spark.read.parquet(f"{sf}/documents.parquet")).collect()))
    first = {}
    ident = lambda r: suffix_dedup.NO_ID if r[0] is None else r[0]
    for r in ROWS:
        b = (r[1] or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(ident(r), first.get(b[k : k + 50], ident(r)))
    want = Counter()
    for r in ROWS:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b) + 2, int)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < ident(r):
                gone[k + 1 : k + 51] = 1
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        want[r[0], len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


def test_one_anchor_in_very_many_rows(spark, tmp_path):
    """A passage that 100,000 rows share, each time between other words: its anchors are split, so no task gets them all."""
    import time

    r = random.Random(8)
    core = "".join(r.choice("abcdefgh ") for _ in range(60))
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(12))
    texts = [f"{word()}{core}{word()}" for _ in range(100_000)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts})).repartition(8).write.parquet(path)
    began = time.perf_counter()
    got = {g.doc_id: (g.n_removed, g.n_spans) for g in suffix_dedup.reports(spark.read.parquet(path)).collect()}
    print(f"{time.perf_counter() - began:.0f} s")
    first = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], k)
    for k, t in enumerate(texts):
        gone = [False] * len(t)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < k:
                gone[i : i + 50] = [True] * 50
        assert got[k] == (sum(gone), sum(b and not a for a, b in zip([False, *gone], gone, strict=False)))


def test_passages(spark, sf):
    got = registry.QUERIES["op8_passages"](spark, sf).collect()
    pairs = {(g.doc_id, g.other_id) for g in got if g.kind == "passage"}
    assert {(12, 3), (21, 20), (22, 20)} <= pairs
    assert {(g.doc_id, g.other_id) for g in got if g.kind == "copy"} >= {(7, 3), (None, 4)}
    assert not any(100 <= (d or 0) <= 102 for d, _ in pairs)
    one = next(g for g in got if (g.doc_id, g.other_id) == (12, 3))
    assert (one.start_word, one.end_word, one.similarity) == (0, 400, 399 / 400)


def test_quality(spark, sf):
    got = {g.doc_id: g for g in registry.QUERIES["op10_quality"](spark, sf).collect()}
    assert got[3].kept and got[32].kept and got[102].kept
    assert not any(got[k].kept for k in (4, 30, 35, 40, 41, 100))
    for order in (list(quality.RULES), list(reversed(quality.RULES))):
        for r in ROWS:
            assert quality.verdict(quality.Document(r[1]), order) == (not any(rule(quality.Document(r[1])) for rule in quality.RULES.values()))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(got[r[0]].kept for r in ROWS if r[0] is not None)


def test_pipeline(spark, sf, empty):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf)
        assert step.columns == docs.columns, name
    out = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {7, 9, 12, 4, 30, 35, 40, 41, 100} and all(r.token_ids for r in out)
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pii_takes_linear_time():
    """Texts that are dense in spans of both sorts."""
    import time

    text = "call 743 555 3824 and a@b.co, +1 743 555 3824 " * 22_000
    assert len(text) > 1_000_000
    began = time.perf_counter()
    assert len(pii.detect(text)) == 66_000
    assert time.perf_counter() - began < 10


def test_added_spans_are_apart_from_base_spans():
    r = random.Random(3)
    parts = ["call 743 555 3824", "a@b.co", "10.0.0.1", "+1 (743) 555-3824", "4111 1111 1111 1111", "DE89370400440532013000", "tel 743-555-3824", "x", " ", "phone"]
    for _ in range(300):
        text = "".join(r.choice(parts) + r.choice([" ", "", ", "]) for _ in range(12))
        found = pii.detect(text)
        base = [(s, e) for k, s, e, _ in found if k in pii.BASE]
        want = [(k, s, e) for k, s, e, c in pii._proposed(text) if k not in pii.BASE and pii._score(text, k, s, e, c) >= pii.THRESHOLD and not any(a < e and s < b for a, b in base)]
        assert [x[:3] for x in found if x[0] not in pii.BASE] == want
