"""The pipeline and language profiles against brute force, and all queries over texts of some million characters."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from symbolith.llm import bpe, langid, mixing, quality, registry


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with copies, spaced copies, near copies of 0.86 to 0.98, junk, and nulls; far ones are below 0.7."""
    r = random.Random(21)
    words = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 8))) for _ in range(1500)]
    rows = []

    def add(text):
        rows.append((len(rows) * 3 % 1009, text, r.choice(["en", "fr", None]), r.choice(["s", "t", "u", None]), len(text or "")))

    for k in range(120):
        own = [r.choice(words) for _ in range(r.randint(60, 400))]
        add(" ".join(own))
        if k % 4 == 0:
            add("\n ".join(own))
        if k % 3 == 0:
            two = list(own)
            for at in r.sample(range(len(two)), max(1, len(two) // 120)):
                two[at] = "changed"
            add(" ".join(two))
        if k % 5 == 0:
            add(" ".join(own[: len(own) // 2] + [r.choice(words) for _ in range(len(own) // 2)]))
    for text in ("", None, "few words", "#* " * 80, "LOUD WORDS " * 60, "again and again " * 40):
        add(text)
    out = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{out}/documents.parquet")
    return out, rows


def test_pipeline_against_brute_force(spark, corpus):
    path, rows = corpus
    left = [x for x in rows if not any(rule(quality.Document(x[1])) for rule in quality.RULES.values())]
    docs = corpus_pipeline.rules(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert {d.doc_id for d in docs.collect()} == {x[0] for x in left} and len(left) < len(rows)
    best = {}
    for x in left:
        key = re.sub(r"[\x20\x09-\x0D]+", "", x[1])
        best[key] = min(best.get(key, (0, 0, None)), (-len(x[1]), x[0], x), key=lambda b: b[:2])
    left = [b[2] for b in best.values()]
    docs = corpus_pipeline.exact(spark, docs, path)
    assert {d.doc_id for d in docs.collect()} == {x[0] for x in left}
    sets = [shingles(x[1]) for x in left]
    label = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                label = [label[i] if y == label[j] else y for y in label]
    kept = {min(x[0] for x, y in zip(left, label, strict=True) if y == z) for z in label}
    docs = corpus_pipeline.near(spark, docs, path)
    assert {d.doc_id for d in docs.collect()} == kept and len(kept) < len(left)
    left = [x for x in left if x[0] in kept]
    out = corpus_pipeline.run(spark, path).collect()
    tokens = bpe.PairIndexBpe(bpe.vocabulary())
    text = {x[0]: x[1] for x in left}
    assert {o.doc_id for o in out} <= kept and all(o.token_ids == tokens.encode(text[o.doc_id]) for o in out)
    size, taken = Counter(), Counter()
    for x in left:
        size[x[3]] += len(x[1].split())
    for o in out:
        taken[o.source] += len(o.text.split())
    assert max(Counter(o.doc_id for o in out).values()) <= mixing.MOST
    goal = {t["source"]: t["target"] for t in mixing.targets(spark.createDataFrame([(s, 0, n) for s, n in size.items()], "source string, block int, block_size long")).collect()}
    longest = max(len(x[1].split()) for x in left)
    assert all(abs(taken[s] - goal[s]) <= longest for s in size)


def test_language_profiles_against_brute_force(spark, corpus):
    path, rows = corpus
    letter = lambda c: np.random.default_rng([langid.SEED, ord(c) if c != " " else 0]).integers(0, 2, langid.DIM, np.int8).astype(int) * 2 - 1

    def vector(text):
        line = " " + re.sub(r"[^a-zé]+", " ", (text or "").lower()).strip() + " "
        runs = Counter(line[k : k + 3] for k in range(len(line) - 2) if line[k : k + 3].strip())
        return sum((n * np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for (a, b, c), n in runs.items()), np.zeros(langid.DIM))

    some = rows[:25]
    unit = {x[0]: v / max(np.linalg.norm(v), 1e-9) for x in some for v in [vector(x[1])]}
    learned = {}
    docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.out for r in docs.select("doc_id", langid.held_out().alias("out")).collect()}
    for x in some:
        if x[2] is not None and not out[x[0]]:
            learned[x[2]] = learned.get(x[2], 0) + np.rint(unit[x[0]] * langid.SCALE)
    learned = {k: v / np.linalg.norm(v) for k, v in sorted(learned.items())}
    for g in langid.predict(docs, langid.fit(docs.filter(~langid.held_out()))).collect():
        cosine = {k: float(unit[g.doc_id] @ v) for k, v in learned.items()}
        assert g.lang_pred in cosine and abs(cosine[g.lang_pred] - max(cosine.values())) < 1e-4 and abs(g.score - cosine[g.lang_pred]) < 1e-4


#: Queries whose rows aren't documents.
OTHER_ROWS = ("op7_html", "op8_passages", "op11_filter_audit", "op12_topk")


def tables_beside(spark, folder):
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")


def test_texts_of_some_million_characters(spark, tmp_path):
    """Every query over long texts: one of many words, its copy with a word changed, one word without an end, and one line repeated."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    long = [r.choice(words) for _ in range(250_000)]
    other = [*long[:100_000], "changed", *long[100_001:]]
    texts = [" ".join(long), " ".join(other), "".join(r.choice("abcdefgh") for _ in range(1_500_000)), "one and the same line\n" * 60_000, "short"]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    page = "<html><body><nav><a href=x>Home</a></nav><article>" + "".join(f"<p>{' '.join(long[k : k + 60])}." for k in range(0, 120_000, 60)) + "</article></body></html>"
    spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    tables_beside(spark, tmp_path)
    found = {name: run(spark, str(tmp_path)).collect() for name, run in registry.QUERIES.items()}
    assert all(len(found[n]) == len(texts) for n in found if n not in OTHER_ROWS)
    assert [g.kept for g in sorted(found["op11_filter_audit"], key=lambda g: g.step) if g.filter_order == "ABCDE"][:2] == [3, 0]  # long texts that repeat their words
    assert all(g.n_a > 100_000 and g.n_b > 100_000 and g.groups_sha256 for g in found["op13_align_tokens"] if g.doc_id < 4)
    assert found["op7_html"][0].n_chars > 700_000 and not found["op7_html"][0].text.startswith("Home")
    spans = {g.doc_id: (g.start_word, g.end_word, g.other_id) for g in found["op8_passages"]}
    assert spans[1] == (0, 250_000, 0)
    removed = {g.doc_id: (g.n_removed, g.n_spans) for g in found["op9_suffix_dedup"]}
    assert removed[0] == (0, 0) and removed[1][1] == 2 and len(texts[1]) - removed[1][0] < 60 and removed[3] == (0, 0)
    assert {g.doc_id: g.text_sha256 for g in found["op4_exact_dedup"]} == {k: hashlib.sha256(re.sub(r"\s+", "", t).encode()).hexdigest() for k, t in enumerate(texts)}


def test_files_of_short_texts_only(spark, tmp_path):
    """Groups without a seed or an anchor, beside others."""
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(["a b", "", None, "a b", "c"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    tables_beside(spark, tmp_path)
    for name, run in registry.QUERIES.items():
        if name not in OTHER_ROWS:
            assert run(spark, str(tmp_path)).count() == 5, name
    assert [(g.kind, g.doc_id, g.other_id) for g in registry.QUERIES["op8_passages"](spark, str(tmp_path)).orderBy("doc_id").collect()] == [("copy", 2, 1), ("copy", 3, 0)]
