"""Shared passages against brute force: unchanged ones whose pieces stand in earlier rows, and changed ones by similarity."""

import random

import numpy as np
import pytest

from symbolith.llm import passages


def words(r, n):
    return ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 8))) for _ in range(n)]


def found(spark, tmp_path, texts):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(path)
    return passages.shared_passages(spark.read.parquet(path)).collect()


def longest_equal(a, b):
    """The longest run of words that stands in both: length, start in a."""
    at, best, row = {}, (0, 0), [0] * (len(b) + 1)
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    for i, w in enumerate(a):
        new = [0] * (len(b) + 1)
        for j in at.get(w, ()):
            new[j + 1] = row[j] + 1
            best = max(best, (new[j + 1], i + 1 - new[j + 1]))
        row = new
    return best


@pytest.mark.parametrize("n,cut", [(66, (28, 50)), (44, (22, 22)), (300, (180, 180)), (60, (30, 30)), (90, (50, 40))])
def test_pieces_in_earlier_rows(spark, tmp_path, n, cut):
    """B and C share n words, pieces of which stand in earlier rows. All texts with 39 equal words are linked, and a link of B and C
    that is told covers all n words."""
    r = random.Random(n)
    texts = []
    for _ in range(12):
        p = words(r, n)
        texts += [words(r, 40) + x + words(r, 30) for x in (p[: cut[0]], p[cut[1] :], p, p)]
    got = found(spark, tmp_path, texts)
    links = {}
    for g in got:
        links.setdefault(g.doc_id, {})[g.other_id] = max(links.get(g.doc_id, {}).get(g.other_id, 0), g.end_word - g.start_word)
    for i in range(len(texts)):
        for j in range(i):
            if i // 4 == j // 4 and longest_equal(texts[i], texts[j])[0] >= 39:
                assert j in links.get(i, {}) or set(links.get(i, {})) & set(links.get(j, {})), (i, j)
                if j in links[i] and (i % 4, j % 4) == (3, 2):
                    assert links[i][j] >= n
    if cut[0] < 30 and n - cut[1] < 30:
        assert all(links[i].get(i - 1, 0) >= n for i in range(3, len(texts), 4))


def test_random_texts(spark, tmp_path):
    """Texts pieced together from a pool of sentences: every pair with 39 equal words has a common representative."""
    r = random.Random(4)
    pool = [words(r, r.randint(5, 60)) for _ in range(40)]
    texts = [sum((r.choice(pool) if r.random() < 0.6 else words(r, 20) for _ in range(r.randint(2, 8))), []) for _ in range(90)]
    links = {k: {k} for k in range(len(texts))}
    for g in found(spark, tmp_path, texts):
        links[g.doc_id].add(g.other_id)
        if g.kind == "passage":
            a, b = texts[g.doc_id][g.start_word : g.end_word], texts[g.other_id][g.other_start : g.other_end]
            assert len(a) >= 30 and g.similarity >= 0.8 - 1e-9 and longest_equal(a, b)[0] >= 5
    for i in range(len(texts)):
        for j in range(i):
            if longest_equal(texts[i], texts[j])[0] >= 39:
                assert links[i] & links[j], (i, j)


def recall(spark, tmp_path, n_words, every, pairs=60):
    """Of passages of n_words words with one word in `every` changed, the share that is told, and the mean share of their words."""
    r = random.Random(n_words + every)
    texts = []
    for _ in range(pairs):
        p = words(r, n_words)
        q = list(p)
        for k in r.sample(range(n_words), round(n_words / every)):
            q[k] = "changed" + q[k]
        texts += [words(r, 60) + p + words(r, 60), words(r, 50) + q + words(r, 50)]
    hits = {}
    for g in found(spark, tmp_path, texts):
        assert g.doc_id % 2 and g.other_id == g.doc_id - 1 and g.start_word >= 48 and g.end_word <= n_words + 52
        hits[g.doc_id] = hits.get(g.doc_id, 0) + g.end_word - g.start_word
    return len(hits) / pairs, sum(hits.values()) / max(1, len(hits)) / n_words


@pytest.mark.parametrize("n_words,every,least", [(72, 25, 0.95), (72, 16, 0.95), (72, 12, 0.95), (50, 16, 0.95), (50, 10, 0.95), (100, 10, 0.95), (50, 7, 0.8), (100, 7, 0.95), (100, 5, 0.5),
                                                  (60, 12, 0.95), (60, 8, 0.95), (60, 5, 0.6), (50, 12, 0.95), (50, 8, 0.9), (50, 5, 0.3), (40, 15, 0.95), (40, 12, 0.95), (40, 8, 0.75), (40, 5, 0.1), (36, 12, 0.85), (30, 30, 0.7), (30, 15, 0.6)])
def test_changed_passages(spark, tmp_path, n_words, every, least):
    share, covered = recall(spark, tmp_path, n_words, every)
    print(f"{n_words} words, one in {every} changed: {share:.2f} told, {covered:.2f} of their words")
    assert share >= least


def test_alignment():
    assert passages.equal_words([1, 2, 3, 4], [1, 9, 3, 4]) == 3 and passages.equal_words([], [1]) == 0
    x, y = np.array([0, 5, 10, 12, 15]), np.array([0, 5, 200, 10, 15])
    assert passages.chains(x, y)[0] == [0, 1, 3, 4]
    own, home = [*range(50), 99, *range(51, 80)], [7, *range(80)]
    assert passages.alike(passages.segments(own, home, [(10, 11, 5)])) == [(0, 80, 1, 81, 79)]
    assert passages.alike(passages.segments(list(range(100)), list(range(1000, 1020)) + list(range(20)), [(0, 20, 5)])) == []
    assert passages.segments([1, 2, 3, 4, 5], [9, 2, 3, 4, 5], [(0, 0, 5)]) == []  # a clash of hashes is no seed
