"""The alignment against a plain one of whole texts, with spans in Python's own lists."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from symbolith.llm import align_tokens
from symbolith.llm.bpe import byte_signs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(9)
    odd = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", "\x00", " ", "▁", "é", "é", "中文", "😀", "ﬁ", "①", "don't", "I'll", "12345", "...", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "naïve", "$%", "﻿", "ß", "the"]
    out = [None, "", " ", "  ", "\n", "▁", "the the the", "the cat sat on the mat", " lead", "trail ", "trail \n", "a　 b", "word" * 5000, "中文" * 900, "<|endoftext|>"]
    out += ["".join(r.choice(odd + ["plain", " words", " here"]) for _ in range(r.randint(1, 40))) for _ in range(250)]
    out += [" ".join(r.choice(["some", "common", "words", "in", "lines\n", "of", "prose,"]) for _ in range(r.randint(5, 300))) for _ in range(60)]
    return out + out[5:9] + [out[-1]] * 100  # a third of all rows are copies


def brute(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {c: n for n, c in enumerate(byte_signs())}
    documents = []
    for text in texts:
        documents.append(None)
        if not text:
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not b"".join(raw[0]) == b"".join(raw[1]) == (" " + text).encode():
            continue
        owner = [[k for k, t in enumerate(side) for _ in t] for side in raw]
        links = list(dict.fromkeys(zip(*owner, strict=True)))
        cuts = [0] + [p for p in range(1, len(owner[0]) + 1) if p == len(owner[0]) or (owner[0][p] != owner[0][p - 1] and owner[1][p] != owner[1][p - 1])]
        side = lambda k, i, j: ",".join(str(ids[k][x]) for x in dict.fromkeys(owner[k][i:j]))
        groups = [f"{side(0, i, j)}|{side(1, i, j)}" for i, j in zip(cuts, cuts[1:], strict=False)]
        documents[-1] = len(ids[0]), len(ids[1]), groups, [(ids[0][x], ids[1][y]) for x, y in links]
    count = Counter(p for d in documents if d for p in set(d[3]))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (d[0], d[1], len(d[2]), len(d[3]), sum(count[p] == best[p[0]] for p in d[3]), sum(count[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()) if d else (0, 0, 0, 0, 0, 0, "")
        for d in documents
    ]


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 3000, "WINDOW": 50, "LEARN": 7, "KEEP": 40, "SALTS": 3}])
def test_alignment_is_that_of_whole_texts(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(align_tokens, name, value)
    found = texts()
    ids = [None if k % 50 == 3 else k // 2 for k in range(len(found))]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in zip(ids, found, strict=True)], "doc_id long, text string, block int, pairs string").repartition(5)
    got = align_tokens.alignment(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute(found)
    assert sum(w[0] == 0 for w in want) > 5
    assert Counter(map(tuple, got.collect())) == Counter((i, *w) for i, w in zip(ids, want, strict=True))


def test_sections_are_cut_only_where_no_token_crosses():
    v = align_tokens.Vocabularies(A, B)
    assert v.cuts
    whole = align_tokens.Vocabularies(A, B)
    whole.cuts = False
    for text in filter(None, texts()):
        parts = [s for sections in v.sections(text) for s in sections]
        assert "".join(parts) == " " + text
        blocks = []
        for one in (v, whole):
            blocks.append(align_tokens.Block(one))
            blocks[-1].add([(1, text)])
        (a, *_), (b, *_) = (x.columns() for x in blocks)
        assert [x.tolist() for x in a] == [x.tolist() for x in b] and blocks[0].digests == blocks[1].digests


def test_ids_of_other_types(spark):
    got = align_tokens.alignment(spark.createDataFrame([("x", "one two"), (None, None)], "name string, body string"), A, B, "name", "body").collect()
    assert sorted((r.doc_id or "", r.n_a, r.n_groups) for r in got) == [("", 0, 0), ("x", 2, 2)]
