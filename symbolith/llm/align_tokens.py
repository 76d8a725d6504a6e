"""Alignment of the tokens that two tokenizers make of the same text.

A is a byte-level BPE of a tokenizers file, B a sentencepiece model that marks spaces; both files are parameters. Each token
stands for bytes of a space and the text. Offsets where a token of A and one of B both end cut the text into groups, and two tokens are linked
if their bytes overlap: cumulated sizes give the ends, intersect1d the common ones, searchsorted each token's group, and each stretch
between two neighbouring ends of either kind is one link, whose tokens repeat() yields.

Texts are cut where white space begins, of the kinds of which no piece of B has any behind another sign. No token
crosses such a place (a model that changes text, or another pattern of A, takes texts whole), so a section is tokenized alike alone and in its text, tokens of both kinds end there, and each different
section of a batch is aligned once; what a text has is the sum over its sections.

How many documents hold a linked pair is counted in two shuffles: tasks count blocks of about BLOCK bytes of text, salted partial
sums follow, then the pair's sum. Counts return to the blocks that asked for them, a row per block and pair, not per document
and pair. So hot pairs cost a row a block, and no count table is broadcast.

Cases: a text that is null, empty, or whose tokens' bytes differ from the space and the text in A or B, has no tokens: zeros and ''; equal
rows and repeated ids are documents of their own; texts of any length are read in windows; an empty table gives an empty result; other
columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _S as WHITE
from .bpe import byte_signs, vocabulary
from .common import read, ship, slices, stash

BLOCK, WINDOW, LEARN, KEEP, SALTS = 8_000_000, 1_000_000, 20_000, 250_000, 16
_SPACES = [c for c in map(chr, range(0x3001)) if regex.match(f"[{WHITE}]", c)]
SPACE_MARK = "▁"
#: What a model's own changes of text would show in.
PROBE = "  a  b\n\n c\t\u00a0d\u3000ﬁ ① e "


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values, kind="stable")
    return values[np.r_[True, values[1:] != values[:-1]][: len(values)]]


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + sizes[i], of all i in a row."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Vocabularies:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_signs())}
        vocab = spec["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = b"".join(byte_of.get(c, c.encode()) for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.n_b, self.size_a, self.size_b = len(pieces), np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        before = spec.get("pre_tokenizer") or {}
        probe = b"".join(self.bytes_b[i] for i in self.b.encode(PROBE))
        self.cuts = not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and probe == b" " + PROBE.encode()
        inside = {y for p in pieces for x, y in zip(p, p[1:]) if not regex.match(f"[{WHITE}]", x) and (y != SPACE_MARK or x != SPACE_MARK)}
        on = "".join(c for c in _SPACES if c.replace(" ", SPACE_MARK) in inside)  # white space that can go on a piece
        more = f"(?:[{on}][{WHITE}]*[^{WHITE}]*)*" if on else ""
        self.section = regex.compile(f"[{WHITE}]*[^{WHITE}]+{more}|[{WHITE}]+")
        self.cut = regex.compile(f"(?<=[^{WHITE}])[{WHITE}--[{on}]]" if on else f"(?<=[^{WHITE}])[{WHITE}]", regex.V1)
        self.mark = self.b.piece_to_id(SPACE_MARK)
        self.reset()

    def reset(self) -> None:
        """Forget all sections."""
        self.known: dict[str, int] = {}
        self.strings: list[str] = []
        #: By section: numbers of tokens of A and B, groups, links, pairs, and whether its bytes are right. Of all pairs: code, and how often in the section.
        self.facts, self.pairs = np.zeros((6, 0), np.int64), np.zeros((2, 0), np.int64)

    def tokens(self, sections: list[str], ids: list[list[int]], raw: list[bytes], size: np.ndarray):
        """All tokens in a row, with their sizes and their number by section; sections whose bytes they don't give have none, and aren't right."""
        flat, n = np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))
        text, width = "".join(sections).encode(), np.fromiter((len(s.encode()) for s in sections), np.int64, len(sections))
        given = np.bincount(np.repeat(np.arange(len(ids)), n), size[flat], len(ids)).astype(np.int64)
        right = given == width
        if not (right.all() and b"".join(map(raw.__getitem__, flat.tolist())) == text):
            right = np.array([b"".join(map(raw.__getitem__, x)) == s.encode() for x, s in zip(ids, sections, strict=True)], bool)
        return flat, n, right

    def learn(self, sections: list[str]) -> None:
        """Tokenize and align sections all at once."""
        ids_a = [e.ids for e in self.a.encode_batch(sections, add_special_tokens=False)]
        # B adds a space: to take for the own one, or, where white space of another kind begins a section, to drop again
        own = [s[0] == " " for s in sections]
        ids_b = self.b.encode([s[1:] if x else s for s, x in zip(sections, own, strict=True)], num_threads=1)
        ids_b = [(ids or [self.mark]) if x else ids[1:] for ids, x in zip(ids_b, own, strict=True)]
        n = len(sections)
        (a, n_a, right), (b, n_b, right_b) = self.tokens(sections, ids_a, self.bytes_a, self.size_a), self.tokens(sections, ids_b, self.bytes_b, self.size_b)
        right &= right_b
        a, b, n_a, n_b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)], n_a * right, n_b * right
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        # a token of A has a link for each end of B inside it, and one for the stretch up to its own end
        inside = np.searchsorted(ends_b, ends_a, "left") - np.searchsorted(ends_b, np.r_[0, ends_a[:-1]], "right") + 1
        link_a = np.repeat(np.arange(len(a)), inside)
        link_b = np.searchsorted(ends_b, distinct(np.r_[ends_a, ends_b]))
        code, owner = a[link_a] * self.n_b + b[link_b], np.repeat(np.arange(n), n_a)[link_a]
        order = np.lexsort((code, owner))
        code, owner = code[order], owner[order]
        new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])][: len(code)])
        n_links, n_pairs = np.bincount(owner, minlength=n), np.bincount(owner[new], minlength=n)
        of = np.arange(len(common) + 1)
        cut_a, cut_b = np.searchsorted(group_a, of).tolist(), np.searchsorted(group_b, of).tolist()
        words_a, words_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups = [f"{','.join(words_a[i:j])}|{','.join(words_b[k:m])}" for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:], strict=False)]
        upto = np.searchsorted(common, np.r_[0, ends_a][np.cumsum(n_a)], "right")  # groups up to the end of each section
        self.known.update(zip(sections, range(len(self.strings), len(self.strings) + n), strict=True))
        self.strings += [";".join(groups[i:j]) for i, j in zip([0, *upto.tolist()], upto.tolist(), strict=False)]
        self.facts = np.hstack([self.facts, [n_a, n_b, np.diff(upto, prepend=0), n_links, n_pairs, right]])
        self.pairs = np.hstack([self.pairs, [code[new], np.diff(np.r_[new, len(code)])]])

    def sections(self, text: str):
        """The sections of a space and the text, in lists of about WINDOW characters each."""
        whole, at = " " + text, 0
        while at < len(whole):
            end = self.cut.search(whole, min(at + WINDOW, len(whole))) if self.cuts else None
            stop = end.start() if end else len(whole)
            yield self.section.findall(whole, at, stop) if self.cuts else [whole]
            at = stop

    def know(self, sections) -> None:
        new = [*dict.fromkeys(s for s in sections if s not in self.known)]
        for at in range(0, len(new), LEARN):
            self.learn(new[at : at + LEARN])


class Block:
    """Documents that are counted together."""

    def __init__(self, v: Vocabularies):
        self.v, self.ids, self.found, self.digests, self.size = v, [], [], [], 0

    def add(self, rows: list[tuple]) -> None:
        """rows: ids and texts. The sections of short texts are learnt together."""
        short = [next(self.v.sections(text), []) if text and len(text) <= WINDOW else None for _, text in rows]
        self.v.know(chain.from_iterable(filter(None, short)))
        for (doc_id, text), sections in zip(rows, short, strict=True):
            self._add(doc_id, text or "", [sections] if sections else self.v.sections(text or ""))

    def _add(self, doc_id, text: str, windows) -> None:
        parts, digest, right = [], hashlib.sha256(), bool(text)
        for sections in windows if text else ():
            self.v.know(sections)
            part = np.fromiter(map(self.v.known.__getitem__, sections), np.int32, len(sections))
            right = self.v.facts[5, part].all()
            if not right:
                break
            digest.update((";" * bool(parts) + ";".join(map(self.v.strings.__getitem__, part.tolist()))).encode())
            parts.append(part)
        self.ids.append(doc_id)
        self.found.append(np.concatenate(parts) if right else np.zeros(0, np.int32))
        self.digests.append(digest.hexdigest() if right else "")
        self.size += len(text)

    def columns(self):
        """Of the documents: n_a, n_b, n_groups, n_links, offsets into items (sections) and their times. Of the block: each item's
        number of pairs, which pairs, how often; the pairs, and how many documents have each."""
        v, n = self.v, len(self.ids)
        doc, section = np.repeat(np.arange(n), [len(f) for f in self.found]), np.concatenate([*self.found, np.zeros(0, np.int32)]).astype(np.int64)
        used, item = np.unique(section, return_inverse=True)
        totals = [np.bincount(doc, v.facts[k, section], n).astype(np.int64) for k in range(4)]
        key, times = np.unique(doc * max(1, len(used)) + item, return_counts=True)
        doc, item = np.divmod(key, max(1, len(used)))
        sizes = v.facts[4, used]
        codes, links = v.pairs[:, expand((np.cumsum(v.facts[4]) - v.facts[4])[used], sizes)]
        pairs, which = np.unique(codes, return_inverse=True)
        held = which[expand((np.cumsum(sizes) - sizes)[item], sizes[item])] + np.repeat(doc, sizes[item]) * max(1, len(pairs))
        docs = np.bincount(distinct(held) % max(1, len(pairs)), minlength=len(pairs))
        return totals, np.searchsorted(doc, np.arange(n + 1)), item, times, sizes, which, links, pairs, docs


@lru_cache(1)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


_INTS = "items array<int>, times array<int>, sizes array<int>, which array<int>, links array<int>, pairs array<long>, docs array<int>"


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents, a row each, and a row for each block behind its documents, whose doc_id and n_a are null."""
    kind = docs.schema[id_col].dataType.simpleString()

    def over(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        v, task = vocabularies(path_a, path_b), TaskContext.get().partitionId()
        ids_type, done, block = None, 0, Block(v)

        def flush():
            totals, at, item, times, *own = block.columns()
            n = len(block.ids)
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[at, at[-1]], pa.int32()), pa.array(x, pa.int32())) for x in (item, times)]
            one = [pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(x)], pa.int32()), pa.array(x, pa.int64() if k == 3 else pa.int32())) for k, x in enumerate(own)]
            longs = [pa.array([*t.tolist(), None], pa.int64()) for t in totals]
            name = pa.array([(task << 33) + done] * (n + 1), pa.int64())
            yield pa.RecordBatch.from_arrays([name, pa.array([*block.ids, None], ids_type), *longs, pa.array([*block.digests, None], pa.string()), *lists, *one], names)

        for batch in slices(batches, 1):
            ids_type = batch.schema.field(0).type
            block.add(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            if block.size >= BLOCK or len(v.strings) > KEEP:
                yield from flush()
                done, block = done + 1, Block(v)
                if len(v.strings) > KEEP:
                    v.reset()
        if block.ids:
            yield from flush()
        if len(v.strings) > KEEP:
            v.reset()

    schema = f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {_INTS}"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(over, schema)


def pair_counts(held: DataFrame, n_b: int) -> DataFrame:
    """held: block, pair, docs. Per pair: count, and whether no pair of the same token of A has a higher one."""
    salted = held.groupBy("pair", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("docs").alias("count"))
    counts = salted.groupBy("pair").agg(F.sum("count").alias("count"))
    same_a = Window.partitionBy(F.floor(F.col("pair") / n_b))  # as many rows as B has tokens at most
    return counts.withColumn("best", F.col("count") == F.max("count").over(same_a))


def summed(key, rows, counts):
    """A block's documents with n_best and count_sum."""
    import pyarrow as pa
    import pyarrow.compute as pc

    last = pc.is_null(rows.column("n_a"))
    own, docs = rows.filter(last), rows.filter(pc.invert(last))
    sizes, which, links, pairs = (np.asarray(own.column(c).combine_chunks().flatten()) for c in ("sizes", "which", "links", "pairs"))
    at = np.searchsorted(pairs, np.asarray(counts.column("pair")))
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    count[at], best[at] = np.asarray(counts.column("count")), np.asarray(counts.column("best"))
    ends = np.r_[0, np.cumsum(sizes)]
    items = docs.column("items").combine_chunks()
    item, times, at = np.asarray(items.flatten()), np.asarray(docs.column("times").combine_chunks().flatten()), np.r_[0, np.cumsum(np.asarray(pc.list_value_length(items)))]

    def total(of_pair: np.ndarray) -> pa.Array:
        upto = np.r_[0, np.cumsum(of_pair[which] * links)]
        of_item = upto[ends[1:]] - upto[ends[:-1]]
        upto = np.r_[0, np.cumsum(of_item[item] * times)]
        return pa.array(upto[at[1:]] - upto[at[:-1]], pa.int64())

    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", total(best)).append_column("count_sum", total(count)).append_column("groups_sha256", docs.column("groups_sha256"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    ship(docs.sparkSession)
    kind, n_b = docs.schema[id_col].dataType.simpleString(), sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    blocks = stash(aligned(docs, path_a, path_b, id_col, text_col), "aligned")
    held = blocks.filter("n_a is null").select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("of")).select("block", F.col("of.pairs").alias("pair"), F.col("of.docs").alias("docs"))
    asked = held.select(F.col("block").alias("asking"), "pair").join(pair_counts(held, n_b), "pair")
    rows = blocks.drop("docs")
    return rows.groupBy("block").cogroup(asked.groupBy("asking")).applyInArrow(
        summed, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


def op13_align_tokens(spark, sf_dir: str) -> DataFrame:
    return alignment(read(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))
