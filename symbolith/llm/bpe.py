"""Byte-level BPE encoding and decoding with a pair occurrence index.

A text is cut into pieces by the vocabulary's pattern. The distinct new pieces of a partition's batch are laid
out as one array of symbols with links to both neighbours, and an index maps each pair that can merge to all
positions where it stands. Active ranks are taken in ascending order from a heap; a rank's merge is applied at all
its positions at once, neighbours are relinked and the new pairs go to the lists of their ranks, which are always
higher, since a token is made by one rank only. Within a piece that is the order in which the pairs would merge
one by one. Encoded pieces are kept for later batches, KEEP of them at most, then all are dropped and it starts anew:
that bounds memory and changes no result.

The vocabulary is a tokenizers JSON file of a byte-level BPE model without normaliser; its path is a parameter.
It is read on the executors. Nothing is trained.

Cases: a null text counts as empty and has no tokens; strings of added tokens in a text become those tokens, as in
the tokenizers library; text that isn't in any merge falls to single bytes; equal rows give equal results; an empty
table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_rows, ship

KEEP = 400_000
#: The white space of Unicode, as the pattern below means it. Fixed values.
_S = r"\t-\r\x20\x85\xa0  -     　"
#: The pattern of byte-level vocabularies. Fixed value.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_signs() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: printable Latin-1 for itself, the
    other bytes, in order, for the characters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class PairIndexBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        signs = byte_signs()
        byte_of = {c: b for b, c in enumerate(signs)}
        self.byte_ids = np.array([vocab[c] for c in signs], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.rank_order = np.argsort(keys)
        self.keys = keys[self.rank_order]
        self.pair = np.stack([keys // self.size, keys % self.size])  # by rank
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for pairs that never merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_order[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The token ids of each piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbol = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(symbol)
        ends = np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(positions: np.ndarray) -> None:
            rank = self.ranks(symbol[positions], symbol[after[positions]])
            positions, rank = positions[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            positions, rank = positions[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, where in zip(rank[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True):
                if r in index:
                    index[r].append(where)
                else:
                    index[r] = [where]
                    heapq.heappush(heap, r)

        add(np.flatnonzero(after >= 0))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            a, b = self.pair[:, r]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            right = after[at]
            at = at[(symbol[at] == a) & (right >= 0) & (symbol[right] == b)]
            if not len(at):
                continue
            if a == b:  # of overlapping places the first, third, and so on
                new = np.r_[True, after[at[:-1]] != at[1:]]
                first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            right = after[at]
            beyond = after[right]
            symbol[at], symbol[right], after[at] = self.made[r], -1, beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            left = before[at]
            add(np.unique(np.concatenate([left[left >= 0], at[after[at] >= 0]])))

        alive = symbol >= 0
        counts = np.zeros(n + 1, np.int64)
        np.cumsum(alive, out=counts[1:])
        return np.split(symbol[alive], counts[ends][:-1]) if len(pieces) else []

    def learn(self, pieces) -> None:
        """Encode the pieces that aren't known yet."""
        new = sorted(p for p in pieces if p not in self.known)
        if len(self.known) + len(new) > KEEP:
            self.known = {p: self.known[p] for p in pieces if p in self.known}  # what this batch needs
        for piece, ids in zip(new, self.encode_pieces([p.encode() for p in new]), strict=True):
            ids = ids.tolist()
            self.known[piece] = ",".join(map(str, ids)), len(ids), self.decode_bytes(ids)

    def parts(self, text: str):
        """Pieces, and added tokens as their ids."""
        if not self.split_added:
            return PIECE.findall(text)
        out, done = [], 0
        for m in self.split_added.finditer(text):
            out += PIECE.findall(text[done : m.start()])
            out.append(self.added[m[0]])
            done = m.end()
        return out + PIECE.findall(text[done:]) if done else PIECE.findall(text)

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        """Bytes that aren't UTF-8 become the replacement character."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def encode_batch(self, texts: list[str | None]):
        """Per text: its ids as decimals joined by commas, their number, and the decoded text."""
        parts = [self.parts(x or "") for x in texts]
        self.learn({p for ps in parts for p in ps if isinstance(p, str)})
        for i in self.added.values():
            self.known[i] = str(i), 1, self.token_bytes[i]
        known = self.known
        for ps in parts:
            found = [known[p] for p in ps]
            yield ",".join([f[0] for f in found]), sum([f[1] for f in found]), b"".join([f[2] for f in found]).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        ids = next(self.encode_batch([text]))[0]
        return [int(i) for i in ids.split(",")] if ids else []


@lru_cache(1)
def model(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def encoded(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with the token ids of each text as a last column, an array of integers."""
    ship(docs.sparkSession)
    plain = docs.drop(ids_col) if ids_col in docs.columns else docs
    at = plain.columns.index(text_col)

    def rows(batch):
        import pyarrow as pa

        ids = [list(map(int, t[0].split(","))) if t[0] else [] for t in model(path).encode_batch(batch.column(at).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, ids_col])

    return plain.mapInArrow(by_rows(rows, at=at), T.StructType([*plain.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of its ids and of the text that they decode to."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch):
        import pyarrow as pa

        n, ids, text = [], [], []
        for joined, count, decoded in model(path).encode_batch(batch.column(1).to_pylist()):
            n.append(count)
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            text.append(hashlib.sha256(decoded.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(
        by_rows(rows), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
