"""Language identification by hyperdimensional profiles.

Each letter has a random vector of DIM signs, drawn from its code point. A run of three characters is bound into
one vector: the letters' vectors, rotated by two, one and no places, are multiplied. A document bundles its runs
(white space, digits and signs count as one space between words) into the sum of their vectors; a language's
prototype bundles the documents of that language, each scaled to length one and rounded to whole numbers, so that
sums don't depend on the order of tasks. A document gets the language with the highest cosine, the first by code
point on a tie, and that cosine, cut to 0 to 1, as its score.

Prototypes come from all labelled rows that aren't held out; what reaches the driver is DIM numbers per language.
The same vectors would arise on any machine. Memory: one batch of about a million characters at a time, and
CACHE_ROWS run vectors of one byte per place.

Cases: a null text or one without letters is `und` with score 0; a null language isn't learned from; a language
named by one row only is a language; without any labelled row every text is `und`; a null id counts as the empty
text for the split; equal rows get equal results; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_rows, ship

DIM, RUN, SEED, SCALE, CACHE_ROWS, BATCH_CHARS, UNKNOWN = 1024, 3, 11, 1 << 20, 60_000, 1_000_000, "und"


class Profiles:
    """Text vectors. One object serves a Python worker for all its tasks."""

    def __init__(self) -> None:
        every = (chr(c) for c in range(0x110000))
        self.letter = np.fromiter((ord(low) if ch.isalpha() and len(low := ch.lower()) == 1 else ch.isalpha() and ord(ch) for ch in every), np.uint32, 0x110000)
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.runs = np.empty((CACHE_ROWS, DIM), np.int8)

    def letter_vector(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= CACHE_ROWS:
                self.letters.clear()
            self.letters[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIM, np.int8) * 2 - 1
        return self.letters[code]

    def run_rows(self, runs: list[int]) -> np.ndarray:
        """Rows of self.runs that hold the vectors of these runs (at most CACHE_ROWS, each once)."""
        if len(self.rows) + len(runs) > CACHE_ROWS:
            self.clear()
        for run in runs:
            if run not in self.rows:
                a, b, c = run >> 42, (run >> 21) & 0x1FFFFF, run & 0x1FFFFF
                self.runs[len(self.rows)] = np.roll(self.letter_vector(a), 2) * np.roll(self.letter_vector(b), 1) * self.letter_vector(c)
                self.rows[run] = len(self.rows)
        return np.fromiter(map(self.rows.__getitem__, runs), np.int64, len(runs))

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The bundled vector of each text, and whether it has a letter."""
        texts = [x or "" for x in texts]
        out = np.zeros((len(texts), DIM), np.float32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        code = self.letter[np.frombuffer("".join(f" {x} " for x in texts).encode("utf-32-le"), np.uint32)]
        text = np.repeat(np.arange(len(texts)), lengths)
        first = np.r_[0, np.cumsum(lengths)[:-1]]
        keep = code > 0
        keep[1:] |= code[:-1] > 0  # of a run of spaces the first
        keep[first] = True
        code, text = code[keep].astype(np.int64), text[keep]
        seen = np.zeros(len(texts), bool)
        seen[text[code > 0]] = True
        if not seen.any():
            return out, seen
        whole = (text[2:] == text[:-2]) & ((code[1:-1] > 0) | (code[:-2] > 0) | (code[2:] > 0))
        text = text[:-2][whole]
        alphabet = np.flatnonzero(np.bincount(code))
        dense = np.zeros(alphabet[-1] + 1, np.int64)
        dense[alphabet] = np.arange(len(alphabet))
        k, code = len(alphabet), dense[code]
        run = ((code[:-2] * k + code[1:-1]) * k + code[2:])[whole]
        if k**3 <= 1 << 22:
            runs = np.flatnonzero(np.bincount(run, minlength=k**3))
            place = np.zeros(k**3, np.int64)
            place[runs] = np.arange(len(runs))
            run = place[run]
        else:
            runs, run = np.unique(run, return_inverse=True)
        names = (alphabet[runs // (k * k)] << 42) | (alphabet[runs // k % k] << 21) | alphabet[runs % k]
        for start in range(0, len(runs), 4096):  # so many runs at a time bound the matrices
            n = min(4096, len(runs) - start)
            here = (run >= start) & (run < start + n)
            counts = np.bincount(text[here] * n + run[here] - start, minlength=len(texts) * n).reshape(len(texts), n)
            out += counts.astype(np.float32) @ self.runs[self.run_rows(names[start : start + n].tolist())].astype(np.float32)
        return out, seen


_profiles: list[Profiles] = []


def profiles() -> Profiles:
    if not _profiles:
        _profiles.append(Profiles())
    return _profiles[0]


def _blocks(texts: list) -> list[slice]:
    """Slices of at most 256 texts; by_rows bounds their characters."""
    return [slice(i, i + 256) for i in range(0, len(texts), 256)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A prototype of length one for each language of the rows of labelled."""
    ship(labelled.sparkSession)

    def over(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}

        def rows(batch):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _blocks(texts):
                units = np.rint(_unit(profiles().vectors(texts[part])[0]) * SCALE).astype(np.int64)
                names = np.array(langs[part], object)
                for lang in set(names):
                    total[lang] = total.get(lang, 0) + units[names == lang].sum(0)
            return ()

        for _ in by_rows(rows, BATCH_CHARS)(batches):
            pass
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["lang", "sums"])

    parts = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_col).mapInArrow(over, "lang string, sums array<long>")
    sums = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("n"))
    out: dict[str, np.ndarray] = {}
    for lang, pos, n in sums.collect():  # DIM rows for each language
        out.setdefault(lang, np.zeros(DIM))[pos] = n
    return {lang: out[lang] / max(np.linalg.norm(out[lang]), 1e-9) for lang in sorted(out)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names, matrix = list(prototypes), np.array(list(prototypes.values()), np.float32).reshape(-1, DIM)

    def rows(batch):
        import pyarrow as pa

        langs, scores, texts = [], [], batch.column(1).to_pylist()
        for part in _blocks(texts):
            vectors, seen = profiles().vectors(texts[part])
            cosine = (_unit(vectors) @ matrix.T).astype(np.float64)
            best = cosine.argmax(1) if names else None
            for i, known in enumerate(seen & bool(names)):
                langs.append(names[best[i]] if known else UNKNOWN)
                scores.append(min(1.0, max(0.0, float(cosine[i, best[i]]))) if known else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(by_rows(rows, BATCH_CHARS), f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
