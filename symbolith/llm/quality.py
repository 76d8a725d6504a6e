"""Quality rules as a short-circuit cascade.

Each rule looks at one document and rejects it or not. On a sample every rule runs on every document; its mean
time is its cost, the share it rejects its selectivity. The cascade asks rules in the order of rejections per
second, and stops at the first that rejects. The verdict is that of all rules together, so the order, which
depends on measured time, decides only how fast it is found.

The sample is the first SAMPLE rows whose text has at most SAMPLE_CHARS characters; the driver holds no more. It may
come from one file: it decides only the order, which is no matter for results. All rules read the whole text of every
document that reaches them. Reports hold the base counts of every document, which the rules among them then use.

Cases: a null or empty text has no words and is rejected for that; n_words 0 makes every ratio rule pass; equal
rows get equal verdicts; an empty table gives an empty result; other columns don't matter and the filter keeps them.
"""

from __future__ import annotations

import re
import time
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_rows, ship, slices

SAMPLE, SAMPLE_CHARS = 400, 100_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")

_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of each code point 1 for a letter and 2 more for an upper-case letter, 4 for ASCII white space."""
    if not _kinds:
        category = unicodedata.category
        table = np.fromiter(({"Lu": 3}.get(k, k[0] == "L") for k in map(category, map(chr, range(0x110000)))), np.uint8, 0x110000)
        table[[ord(c) for c in SPACES]] = 4
        _kinds.append(table)
    return _kinds[0]


class Document:
    """A text whose features are computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        value = getattr(self, "_" + name)()
        setattr(self, name, value)
        return value

    def _words(self) -> list[bytes]:
        return self.text.encode().split()

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _HAS_WORD.search(x)]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        if self.n_words < 4:
            return 0
        ids: dict[bytes, int] = {}
        w = np.fromiter([ids.setdefault(x, len(ids)) for x in self.words], np.int64, self.n_words)
        window, n = w[:-2] * len(ids) + w[1:-1], len(ids)
        if n > 2_000_000:  # else the product of three could pass 64 bits
            window = np.unique(window, return_inverse=True)[1]
        window = window * n + w[2:]
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        often = np.zeros(len(window), bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        covered = np.zeros(self.n_words, bool)
        for k in range(3):
            covered[k : len(window) + k] |= often
        return int(covered.sum())

    def _kind(self) -> np.ndarray:
        return kinds()[np.frombuffer(self.text.encode("utf-32-le"), np.uint32)]

    def _n_letters(self) -> int:
        return int(np.count_nonzero(self.kind & 1))

    def _n_upper(self) -> int:
        return int(np.count_nonzero(self.kind & 2))

    def _n_letter_words(self) -> int:
        if not self.text:
            return 0
        word = np.cumsum(self.kind == 4)  # the number of white space before: one value for each word
        letters = word[(self.kind & 1) > 0]
        return int(len(letters) and 1 + np.count_nonzero(letters[1:] != letters[:-1]))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Name and the condition under which a rule rejects, in whole numbers.
RULES = {
    "few_words": lambda d: d.n_words < MIN_WORDS,
    "repeated_words": lambda d: 100 * d.n_repeat_words > MAX_REPEAT_PERCENT * d.n_words,
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "word_length": lambda d: d.n_words > 0 and not 3 * d.n_words <= d.word_chars <= 10 * d.n_words,
    "repeated_lines": lambda d: 10 * d.n_dup_lines > 4 * len(d.lines),
    "upper_case": lambda d: 10 * d.n_upper > 4 * d.n_letters,
    "words_without_letters": lambda d: 10 * d.n_letter_words < 8 * d.n_words,
}


def measure(texts: list[str | None]) -> dict[str, tuple[float, float]]:
    """Of each rule the seconds and the share of rejections, on documents whose features nobody has computed."""
    found = {}
    kinds()
    for name, rule in RULES.items():
        began, hits = time.perf_counter(), 0
        for text in texts:
            hits += bool(rule(Document(text)))
        found[name] = ((time.perf_counter() - began) / max(1, len(texts)), hits / max(1, len(texts)))
    return found


def cascade(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The names of the rules by rejections per second on a sample of docs."""
    small = docs.filter(F.coalesce(F.length(text_col), F.lit(0)) <= SAMPLE_CHARS).select(F.col(text_col).alias("text"))
    found = measure([r.text for r in small.take(SAMPLE)])
    return sorted(RULES, key=lambda name: -found[name][1] / max(found[name][0], 1e-9))


def verdict(document: Document, order: list[str]) -> bool:
    """True if no rule rejects; later rules aren't asked once one does."""
    return not any(RULES[name](document) for name in order)


def reports(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its base counts, base_failed and kept."""
    ship(docs.sparkSession)
    order = cascade(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def report(text):
        d = Document(text)
        base = RULES["few_words"](d) or RULES["repeated_words"](d)
        return *(getattr(d, k) for k in COUNTS), base, verdict(d, order)

    def over(batches):
        import pyarrow as pa

        types, names = [pa.int64()] * len(COUNTS) + [pa.bool_()] * 2, ["doc_id", *COUNTS, "base_failed", "kept"]
        for batch in slices(batches, 1):
            found = [report(x) for x in batch.column(1).to_pylist()]  # one document's words are held at a time
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))], names)

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(
        over, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean"
    )


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs that no rule rejects, with all columns; rules after the first that rejects aren't computed."""
    ship(docs.sparkSession)
    order, at = cascade(docs, text_col), docs.columns.index(text_col)

    def rows(batch):
        import pyarrow as pa

        keep = [verdict(Document(x), order) for x in batch.column(at).to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(by_rows(rows, at=at), docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return reports(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
r AS (
  SELECT k, count(DISTINCT p) AS n FROM (
    SELECT k, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1)
  GROUP BY k),
c AS (
  SELECT d.doc_id, len(w) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words
  FROM d LEFT JOIN r ON r.k = d.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_dup_lines > 4 * n_lines
            OR 10 * n_upper > 4 * n_letters OR 10 * n_letter_words < 8 * n_words) AS kept
FROM c
"""
