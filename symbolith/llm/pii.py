"""Personal data: regular expressions propose spans, checksum validators confirm them, words nearby move the score.

Base kinds are reported whenever their pattern and check hold: email, ip (parts up to 255), card (Luhn), phone (9
to 15 digits). Further kinds are reported from a score of THRESHOLD on: iban (mod 97), tel (a national number that
only a word nearby, such as "call", makes a telephone number). Every span has a score: a start for its kind, more
when a checksum confirms it, more or less for words within NEAR characters before and behind it.

Searches are linear in the text: patterns are possessive, and an address is found from its @ sign outwards.

Cases: a null text counts as empty and has no spans; equal rows get equal spans; an empty table gives an empty
result; other columns don't matter. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_rows, ship

KINDS = ("email", "ip", "card", "phone", "iban", "tel")
BASE = KINDS[:4]
NEAR, THRESHOLD = 40, 0.5

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_TEL = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20-][0-9]{3,4}[\x20-][0-9]{3,4}(?![0-9-])")
_DIGITS = re.compile(r"[^0-9]")

#: Score of a kind by itself, what a checksum adds, words nearby that raise and that lower it.
SCORES = {
    "email": (0.9, 0.0, "mail email contact write", ""),
    "ip": (0.6, 0.0, "ip address host server login", "version release section"),
    "card": (0.4, 0.4, "card visa credit payment pay karte carte tarjeta", "order isbn serial"),
    "phone": (0.7, 0.0, "call tel phone mobile fax telefon appel", ""),
    "iban": (0.2, 0.5, "iban bank account konto compte cuenta", "serial"),
    "tel": (0.3, 0.0, "call tel phone mobile fax telefon appel", "isbn order serial"),
}
_NEARBY = {k: tuple(re.compile(r"\b(?:" + "|".join(w.split()) + r")\b", re.I) if w else None for w in v[2:]) for k, v in SCORES.items()}


def luhn(digits: str) -> bool:
    """The Luhn check: every second digit from the right counts double, less 9 if above 9."""
    own, other = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, own)) + sum(sum(divmod(2 * int(c), 10)) for c in other)) % 10 == 0


def mod97(code: str) -> bool:
    """The check of ISO 13616: the first four characters moved behind, letters as 10 to 35, leave 1 modulo 97."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _proposed(text: str):
    """Kind, start, end, and whether a checksum confirms it, of spans whose check doesn't fail."""
    for start, end in _emails(text):
        yield "email", start, end, False
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield "ip", *m.span(), False
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            yield "card", *m.span(), True
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            yield "phone", *m.span(), False
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", *m.span(), True
    for m in _TEL.finditer(text):
        yield "tel", *m.span(), False


def _score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    score, checked, *_ = SCORES[kind]
    score += checked * confirmed
    near = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    more, less = (bool(words and any(map(words.search, near))) for words in _NEARBY[kind])
    return max(0.0, min(1.0, score + 0.3 * more - 0.3 * less))


def detect(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind in the order of KINDS, then start."""
    if not text or not _ANY.search(text):
        return []
    found, taken, free = [], [], None
    for kind, start, end, confirmed in _proposed(text):  # the base kinds come first
        score = _score(text, kind, start, end, confirmed)
        if kind in BASE:
            taken.append((start, end))
        else:
            free = free or _Free(taken)
            if score < THRESHOLD or not free(start, end):
                continue
        found.append((kind, start, end, score))
    return found


class _Free:
    """Whether a span meets none of the given ones, which are joined where they overlap."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def __call__(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at == len(self.starts) or self.starts[at] >= end


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, text and spans (kind, start, end, score)."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind:string,start:long,end:long,score:double>>"

    def rows(batch):
        import pyarrow as pa

        to = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in detect(x)] for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, to)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(by_rows(rows), f"doc_id {kind}, spans {span}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs whose texts have <KIND> in place of each span; of overlapping spans the one that starts first counts."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def masked(text: str | None) -> str | None:
        out, done = [], 0
        for kind, start, end, _ in sorted(detect(text), key=lambda s: (s[1], -s[2])):
            if start >= done:
                out += [text[done:start], f"<{kind.upper()}>"]
                done = end
        return "".join([*out, text[done:]]) if out else text

    def rows(batch):
        import pyarrow as pa

        yield batch.set_column(at, batch.schema.field(at), pa.array([masked(x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(by_rows(rows, at=at), docs.schema)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.array_join(F.filter(names, lambda s: F.substring_index(s, ":", 1).isin(*BASE)), ",")
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE),
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(names, ",").alias("spans"),
    )


