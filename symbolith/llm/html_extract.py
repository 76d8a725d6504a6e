"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Features of a block are the tags and the words of class, id and role of its ancestors, and the length, links and
signs of its text; the chain adds how labels follow one another. Weights are fitted on labelled pages by the gradient of the
regularised likelihood (forward and backward sums), once for each driver process, from TRAIN_PAGES pages of a fixed seed;
Viterbi's algorithm decodes a page. The weights, some thousand numbers, go to the executors with the task.

Cases: a null or empty page, and one without text, give an empty text; a page cut off anywhere is read as far as it goes;
equal rows give equal results; an empty table gives an empty result; other columns don't matter. Nothing is cut or dropped
from a block that counts as main text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_training
from .common import by_rows, ship
from .html_blocks import Block, Node, blocks, names

TRAIN_PAGES, SEED, STEPS, RATE, PENALTY = 800, 23, 300, 0.1, 0.2
_FURNITURE = re.compile(r"©|\b(?:cookies?|copyright|subscribe|newsletter|log ?in|sign ?up|share|comments?|advertisement|privacy)\b", re.I)


#: Elements that part a page.
_SECTIONS = frozenset("article main aside nav header footer form section div figure".split())


def own_features(node: Node | None, near: Node | None) -> list[str]:
    """What the innermost element around a block, and the innermost section around it, say."""
    tag = node.tag if node and node.tag not in ("html", "body") else "body"
    return sorted({f"tag:{tag}", f"near:{near.tag if near else 'body'}", *(f"near:{w}" for w in (names(near.attributes) if near else ()))})


def path_features(node: Node | None) -> list[str]:
    """What a block's ancestors say, whatever its text."""
    near = next((n for n in node.up() if n.tag in _SECTIONS), None) if node else None
    return sorted({*own_features(node, near), *(f for n in (node.up() if node else ()) for f in n.new)})


def text_features(block: Block) -> list[str]:
    n, share = len(block.text), block.linked / max(1, block.raw)
    out = [f"length:{min(6, n.bit_length() // 2)}", f"links:{0 if share == 0 else 1 if share < 0.4 else 2 if share < 0.9 else 3}"]
    if block.text[-1] in ".!?…。！？\"'»”":
        out.append("ends")
    if hits := len(_FURNITURE.findall(block.text)):
        out.append("furniture" if 30 * hits > block.text.count(" ") else "furniture seldom")
    return out


def edge_features(i: int, n: int) -> list[str]:
    return ["first"] * (i == 0) + ["last"] * (i == n - 1)


class Field:
    """Weights: a score for main text per feature, and for each pair of labels in a row. Label 0 scores 0."""

    def __init__(self, weights: dict[str, float], step: np.ndarray):
        self.weights, self.step = weights, step

    def __reduce__(self):
        return Field, (self.weights, self.step)

    def of_path(self, node: Node | None) -> float:
        """The score of path_features; an element adds to its parent's what is new in it."""
        todo = []
        for n in node.up() if node else ():
            todo.append(n)
            if n.value and n.value[0] is self.weights:
                break
        above, near = 0.0, None
        for n in reversed(todo):
            if not (n.value and n.value[0] is self.weights):
                new = above + sum(self.weights.get(f, 0.0) for f in n.new)
                n.value = self.weights, new, n if n.tag in _SECTIONS else near
            _, above, near = n.value
        return above + sum(self.weights.get(f, 0.0) for f in own_features(node, near))

    def score(self, block: Block, i: int, n: int) -> float:
        return self.of_path(block.node) + self.weights["bias"] + sum(self.weights.get(f, 0.0) for f in text_features(block)) + sum(self.weights.get(f, 0.0) for f in edge_features(i, n))

    def labels(self, found: list[Block]) -> list[int]:
        """The best sequence of labels; of equal ones that with 0 as late as possible."""
        (a00, a01), (a10, a11) = self.step.tolist()
        no, yes, back = 0.0, 0.0, []
        for i, block in enumerate(found):
            s = self.score(block, i, len(found))
            if i:
                back.append((int(yes + a10 > no + a00), int(yes + a11 >= no + a01)))
                no, yes = max(no + a00, yes + a10), max(no + a01, yes + a11) + s
            else:
                yes = s
        out = [int(yes > no)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1] if found else []

    def extract(self, page: str | None) -> str:
        found = blocks(page) if page else []
        return " ".join(b.text for b, y in zip(found, self.labels(found), strict=True) if y)


def fit(pages: list[tuple[str, list[int]]]) -> Field:
    """Weights for labelled pages: (html, label of each block)."""
    index: dict[str, int] = {}
    at: list[list[int]] = []
    truth, length = [], []
    for page, label in pages:
        found = blocks(page)
        if len(found) != len(label):
            raise ValueError("a page needs one label for each block")
        length.append(len(found))
        truth += label
        for i, b in enumerate(found):
            features = {"bias", *path_features(b.node), *text_features(b), *edge_features(i, len(found))}
            at.append([index.setdefault(f, len(index)) for f in sorted(features)])
    rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
    cols = np.array([c for a in at for c in a])
    y, n, longest = np.array(truth), np.array(length), max(length)
    place = np.full((len(n), longest), -1)  # the block at each place of each page
    starts = np.cumsum(n) - n
    for k in range(longest):
        place[n > k, k] = (starts + k)[n > k]
    w, step = np.zeros(len(index)), np.zeros((2, 2))
    moments = [np.zeros(len(index)), np.zeros(len(index)), np.zeros((2, 2)), np.zeros((2, 2))]
    seen = np.zeros((2, 2))
    for k in range(1, longest):
        ok = n > k
        np.add.at(seen, (y[place[ok, k - 1]], y[place[ok, k]]), 1)
    for t in range(1, STEPS + 1):
        s = np.bincount(rows, w[cols], len(at))
        ahead = np.full((longest, len(n), 2), -np.inf)
        emit = np.zeros((longest, len(n), 2))
        for k in range(longest):
            emit[k, n > k, 1] = s[place[n > k, k]]
            ahead[k] = emit[k] if k == 0 else np.logaddexp(ahead[k - 1][:, :1] + step[0], ahead[k - 1][:, 1:] + step[1]) + emit[k]
        behind = np.zeros((longest, len(n), 2))
        for k in range(longest - 2, -1, -1):
            nxt = behind[k + 1] + emit[k + 1]
            behind[k] = np.where((n > k + 1)[:, None], np.logaddexp(step[:, 0] + nxt[:, :1], step[:, 1] + nxt[:, 1:]), 0)
        total = np.logaddexp(*(ahead[n - 1, np.arange(len(n))].T))
        p = np.zeros(len(at))
        grad_step = seen.copy()
        for k in range(longest):
            ok = n > k
            p[place[ok, k]] = np.exp(ahead[k, ok, 1] + behind[k, ok, 1] - total[ok])
            if k:
                joint = ahead[k - 1, ok][:, :, None] + step + (emit[k, ok] + behind[k, ok])[:, None, :] - total[ok][:, None, None]
                grad_step -= np.exp(joint).sum(0)
        grad = np.bincount(cols, (y - p)[rows], len(index)) - PENALTY * w
        for x, g, m, v in ((w, grad, *moments[:2]), (step, grad_step - PENALTY * step, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field({f: float(w[i]) for f, i in index.items()}, step)


@lru_cache(1)
def field() -> Field:
    return fit(html_training.pages(TRAIN_PAGES, SEED))


def extract(pages: DataFrame, model: Field | None = None, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars (code points) as last columns, in place of columns of these names."""
    ship(pages.sparkSession)
    model = model or field()
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def rows(batch):
        import pyarrow as pa

        texts = [model.extract(x) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*rest, "text", "n_chars"])

    picked = pages.select(html_col, *rest)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(by_rows(rows, at=0), f"{kinds}{', ' if kinds else ''}text string, n_chars long")


def op7_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


