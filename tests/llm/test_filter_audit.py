"""The filter audit against a walk through every order, on documents and labels with nulls, repeats and clashing columns."""

import re
from collections import Counter
from itertools import permutations

import pandas as pd
import pytest

from symbolith.llm import filter_audit

WORDS = " ".join(f"w{k}" for k in range(250))
TEXTS = [
    (1, WORDS, "s"), (2, WORDS, "s"), (9, WORDS, "t"), (3, None, "s"), (4, "", None), (5, " \t\n", "s"), (6, "AB " * 300, "t"), (7, "A # b", "t"), (8, WORDS.upper() + " |", "t"),
    (None, WORDS, "s"), (None, "no id", None), (None, "no id", None), (11, "twice", "s"), (11, "twice", "s"), (12, "twice", "s"), (13, "a b " * 150, ""), (14, "é" * 70 + "AB", "s"), (15, "x " * 99999 + "Z" * 9, "t"),
]
LABELS = [(1, 1, 0), (2, 1, None), (2, 0, 1), (3, None, 1), (6, 1, 1), (9, 1, 0), (11, 1, 1), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(*r, "m", 1, 2) for r in TEXTS], "doc_id long, text string, source string, mask string, n long, good int").repartition(4)
    labels = spark.createDataFrame([(*r, 0) for r in LABELS], "doc_id long, quality int, toxic int, n int")
    return filter_audit.audit(filter_audit.masks(docs, labels)).toPandas()


def test_audit_is_what_every_order_does(found):
    rows = []
    for i, text, source in TEXTS:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in TEXTS)
        fails = {f for f, x in zip("ABCDE", [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), copy], strict=True) if x}
        good, toxic = (i is not None and any(x[0] == i and x[k] == 1 for x in LABELS) for k in (1, 2))
        rows.append((source or "", fails, good, toxic))
    want, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                fails = sum(f in r[1] for r in own)
                want[part, order, k + 1] = [len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] += len(gone)
    assert {len(r[1]) for r in rows} >= {0, 1, 2, 3}
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in found.itertuples()}
    assert got == want and len(found) == len(want)
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in found.itertuples())


def test_shapley_values_share_what_all_filters_remove(found):
    for _, own in found.groupby("part"):
        last = own[own.step == 5]
        assert last.kept.nunique() == 1
        values = own[own.filter_order == "ABCDE"]
        assert values.shapley.sum() == 120 * values.removed.sum()


def test_audit_of_other_filters(spark):
    """The transform holds for any number of filters."""
    counts = {0: 5, 1: 3, 2: 2, 3: 7, 4: 1, 6: 4}
    masked = spark.createDataFrame([("p", m, n, n // 2, 0) for m, n in counts.items()], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): r for r in filter_audit.audit(masked, "xyz").collect()}
    assert len(got) == 18
    for (order, step), r in got.items():
        gone = {1 << "xyz".index(f) for f in order[:step]}
        before = {1 << "xyz".index(f) for f in order[: step - 1]}
        live = lambda s: sum(n for m, n in counts.items() if not any(m & b for b in s))
        assert (r.kept, r.removed) == (live(gone), live(before) - live(gone))


def test_survivors_of_one_source_with_a_third_of_all_rows(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('t', id)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 50)) as source")
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": [0, 3], "quality": [1, 1], "toxic": [0, 1]}))
    hot = filter_audit.audit(filter_audit.masks(docs, labels)).filter("part = 'hot' and filter_order = 'EABCD' and step = 1").first()
    assert (hot.kept, hot.removed, hot.good_lost, hot.toxic_lost) == (1, 999, 1, 1)
