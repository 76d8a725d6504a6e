"""Names by number, lowered hints, inference by file and project, layouts of data sets."""

import ast
import glob
import os

import pytest

from symbolith.operators import predict, renaming
from symbolith.sources import scans

#: A hint over a try with two handlers, of which one has a hint of its own, and a loop.
HINTED = "size: float\ntry:\n    size = load()\nexcept KeyError:\n    size: str\n    size = '?'\nexcept OSError:\n    size = 0\nfor row, size in table:\n    size -= 1\n"


def test_numbered_names():
    code = "import math\nclass Shop:\n    open: bool = True\n    def sell(self, item, *, price=1):\n        tax = price / 5; price += tax\n        with till() as (drawer, key):\n            self.sold: list\n            self.sold = [item, drawer]\n        label = key\n        for tax in ():\n            del tax\nopen = math.pi\nopen: float\n"
    want = "import math\nclass Shop:\n    openλ1: bool = True\n    def sell(self, item, *, price=1):\n        taxλ1 = price / 5; priceλ1 += tax\n        with till() as (drawerλ1, keyλ1):\n            self.soldλ1: list\n            self.soldλ1 = [item, drawer]\n        labelλ1 = key\n        for taxλ2 in ():\n            del tax\nopenλ1 = math.pi\nopen: float\n"
    assert renaming.numbered(code) == want
    assert renaming.plain(want) == code
    with pytest.raises(ValueError):
        renaming.numbered("class A:\n    bλ2 = 3")


def test_lowered_hints():
    marked = renaming.lowered(HINTED)
    assert f"    size: float = {renaming.MARKER}; size = load()\n" in marked and f"    size: str = {renaming.MARKER}; size -= 1" in marked  # a handler's hint stays in force
    assert renaming.unlowered(renaming.plain(renaming.numbered(marked))) == HINTED
    own = "def f():\n    rate: int = 1\n    while rate:\n        rate: int = 2\n        rate = 3\n"
    assert renaming.lowered(own) == own
    assert renaming.unlowered(f"while t:\n    key: int = {renaming.MARKER}\nend = 1\n") == "while t:\n    pass\nend = 1\n"


def test_round_trips_of_real_sources():
    for path in sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py")))[:60]:
        with open(path, encoding="utf-8", newline="") as f:
            code = f.read()
        marked = renaming.lowered(code)
        ast.parse(marked)
        assert renaming.unlowered(renaming.plain(renaming.numbered(marked))) == code


def test_inference(spark):
    code = spark.createDataFrame([("p", "a.py", "def f(x): ..."), ("p", "b.py", None), ("q", "a.py", "def ("), ("r", "c.py", "")], "project string, file string, code string")

    def names(file, text):
        return [("CALLABLE_RETURN", n.name, n.name, None, 1) for n in ast.parse(text).body]

    found = predict.per_file(code, names, "m").collect()
    assert {(r.file, r.qname, r.method, r.topn, (r.error or "")[:11]) for r in found} == {("a.py", "f", "m", 1, ""), ("a.py", None, "m", None, "SyntaxError")}
    subset = spark.createDataFrame([("b.py",)], "file string")
    assert predict.per_file(code, names, "m", subset).count() == 0

    def together(files):
        return [(f, *row) for f, text in sorted(files.items()) for row in names(f, text)]

    whole = predict.project_wide(code, together, "m")
    assert {(r.project, r.qname, r.error is None) for r in whole.collect()} == {("p", "f", True), ("q", None, False)}
    others = spark.createDataFrame([("p", "b.py"), ("q", "b.py")], "project string, file string")
    assert [r.project for r in predict.project_wide(code, together, "m", others).collect()] == ["q"]
    assert predict.project_wide(code.limit(0), together, "m").count() == 0


@pytest.mark.parametrize("name, below", [("many-types-4-py-dataset", "repos/me/lib/src/a.py"), ("Better-Types-4-Py-Dataset", "repos/test/me__lib/src/a.py"), ("lib", "src/a.py")])
def test_data_sets(spark, tmp_path, name, below):
    root = tmp_path / name
    (root / below).parent.mkdir(parents=True)
    (root / below).write_text("x = 1\n")
    if name.startswith("many"):
        (root / "data").mkdir()
        (root / "data" / "dataset_split.csv").write_text('test,"repos/me/lib/src/a.py"\ntrain,"repos/me/lib/src/b.py"\n')
    author = "lib" if name == "lib" else "me"
    assert [tuple(r) for r in scans.data_set(spark, str(root)).collect()] == [(author, "lib", "src/a.py", "x = 1\n", None)]
    assert [tuple(r) for r in scans.test_set(spark, str(root)).collect()] == [(author, "lib", ["src/a.py"])]
