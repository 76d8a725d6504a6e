"""The scan of source trees: no name is lost, whatever it begins with, and what can't be read is told."""

import os

import pytest

from symbolith.sources import scans, tree

NAMES = ["pkg/__init__.py", "pkg/__main__.py", "pkg/_private.py", "pkg/a.py", "pkg/a b%20.py", "pkg/empty.py", "_hidden/b.py", "_hidden/_x/__init__.py", ".git/c.py", "é/ü.py", "top.py", "pkg/stub.pyi", "pkg/not.txt", "pkg/no.pyc"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name in NAMES:
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("" if "empty" in name else f"name = {name!r}\r\n", newline="")
    (top / "bad.py").write_bytes(b"x = '\xff'")
    (top / "gone.py").symlink_to("/nowhere/at/all")
    (top / "linked.py").symlink_to(top / "top.py")
    (top / "loop").symlink_to(top)
    (top / "folder.py").mkdir()
    (top / "folder.py" / "inner.py").write_text("1")
    return str(top)


def found(df):
    out = {r.file: (r.code, r.error) for r in df.collect()}
    assert len(out) == df.count()
    return out


def test_no_name_is_lost(spark, root):
    got = found(scans.sources(spark, root))
    want = {n: ("" if "empty" in n else f"name = {n!r}\r\n", None) for n in NAMES if n.endswith(".py")}
    want |= {"linked.py": want["top.py"], "folder.py/inner.py": ("1", None), "bad.py": (None, "not UTF-8")}
    assert {n: x for n, x in got.items() if n != "gone.py"} == want
    assert got["gone.py"][0] is None and "No such file" in got["gone.py"][1]
    assert found(scans.sources(spark, f"file://{root}/", stubs=True)) == got | {"pkg/stub.pyi": ("name = 'pkg/stub.pyi'\r\n", None)}


@pytest.mark.parametrize("name", ["pkg/__init__.py", "pkg/a b%20.py", "pkg/stub.pyi", "pkg/empty.py"])
def test_a_single_file(spark, root, name):
    assert list(found(scans.sources(spark, f"{root}/{name}"))) == [name.split("/")[-1]]


def test_subset_and_missing_root(spark, root):
    subset = spark.createDataFrame([("pkg/__init__.py",), ("pkg/none.py",), ("pkg/__init__.py",)], "file string")
    assert list(found(scans.sources(spark, root, subset=subset))) == ["pkg/__init__.py"]
    with pytest.raises(Exception, match="no such file or folder"):
        scans.sources(spark, f"{root}/none").count()
    os.makedirs(f"{root}/loop/.nothing", exist_ok=True)
    assert scans.sources(spark, f"{root}/.nothing").count() == 0


def test_partitions_follow_bytes(tmp_path):
    for k in range(60):
        (tmp_path / f"{k:02}.py").write_bytes(b"x" * (100_000 if k == 7 else 1000))
    parts = tree.Reader({"path": str(tmp_path), "partition_bytes": "51200"}).partitions()
    assert [n for p in parts for n in p.names] == [f"{k:02}.py" for k in range(60)]
    sizes = [sum(os.path.getsize(tmp_path / n) + tree.OPENING for n in p.names) for p in parts]
    assert all(s <= 51200 or len(p.names) == 1 for s, p in zip(sizes, parts, strict=True)) and len(parts) < 12


def test_folders_at_a_depth_are_listed_by_tasks(spark, tmp_path):
    for a in "ab":
        for p in "xyz":
            (tmp_path / a / p / "deep" / "_er").mkdir(parents=True)
            (tmp_path / a / p / "__init__.py").write_text("1")
            (tmp_path / a / p / "deep" / "_er" / "m.py").write_text("2")
    (tmp_path / "setup.py").write_text("3")
    parts = tree.Reader({"path": str(tmp_path), "depth": "2"}).partitions()
    assert [n for p in parts for n in p.names] == [*(f"{a}/{p}/" for a in "ab" for p in "xyz"), "setup.py"]
    whole = found(scans.sources(spark, str(tmp_path)))
    assert len(whole) == 13 and all(found(scans.sources(spark, str(tmp_path), depth=k)) == whole for k in (1, 2, 9))
    crawl = scans.crawl(spark, str(tmp_path)).collect()
    assert sorted((r.author, r.project, r.file) for r in crawl) == sorted((a, p, f) for a in "ab" for p in "xyz" for f in ("__init__.py", "deep/_er/m.py"))


def test_unreadable_folder(monkeypatch):
    class Broken(tree.Local):
        def folder(self, name):
            raise PermissionError("closed")

    monkeypatch.setattr(tree, "store", lambda path: Broken("/tmp"))
    reader = tree.Reader({"path": "/tmp"})
    (part,) = reader.partitions()
    assert [b.to_pylist() for b in reader.read(part)] == [[{"file": "", "size": 0, "content": None, "error": "closed"}]]


def test_layouts_keep_package_files(spark, tmp_path):
    top = tmp_path / scans.BETTERTYPES / "repos" / "test" / "me__proj"
    (top / "_x").mkdir(parents=True)
    for name in ("__init__.py", "_x/__init__.py", "m.py"):
        (top / name).write_text("")
    path = str(tmp_path / scans.BETTERTYPES)
    assert scans.test_set(spark, path).first().files == ["__init__.py", "_x/__init__.py", "m.py"]
    assert {r.file for r in scans.data_set(spark, path).collect()} == {"__init__.py", "_x/__init__.py", "m.py"}
