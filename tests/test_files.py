from __future__ import annotations

import base64
import glob
import hashlib
from contextlib import nullcontext

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql.pandas.types import to_arrow_schema

from scoreloom.functions.paths import normalise_path
from scoreloom.operators.artifacts import NameClash, require_unique, with_output_path
from scoreloom.sources import files, storage
from scoreloom.sources.storage import open_store, read_file, write_file


@pytest.fixture
def tree(tmp_path):
    names = [
        "a.jpg", "b.JPG", "c.png", "_hidden.jpg", ".dot.jpg", "x/a.jpg", "x/d.jpg", "y/e f+g%h#i.jpg", "y/z/deep.jpg",
        "dir.jpg/inner.jpg",
    ]
    for i, name in enumerate(names):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(name.encode() * (i + 1))
    return tmp_path


def names(df, root):
    return sorted(r.path[len(str(root)) + 1 :] for r in df.select(normalise_path("path").alias("path")).collect())


def test_flat_and_one_level_patterns(spark, tree):
    assert names(files.list_files(spark, str(tree), "*.jpg"), tree) == ["_hidden.jpg", "a.jpg"]
    assert names(files.list_files(spark, str(tree), "*/*.jpg"), tree) == [
        "dir.jpg/inner.jpg", "x/a.jpg", "x/d.jpg", "y/e f+g%h#i.jpg"
    ]
    assert names(files.list_files(spark, str(tree), "[xy]/*"), tree) == ["x/a.jpg", "x/d.jpg", "y/e f+g%h#i.jpg"]


def test_any_depth_pattern_is_case_sensitive(spark, tree):
    found = names(files.list_files(spark, str(tree), "*.jpg", any_depth=True), tree)
    assert found == ["_hidden.jpg", "a.jpg", "dir.jpg/inner.jpg", "x/a.jpg", "x/d.jpg", "y/e f+g%h#i.jpg", "y/z/deep.jpg"]
    assert names(files.list_files(spark, str(tree), "*.JPG", any_depth=True), tree) == ["b.JPG"]


def test_tree_listing_equals_the_built_in_one(spark, tree):
    built_in = files.list_files(spark, str(tree), "*", any_depth=True)
    ours = files.list_tree(spark, str(tree))
    lengths = lambda df: sorted((r.p, r.length) for r in df.select(normalise_path("path").alias("p"), "length").collect())
    assert lengths(ours) == lengths(built_in)
    assert names(files.list_tree(spark, str(tree), "*.png"), tree) == ["c.png"]


def test_first_n_of_files_matches_a_sorted_glob(spark, tree):
    want = sorted(glob.glob(f"{tree}/*/*.jpg"))[:2]
    listed = files.list_files(spark, str(tree), "*/*.jpg", n=2)
    assert names(listed, tree) == [w[len(str(tree)) + 1 :] for w in want]
    assert files.list_files(spark, str(tree), "*/*.jpg", n=99).count() == 4


def test_nothing_matches(spark, tree):
    assert files.list_files(spark, str(tree), "*.gif").collect() == []
    assert files.list_files(spark, str(tree / "absent"), "*").collect() == []
    assert files.path_table(spark, []).collect() == []
    assert files.read_bytes(files.path_table(spark, [])).collect() == []


def test_example_input(spark, tree):
    row = files.example_input(spark, str(tree), "*/*.jpg").first()
    assert base64.b64decode(row.image) == (tree / "dir.jpg/inner.jpg").read_bytes()
    assert files.example_input(spark, str(tree), "*.gif").collect() == []


def test_tasks_read_the_same_bytes(spark, tree):
    listed = files.list_files(spark, str(tree), "*", any_depth=True).select("path")
    rows = files.read_bytes(listed.repartition(3)).collect()
    assert len(rows) == 9
    for r in rows:
        with open(r.path.removeprefix("file:"), "rb") as f:
            assert hashlib.md5(r.content).digest() == hashlib.md5(f.read()).digest()


def test_read_bytes_splits_batches_by_size(spark, tmp_path, monkeypatch):
    for i in range(1, 20):
        (tmp_path / f"{i:02d}.bin").write_bytes(bytes([i]) * (i * 1000))
    monkeypatch.setattr(files, "_BATCH_BYTES", 5000)
    listed = files.list_files(spark, str(tmp_path), "*.bin").coalesce(1)
    got = {r.path[-6:]: len(r.content) for r in files.read_bytes(listed).collect()}
    assert got == {f"{i:02d}.bin": i * 1000 for i in range(1, 20)}


class Rows:
    """A frame that passes one batch through a task's function, without Spark."""

    sparkSession = None

    def __init__(self, rows, schema=None):
        self.batch, self.schema = pa.RecordBatch.from_pylist(rows), schema

    def select(self, *columns):
        return self

    def mapInArrow(self, run, out):
        return list(run(iter([self.batch])))


def test_payloads_are_written_a_few_at_a_time(tmp_path, monkeypatch):
    """No task turns more bodies into Python objects than it has requests open, however many rows a batch has."""
    held = []
    monkeypatch.setattr(files, "materialise", lambda df, name: df)
    monkeypatch.setattr(files, "payload_batches", lambda spark, rows: nullcontext(), raising=False)
    monkeypatch.setattr(files, "io_map", lambda call, paths, bodies: held.append(len(bodies)) or storage.io_map(call, paths, bodies))
    out = files.write_bytes(Rows([{"path": f"file:{tmp_path}/out/{i}", "content": bytes([i]) * i} for i in range(203)]))
    assert [r for b in out for r in b.to_pylist()] == [{"path": f"file:{tmp_path}/out/{i}", "length": i} for i in range(203)]
    assert max(held) <= files.IO_THREADS
    assert all((tmp_path / "out" / str(i)).read_bytes() == bytes([i]) * i for i in range(203))


def test_payloads_are_read_a_few_megabytes_at_a_time(spark, tmp_path):
    """Batches that leave a task are cut soon after they reach their size."""
    for i in range(48):
        (tmp_path / f"{i:02d}.bin").write_bytes(bytes([i]) * (1 << 18))
    taken = files.read_bytes(Rows([{"path": f"file:{tmp_path}/{i:02d}.bin"} for i in range(48)], files.PATH_SCHEMA))
    assert [len(x) for b in taken for x in b.column("content").to_pylist()] == [1 << 18] * 48
    assert max(b.nbytes for b in taken) <= files._BATCH_BYTES + files.IO_THREADS * (1 << 18) <= 8 << 20


def test_one_rule_in_all_readers(spark, tmp_path):
    """Empty files, names with an underscore and patterns with several endings, listed, scanned and read alike."""
    for name, body in (("0.jpg", b""), ("1.png", b"1"), ("_2.jpg", b"22"), ("3.gif", b"333"), (".4.jpg", b"4")):
        (tmp_path / name).write_bytes(body)
    want = ["0.jpg", "1.png", "_2.jpg"]
    for listed in (files.list_files, files.list_tree, files.binary_scan):
        assert names(listed(spark, str(tmp_path), "*.{jpg,png}"), tmp_path) == want
    assert names(files.list_files(spark, str(tmp_path), "*.{jpg,png}", any_depth=True), tmp_path) == want
    assert {bytes(r.content) for r in files.binary_scan(spark, str(tmp_path), "*.{jpg,png}").collect()} == {b"", b"1", b"22"}
    assert files.list_files(spark, str(tmp_path / "nowhere")).count() == 0


def test_only_named_folders_are_listed(spark, tree, monkeypatch):
    """A flat pattern looks into one folder, a part of a pattern into the folders it names."""
    asked = []
    inner = storage.list_folder
    monkeypatch.setattr(files, "list_folder", lambda uri, *more: asked.append(uri.rsplit("/", 1)[1]) or inner(uri, *more))
    assert names(files.list_files(spark, str(tree), "*.jpg"), tree) == ["_hidden.jpg", "a.jpg"]
    assert asked == [tree.name]
    asked.clear()
    assert names(files.list_files(spark, str(tree), "[xw]/*"), tree) == ["x/a.jpg", "x/d.jpg"]
    assert sorted(asked) == sorted([tree.name, "x"])
    assert names(files.list_files(spark, str(tree), "{x,y/z}/*.jpg"), tree) == ["x/a.jpg", "x/d.jpg", "y/z/deep.jpg"]


@pytest.fixture(params=["driver", "tasks"])
def lister(request, monkeypatch):
    if request.param == "tasks":
        monkeypatch.setattr(files, "DRIVER_ENTRIES", 0)
    return request.param


def test_links(spark, tree, lister):
    """A link to a folder above, two that lead to each other, one to itself, and one to nothing."""
    (tree / "x" / "up").symlink_to(tree)
    (tree / "x" / "y").symlink_to(tree / "y")
    (tree / "y" / "x").symlink_to(tree / "x")
    (tree / "self.jpg").symlink_to(tree / "self.jpg")
    (tree / "gone.jpg").symlink_to(tree / "nowhere")
    (tree / "linked.jpg").symlink_to(tree / "a.jpg")
    assert names(files.list_files(spark, str(tree), "*.jpg"), tree) == ["_hidden.jpg", "a.jpg", "linked.jpg"]
    assert names(files.list_files(spark, str(tree), "*/a*"), tree) == ["x/a.jpg"]
    deep = names(files.list_tree(spark, str(tree), "[dl]*.jpg"), tree)
    assert deep == ["linked.jpg", "x/d.jpg", "x/y/z/deep.jpg", "y/x/d.jpg", "y/z/deep.jpg"]


def test_both_ways_of_listing_agree(spark, tree, lister):
    test_flat_and_one_level_patterns(spark, tree)
    test_any_depth_pattern_is_case_sensitive(spark, tree)
    test_nothing_matches(spark, tree)


def test_tasks_share_a_folder(spark, tmp_path, monkeypatch):
    for i in range(500):
        (tmp_path / f"{i * 7919 % 500:03d}.{'ab'[i % 2]}").write_bytes(b"x" * i)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.a").write_bytes(b"")
    monkeypatch.setattr(files, "DRIVER_ENTRIES", 0)
    monkeypatch.setattr(files, "SPLIT", 60)
    want = sorted(p.name for p in tmp_path.glob("*.a"))
    assert names(files.list_files(spark, str(tmp_path), "*.a"), tmp_path) == want
    assert names(files.list_tree(spark, str(tmp_path), "*.a"), tmp_path) == sorted([*want, "sub/x.a"])
    lister = files._lister("[^/]*", "files")
    piece = pa.RecordBatch.from_pylist([{"path": str(tmp_path), "trail": [], "after": None, "until": None}], to_arrow_schema(files._PIECE))
    pieces = [r for b in lister([piece]) for r in b.to_pylist()]
    assert {r["kind"] for r in pieces} == {"range"} and len(pieces) >= 8  # each for a task of its own
    shared = [r["path"] for p in pieces for b in lister([pa.RecordBatch.from_pylist([{k: p[k] for k in files._PIECE.names}], piece.schema)]) for r in b.to_pylist() if r["kind"] == "file"]
    assert len(shared) == len(set(shared)) <= 500


@pytest.mark.parametrize("n", [1, 40, 41, 250, 999, 1000])
def test_the_nth_key_is_found_by_counting(spark, n):
    df = spark.createDataFrame([(f"k{i * 7919 % 1000:04d}",) for i in range(1000)], "path string").repartition(4)
    assert files.nth_key(df, n, "path", rows=20, cuts=5) == (None if n == 1000 else f"k{n - 1:04d}")


def test_a_large_cut_moves_no_rows(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i * 7919 % 1000:04d}", i) for i in range(1000)], "path string, length long").repartition(4)
    monkeypatch.setattr(files, "TOP_ROWS", 50)
    first = files.first_n(df, 700)
    assert sorted(r.path for r in first.collect()) == [f"k{i:04d}" for i in range(700)]
    assert "rangepartitioning" not in first._jdf.queryExecution().executedPlan().toString()
    assert files.first_n(df, 5000).count() == 1000 and files.first_n(df, 1000).count() == 1000


def test_patterns():
    import re

    cases = {"*.jpg": ["a.jpg", "_a.jpg"], "a?c": ["abc"], "[a-c]x": ["ax", "cx"], "[^a-c]x": ["dx"], "{ab,c*}.x": ["ab.x", "cde.x"], "a\\*": ["a*"], "x/*": ["x/y"]}
    every = sorted({n for found in cases.values() for n in found})
    for glob_, found in cases.items():
        assert [n for n in every if re.fullmatch(files.glob_pattern(glob_), n)] == sorted(found), glob_


def test_listing_opens_no_file(spark, tree):
    plan = files.list_files(spark, str(tree), "*/*.jpg")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_clashing_base_names_are_refused(spark, tree):
    listed = files.list_files(spark, str(tree), "*.jpg", any_depth=True)
    named = with_output_path(listed, "/out", "basename")
    with pytest.raises(NameClash, match="/out/a.jpg"):
        require_unique(named)
    require_unique(with_output_path(listed, "/out", "relative", str(tree)))
    require_unique(with_output_path(listed, "/out", "ordinal"))


def test_shards_spread_names(spark):
    paths = files.path_table(spark, [f"/in/{i}.jpg" for i in range(200)])
    rows = with_output_path(paths, "/out", "basename", shards=4).collect()
    assert {r.output_path.split("/")[2] for r in rows} == {"0", "1", "2", "3"}
    with pytest.raises(ValueError):
        with_output_path(paths, "/out", "other")


def test_write_replaces_whole_files(tmp_path):
    uri = f"file://{tmp_path}/deep/er/x y#z%20.bin"
    for body in (b"first", b"second"):
        write_file(uri, body)
        assert read_file(uri) == body
    assert [p.name for p in (tmp_path / "deep/er").iterdir()] == ["x y#z%20.bin"]


class Strict:
    """A store that refuses to move over an existing file."""

    type_name = "hdfs"

    def __init__(self):
        self.inner = fs.LocalFileSystem()

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def move(self, source, target):
        if self.inner.get_file_info(target).type != fs.FileType.NotFound:
            raise OSError("target exists")
        self.inner.move(source, target)


def test_write_on_a_strict_store(monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "_store", lambda u: (Strict(), str(tmp_path)))
    for body in (b"first", b"second"):
        write_file("hdfs://host/d/x.bin", body)
        assert read_file("hdfs://host/d/x.bin") == body
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["x.bin"]


def test_local_addresses():
    for uri in ("/a/b c", "file:/a/b c", "file:///a/b c"):
        assert open_store(uri)[1] == "/a/b c"


@pytest.mark.parametrize(
    "uri, opened, root, path",
    [
        ("s3a://bucket/a b/c%20.jpg", "s3://bucket/", "bucket", "bucket/a b/c%20.jpg"),
        ("hdfs://host:8020/a/b#c.jpg", "hdfs://host:8020/", "/", "/a/b#c.jpg"),
        ("abfss://box@account/a.jpg", "abfss://box@account/", "box", "box/a.jpg"),
    ],
)
def test_remote_addresses(monkeypatch, uri, opened, root, path):
    asked = []
    monkeypatch.setattr(storage, "_store", lambda u: (asked.append(u), ("store", root))[1])
    assert open_store(uri) == ("store", path)
    assert asked == [opened]


def test_remote_listing_keeps_the_address(monkeypatch, tmp_path):
    """Names come back below the address that was asked for, whatever the store calls its root."""
    (tmp_path / "bucket" / "d" / "e").mkdir(parents=True)
    (tmp_path / "bucket" / "d" / "a b.jpg").write_bytes(b"123")
    shared = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(storage, "_store", lambda u: (shared, "bucket"))
    assert sorted(storage.list_folder("s3://bucket/d/")) == [("s3://bucket/d/a b.jpg", False, 3, ()), ("s3://bucket/d/e", True, 0, ())]
    monkeypatch.setattr(storage, "OBJECT_STORES", (shared.type_name,))
    write_file("s3://bucket/d/new.jpg", b"4567")
    assert read_file("s3://bucket/d/new.jpg") == b"4567"
