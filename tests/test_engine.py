"""Edge cases of operators, pods, stores, sources and the pipeline on literals."""

import pathlib
import typing

import pyarrow as pa
import pytest

from weftline import TagFrame
from weftline.errors import DuplicateTagError, InputValidationError, SourceCollisionError
from weftline.functions.hashing import CachedFileHasher, ContentHash, combine_hashes, file_hash, function_info, hash_object, path_hash, table_hash
from weftline.functions.names import escaped, free_name, pascal_case, snake_case, unescaped
from weftline.functions.pods import CachedPod, FunctionPod, function_pod
from weftline.functions.typing import function_types, spark_type
from weftline.operators import Batch, MapTags
from weftline.plans.files import ConcurrentWriteError, VersionedTable
from weftline.plans.pipeline import Pipeline
from weftline.plans.store import RecordStore
from weftline.sources import DataFrameSource, ManualTableSource, SourceRegistry, VersionedSource


def frame(spark, rows, ddl, tags):
    return TagFrame.of(spark.createDataFrame(rows, ddl), tags)


def test_join(spark):
    left = frame(spark, [(0, 1, "a"), (1, 2, "b"), (4, 3, "c"), (None, 4, "d")], "id long, a long, b string", "id")
    right = frame(spark, [(0, True), (1, False), (1, True), (2, True), (None, True)], "id long, c boolean", "id")
    assert sorted(map(tuple, left.join(right).as_df().collect())) == [(0, 1, "a", True), (1, 2, "b", False), (1, 2, "b", True)]
    assert sorted(r.id for r in left.semi_join(right).as_df().collect()) == [0, 1]
    with pytest.raises(InputValidationError):
        left.join(left)
    with pytest.raises(InputValidationError):
        left.join(frame(spark, [("x", 1)], "a string, z long", "a"))
    with pytest.raises(InputValidationError):
        left.join(frame(spark, [("x", 1)], "id string, z long", "id"))


def test_columns(spark):
    f = frame(spark, [(1, 2, 3, 4)], "`a.b` long, `t:u` long, p long, r long", ("a.b", "t:u"))
    assert f.select_tags(["a.b", "t:u"]).as_df().columns == ["a.b", "t:u", "p", "r"]
    assert f.drop_tags("a.b").as_df().columns == ["t:u", "p", "r"]
    with pytest.raises(InputValidationError):
        f.select_tags("absent")
    with pytest.raises(InputValidationError):
        f.drop_packets(["p", "r"])
    with pytest.raises(InputValidationError):
        MapTags({"a.b": "p"})(f)
    assert MapTags({"absent": "x"}, drop_unmapped=True)(f).as_df().columns == f.as_df().columns
    assert f.map_packets({"p": "s"}).as_df(source=True).columns == ["a.b", "t:u", "s", "_source_s"]
    with pytest.raises(InputValidationError):
        frame(spark, [(1,)], "a long", "a")


def test_batch(spark):
    f = frame(spark, [(i, None if i % 2 else i) for i in range(5)], "k long, v long", "k")
    assert [r.v for r in f.batch(2).as_df().orderBy("k").collect()] == [[0, None], [2, None], [4]]
    assert f.batch(2, drop_partial_batch=True).as_df().count() == 2
    assert [r.k for r in f.batch().as_df().collect()] == [[0, 1, 2, 3, 4]]
    empty = f.filter("k > 9").batch(2).as_df()
    assert empty.count() == 0 and empty.schema["v"].dataType.typeName() == "array"
    with pytest.raises(ValueError):
        Batch(-1)


def add(a: int, b: int) -> int:
    return a + b


def wrong(a: int, b: int) -> tuple[int, int]:
    return (a,)


def test_pods(spark):
    f = frame(spark, [(i, i % 2, 10) for i in range(6)], "id long, a long, b long", "id")
    out = FunctionPod(add, "sum")(f)
    assert [(r.id, r.sum) for r in out.as_df(sort_by_tags=True).collect()] == [(i, 10 + i % 2) for i in range(6)]
    assert out.as_df(source=True).select("_source_sum").distinct().count() == 2
    assert FunctionPod(wrong, ["x", "y"], error_handling="ignore")(f).as_df().count() == 0
    warned = FunctionPod(wrong, ["x", "y"], error_handling="warn")
    assert warned(f).as_df().count() == 0 and warned.dropped.value == 2  # different packets
    with pytest.raises(Exception, match="returned 1 values"):
        FunctionPod(wrong, ["x", "y"])(f).as_df().collect()
    with pytest.raises(InputValidationError):
        FunctionPod(add, "sum")(f.select_packets("a"))
    with pytest.raises(ValueError):
        function_pod("x")(lambda a: a)


def test_records(spark):
    f = frame(spark, [(1, "a", 2)], "k long, v string, n long", "k").with_meta(seen=True).with_context("c")
    (r,) = f.iter_records()
    assert dict(r) == {"k": 1, "v": "a", "n": 2} and r.get_meta("seen") is True and r.context == "c"
    assert r.rename({"v": "w"}).with_source_info(w="s", x="t").sources == {"w": "s", "n": None}
    assert r.update(v="b")["v"] == "b" and r["v"] == "a" and r.copy() == r and hash(r.copy()) == hash(r)
    assert r.as_dict(sources=True, meta=True, context="at") == {"k": 1, "v": "a", "n": 2, "_source_v": None, "_source_n": None, "__seen": True, "at": "c"}
    assert r.as_table().num_rows == 1 and r.types() == {"k": int, "v": str, "n": int}
    for call, error in ((lambda: r.select("x"), ValueError), (lambda: r.drop("x"), KeyError), (lambda: r.update(x=1), KeyError), (lambda: r.with_columns(v=1), ValueError), (lambda: r.drop_meta("x"), KeyError), (lambda: r.rename({"v": "n"}), ValueError)):
        with pytest.raises(error):
            call()
    assert "v" not in r.drop("v", "x", ignore_missing=True)
    for call, error in ((lambda: f.update(x=1), KeyError), (lambda: f.with_columns(v=1), ValueError), (lambda: f.drop_meta("x"), KeyError)):
        with pytest.raises(error):
            call()
    assert "*k" in f._repr_html_()


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None and t.version == 0 and t.modified is None
    df = spark.range(3)
    assert [t.append(df), t.append(df)] == [1, 2] and t.read().count() == 6
    (tmp_path / "t" / "manifest-000000000003.json").write_text('{"version": 3, "fol')  # a writer that died in publishing
    assert t.version == 2 and t.read().count() == 6
    assert t.compact() == 4 and t.read().count() == 6
    stale = t._state()
    t.append(df)
    with pytest.raises(ConcurrentWriteError):
        t._publish(stale["next"], [])
    assert t.read().count() == 9


def test_file_hashes(tmp_path):
    f = tmp_path / "d" / "x"
    f.parent.mkdir()
    f.write_text("one")
    hasher = CachedFileHasher(size=1, store=str(tmp_path / "hashes"))
    first = hasher(str(f))
    assert first == file_hash(str(f)) == CachedFileHasher(store=str(tmp_path / "hashes"))(str(f))
    folder = path_hash(str(f.parent))
    f.write_text("other")
    assert hasher(str(f)) == file_hash(str(f)) != first and path_hash(str(f.parent)) != folder
    assert file_hash(str(f), "crc32").digest != file_hash(str(f), "xxh64").digest != file_hash(str(f), "path").digest
    hasher.clear()
    assert function_info(add)["signature"] == "(a: int, b: int) -> int"


def test_names():
    assert free_name("a", ["a", "a_1"]) == "a_2" and free_name("b", ["a"]) == "b"
    assert snake_case("HTTPServerName") == "http_server_name" and pascal_case("a_pod_name") == "APodName"
    assert unescaped(escaped("a_b") + "_post") == ("a_b", "post") and unescaped(escaped("a_b")) == ("a_b", None)


def test_inputs_of_one_name(spark, tmp_path):
    a, b = (TagFrame.of(spark.createDataFrame([(i, i)], "id long, a long"), "id", lineage="same") for i in (1, 2))
    with pytest.raises(InputValidationError), Pipeline("p", RecordStore(spark, str(tmp_path))):
        FunctionPod(add, "sum", input_schema={"a": int, "b": int})
        MapTags({"id": "x"})(a)
        MapTags({"id": "y"})(b)


def test_typing():
    def two(data: str) -> tuple[int, str]: ...
    def none(x: int) -> None: ...
    def bare(x: int): ...

    assert function_types(two, ["n", "u"])[1] == {"n": int, "u": str}
    for f, keys in ((none, ["x"]), (bare, ["x"]), (two, ["a", "b", "c"]), (two, [])):
        with pytest.raises(ValueError):
            function_types(f, keys)
    assert spark_type(dict[str, int]).simpleString() == "array<struct<key:string,value:bigint>>"
    assert spark_type(typing.Optional[tuple[int, str]]).simpleString() == "struct<f0:bigint,f1:string>"
    assert spark_type(pathlib.Path).simpleString() == "struct<path:string>"
    for bad in (list, dict, object):
        with pytest.raises((TypeError, IndexError)):
            spark_type(bad)


def test_hashing(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    assert table_hash(a) == table_hash(a.orderBy("k", ascending=False).select("v", "k"))
    assert table_hash(a) != table_hash(a.where("k = 1"))
    h = hash_object({"a": {1, 2}, "b": None})
    assert h == hash_object({"b": None, "a": {2, 1}}) and ContentHash.from_string(h.to_string(64)) == h
    assert combine_hashes("a", "b", order=True) == combine_hashes("b", "a", order=True)
    with pytest.raises(TypeError):
        hash_object(pathlib.Path("x"))


def test_store(spark, tmp_path):
    s = RecordStore(spark, str(tmp_path))
    df = lambda rows, ddl="id string, v long": spark.createDataFrame(rows, ddl)
    s.add_records(("a", "b:c", "_d"), df([("x", 1), ("x", 2), ("y", 3)]), order="v")
    s.add_records(("a", "b:c", "_d"), df([("x", 9), ("z", 4)]), flush=False)
    got = {r.id: r.v for r in s.all_records(("a", "b:c", "_d"), "id").collect()}
    assert got == {"x": 2, "y": 3, "z": 4}
    s.flush()
    assert [r.v for r in s.records_by_ids(("a", "b:c", "_d"), ["q", "z", "x"], "id", preserve_order=True).collect()] == [None, 4, 2]
    with pytest.raises(ValueError):
        s.add_records(("a", "b:c", "_d"), df([("w", 1, 2)], "id string, v long, w long"))
    s.add_records(("a", "b:c", "_d"), df([("w", 1, 2)], "id string, v long, w long"), schema_handling="merge")
    assert {r.id: r.w for r in s.all_records(("a", "b:c", "_d"), "id").collect()}["w"] == 2
    s.overwrite_records(("a", "b:c", "_d"), df([("x", 7, 7)], "id string, v long, w long"))
    assert s.record_by_id(("a", "b:c", "_d"), "x").first().v == 7
    assert s.delete_record(("a", "b:c", "_d"), "x") and not s.delete_record(("a", "b:c", "_d"), "x")


def test_sources(spark, tmp_path):
    table = pa.table({"k": pa.array([1, 2], pa.uint32()), "v": pa.array([None, None]), "m": pa.array([[("a", 1)], None], pa.map_(pa.string(), pa.int64()))})
    f = DataFrameSource(spark, table, "k", source_name="t", registry=None).frame()
    assert [r["_source_v"] for r in f.as_df(source=True, sort_by_tags=True).collect()] == ["t::row_0::v", "t::row_1::v"]
    source = ManualTableSource(spark, str(tmp_path / "m"), "k long, v string", "k", registry=None)
    source.insert({"k": 1, "v": "a"})
    with pytest.raises(DuplicateTagError):
        source.insert({"k": 1, "v": "b"})
    source.insert([{"k": 1, "v": "b"}, {"k": 2, "v": "c"}], skip_duplicates=True)
    assert source.frame().as_df().count() == 2 and source.resolve_field({"k": 1}, "v") == "a"
    r = SourceRegistry()
    a = VersionedSource(spark, str(tmp_path / "m"), "k", source_name="a", registry=r)
    with pytest.raises(SourceCollisionError):
        VersionedSource(spark, str(tmp_path / "n"), "k", source_name="a", registry=r)
    assert "a" in r and r.get("a") is a


def test_pipeline(spark, tmp_path):
    data = spark.createDataFrame([(i, i, 10 * i) for i in range(5)], "id long, a long, b long")
    f = TagFrame.of(data, "id", lineage="numbers")
    p = Pipeline("p", RecordStore(spark, str(tmp_path)))
    with p:
        s = FunctionPod(add, "sum")(f)
        FunctionPod(add, "total")(s.map_packets({"sum": "a"}).join(f.select_packets("b")))
    assert set(p.nodes) == {"add_1", "add_2", "MapPackets", "Join", "SelectPacketColumns"}
    p.run()
    assert {(r.id, r.total) for r in p.add_2.frame.as_df().collect()} == {(i, 21 * i) for i in range(5)}
    store = p.results_store
    path = CachedPod(FunctionPod(add, "sum"), store, ("p", "_results")).path
    assert store.info(path)["rows"] == 5
    p.run()
    assert store.info(path)["rows"] == 5
    more = TagFrame.of(data.union(spark.createDataFrame([(9, 100, 1), (10, 1, 10)], data.schema)), "id", lineage="numbers")
    p.run(sources={"numbers": more})
    assert store.info(path)["rows"] == 6  # of two new rows one has a known packet
    assert p.records("add_1").count() == 7
    assert "digraph" in p.to_dot()
