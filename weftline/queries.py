"""One query for each operator of the engine, over whole tables, with its SQL."""

from __future__ import annotations

import pathlib
import uuid

from pyspark.sql import functions as F

from .columns import META
from .frame import TagFrame
from .functions.hashing import combine_hashes, file_hashes, hash_object, table_hash
from .functions.names import snake_case
from .functions.pods import ENGINE, CachedPod, FunctionPod, WrappedPod
from .operators import Batch, Filter, Join, MapPackets, MapTags, SelectTagColumns
from .plans.files import VersionedTable, shared_folder
from .plans.pipeline import Pipeline
from .plans.store import ID, ReadThroughStore, RecordStore
from .sources import CSVSource, DataFrameSource, DictSource, FrameSource, GlobSource, ListSource, ManualTableSource, ParquetSource, SourceRegistry, VersionedSource
from .streaming.live import LiveFrame, stream_pod

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark, d, name, tags, columns=None):
    df = spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")
    return TagFrame.of(df.select(*columns) if columns else df, tags, lineage=f"{name}:{tags}:{columns}")


def orders(s, d):
    return t(s, d, "orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]).map_tags({"o_orderkey": "orderkey"})


def lines(s, d):
    return t(s, d, "lineitem", "l_orderkey", ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag"]).map_tags({"l_orderkey": "orderkey"})


def store(spark) -> RecordStore:
    return RecordStore(spark, f"{shared_folder(spark)}/weftline/store-{uuid.uuid4().hex}")


@query("SELECT l_orderkey AS orderkey, o_custkey, o_orderstatus, o_totalprice, l_partkey, l_quantity, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def join_shared_tag(s, d):
    return orders(s, d).join(lines(s, d)).as_df()


@query("SELECT c_custkey AS custkey, n_nationkey AS nationkey, o_orderkey, c_name, n_name, o_totalprice FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey")
def join_three_way(s, d):
    c = t(s, d, "customer", ("c_custkey", "c_nationkey"), ["c_custkey", "c_nationkey", "c_name"]).map_tags({"c_custkey": "custkey", "c_nationkey": "nationkey"})
    n = t(s, d, "nation", "n_nationkey", ["n_nationkey", "n_name"]).map_tags({"n_nationkey": "nationkey"})
    o = t(s, d, "orders", ("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey", "o_totalprice"]).map_tags({"o_custkey": "custkey"}, drop_unmapped=False)
    return Join()(c, n, o).as_df()


@query("SELECT a.conv_id, a.turn, a.role, b.text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn")
def join_multi_tag(s, d):
    c = t(s, d, "conversations", ("conv_id", "turn"))
    return c.select_packets("role").join(c.select_packets("text")).as_df()


@query("SELECT r_regionkey, n_nationkey, r_name, n_name FROM region CROSS JOIN nation")
def join_cartesian(s, d):
    return t(s, d, "region", "r_regionkey", ["r_regionkey", "r_name"]).join(t(s, d, "nation", "n_nationkey", ["n_nationkey", "n_name"])).as_df()


@query("SELECT r_regionkey, r_name FROM region")
def join_single(s, d):
    return Join()(t(s, d, "region", "r_regionkey")).as_df()


@query(
    "SELECT r.r_regionkey, r.r_name, 'region::row_' || CAST(r.i AS VARCHAR) AS left_row, n.n_name, 'nation::row_' || CAST(n.i AS VARCHAR) AS right_row "
    "FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region) r JOIN (SELECT *, row_number() OVER (ORDER BY n_regionkey, n_name) - 1 AS i FROM nation) n ON n_regionkey = r_regionkey"
)
def join_system_tags(s, d):
    r = ParquetSource(s, f"{d}/region.parquet", "r_regionkey", source_name="region", registry=None).frame()
    n = DataFrameSource(s, s.read.parquet(f"{d}/nation.parquet").selectExpr("n_regionkey AS r_regionkey", "n_name"), "r_regionkey", source_name="nation", registry=None).frame()
    out = r.join(n)
    left, right = out.roles.system_tags
    return out.df.select("r_regionkey", "r_name", F.col(f"`{left}`").alias("left_row"), "n_name", F.col(f"`{right}`").alias("right_row"))


@query("SELECT doc_id, lang, source, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_join_tag(s, d):
    return t(s, d, "documents", "doc_id", ["doc_id", "lang", "source", "n_chars"]).semi_join(t(s, d, "labels", "doc_id")).as_df()


@query("SELECT o_orderkey AS orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders o WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = o.o_orderkey AND p.o_orderstatus = o.o_orderstatus AND p.o_totalprice > 200000)")
def semi_join_tag_and_packet(s, d):
    right = orders(s, d).filter("o_totalprice > 200000").select_packets(["o_orderstatus"])
    return orders(s, d).semi_join(right).as_df()


@query("SELECT r_regionkey, r_name FROM region")
def semi_join_disjoint(s, d):
    return t(s, d, "region", "r_regionkey").semi_join(t(s, d, "nation", "n_nationkey")).as_df()


@query("SELECT o_orderkey AS orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_predicate(s, d):
    return orders(s, d).filter(F.col("o_totalprice") > 100000, "o_orderstatus = 'F'").as_df()


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND user_id = 7")
def filter_constraints(s, d):
    return t(s, d, "events", "event_id", ["event_id", "user_id", "event_type"]).filter(constraint_map={"event_type": "view", "user_id": 7}, event_type="click").as_df()


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM orders WHERE CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END > 1000")
def filter_null(s, d):
    df = s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price")
    return TagFrame.of(df, "o_orderkey").filter("price > 1000").as_df()


def customer(s, d):
    return t(s, d, "customer", ("c_custkey", "c_nationkey"), ["c_custkey", "c_nationkey", "c_name", "c_mktsegment"])


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def select_tags(s, d):
    return customer(s, d).select_tags("c_custkey").as_df()


@query("SELECT c_nationkey, c_name, c_mktsegment FROM customer")
def select_tags_lenient(s, d):
    return SelectTagColumns(["c_nationkey", "absent"], strict=False)(customer(s, d)).as_df()


@query("SELECT c_custkey, c_nationkey, c_name FROM customer")
def select_packets(s, d):
    return customer(s, d).select_packets("c_name").as_df()


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def drop_tags(s, d):
    return customer(s, d).drop_tags("c_nationkey").as_df()


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_packets(s, d):
    return customer(s, d).drop_packets(["c_name", "absent"], strict=False).as_df()


@query("SELECT c_custkey AS custkey, c_nationkey, c_name, c_mktsegment FROM customer")
def map_tags(s, d):
    return MapTags({"c_custkey": "custkey"})(customer(s, d)).as_df()


@query("SELECT c_custkey AS custkey, c_name, c_mktsegment FROM customer")
def map_tags_drop(s, d):
    return customer(s, d).map_tags({"c_custkey": "custkey"}).as_df()


@query("SELECT c_custkey, c_nationkey, c_name AS name, c_mktsegment FROM customer")
def map_packets(s, d):
    return MapPackets({"c_name": "name"})(customer(s, d)).as_df()


@query("SELECT c_custkey, c_nationkey, c_name AS name FROM customer")
def map_packets_drop(s, d):
    return customer(s, d).map_packets({"c_name": "name"}).as_df()


def listed(frame):
    return frame.as_df().select(*(F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "-").alias(c) for c in frame.df.columns if not c.startswith("_")))


@query("SELECT string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS n_nationkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS n_name FROM nation")
def batch_all(s, d):
    return listed(t(s, d, "nation", "n_nationkey", ["n_nationkey", "n_name"]).batch())


_NUMBERED = "(SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // {n} AS g FROM orders)"


@query(f"SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orderkey, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS o_orderstatus FROM {_NUMBERED.format(n=64)} GROUP BY g")
def batch_n(s, d):
    return listed(orders(s, d).select_packets("o_orderstatus").batch(64))


@query(f"SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orderkey, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS o_orderstatus FROM {_NUMBERED.format(n=7)} GROUP BY g HAVING count(*) = 7")
def batch_drop_partial(s, d):
    return listed(Batch(7, drop_partial_batch=True)(orders(s, d).select_packets("o_orderstatus")))


@query(f"SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS o_orderkey, string_agg(CASE WHEN o_orderstatus = 'P' THEN '-' ELSE o_orderstatus END, ',' ORDER BY o_orderkey) AS status FROM {_NUMBERED.format(n=10)} GROUP BY g")
def batch_nulls(s, d):
    df = s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') AS status")
    return listed(TagFrame.of(df, "o_orderkey").batch(10))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey")
def sorted_export(s, d):
    return t(s, d, "nation", "n_nationkey").as_df(sort_by_tags=True)


def total(l_partkey: int, l_quantity: float, l_returnflag: str) -> int:
    return l_partkey * 2 + int(l_quantity)


def flags(l_returnflag: str, l_linestatus: str) -> tuple[str, bool]:
    return l_returnflag + l_linestatus, l_returnflag == "R"


def stats(n_chars: int) -> dict[str, int]:
    return {"half": n_chars // 2, "twice": n_chars * 2}


def described(role: list[str], turn: list[int]) -> str:
    return f"{len(role)}:{sum(turn)}:{role[0]}"


def priced(o_totalprice: float, l_quantity: float) -> float:
    return o_totalprice + l_quantity


@query("SELECT l_orderkey AS orderkey, l_partkey * 2 + CAST(floor(l_quantity) AS BIGINT) AS total FROM lineitem")
def pod_single_output(s, d):
    return FunctionPod(total, "total")(lines(s, d)).as_df()


@query("SELECT l_orderkey, l_returnflag || l_linestatus AS both, l_returnflag = 'R' AS back FROM lineitem")
def pod_multi_output(s, d):
    return FunctionPod(flags, ["both", "back"])(t(s, d, "lineitem", "l_orderkey", ["l_orderkey", "l_returnflag", "l_linestatus"])).as_df()


@query("SELECT doc_id, n_chars // 2 AS half, n_chars * 2 AS twice FROM documents")
def pod_struct_output(s, d):
    out = FunctionPod(stats, "stats")(t(s, d, "documents", "doc_id", ["doc_id", "n_chars"])).as_df()
    m = F.map_from_entries("stats")
    return out.select("doc_id", m["half"].alias("half"), m["twice"].alias("twice"))


@query("SELECT l_orderkey AS orderkey, o_totalprice + l_quantity AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def pod_two_inputs(s, d):
    return FunctionPod(priced, "price")(orders(s, d).select_packets("o_totalprice"), lines(s, d).select_packets("l_quantity")).as_df()


@query(
    "SELECT string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id, turn) AS convs, CAST(count(*) AS VARCHAR) || ':' || CAST(sum(turn) AS VARCHAR) || ':' || first(role ORDER BY conv_id, turn) AS described "
    "FROM (SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 5 AS g FROM conversations) GROUP BY g"
)
def pod_after_batch(s, d):
    c = s.read.parquet(f"{d}/conversations.parquet").selectExpr("conv_id", "turn AS at", "turn", "role")
    out = FunctionPod(described, "described")(TagFrame.of(c, ("conv_id", "at")).batch(5)).as_df()
    return out.select(F.array_join(F.transform("conv_id", lambda x: x.cast("string")), ",").alias("convs"), "described")


@query("SELECT l_orderkey AS orderkey, CAST(0 AS BIGINT) AS total FROM lineitem WHERE false")
def pod_inactive(s, d):
    return FunctionPod(total, "total", active=False)(lines(s, d)).as_df()


@query("SELECT l_orderkey, l_returnflag || l_linestatus AS both FROM lineitem")
def pod_dedup(s, d):
    out = FunctionPod(flags, ["both", "back"])(t(s, d, "lineitem", "l_orderkey", ["l_orderkey", "l_returnflag", "l_linestatus"]))
    return out.select_packets("both").as_df()


def memo(s, d):
    """A pod that remembers the packets of half of the orders."""
    pod = CachedPod(FunctionPod(lambda_free_price, "cents"), store(s))
    all_ = orders(s, d).select_packets("o_totalprice")
    pod(all_.filter("orderkey % 2 = 0"))
    return pod, all_


def lambda_free_price(o_totalprice: float) -> int:
    return round(o_totalprice * 100)


@query("SELECT o_orderkey AS orderkey, o_totalprice FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_totalprice = o.o_totalprice AND p.o_orderkey % 2 = 0)")
def memo_missing(s, d):
    pod, all_ = memo(s, d)
    return pod.missing(pod.pod.hashed(all_)).as_df()


@query("SELECT count(DISTINCT o_totalprice) AS packets FROM orders WHERE o_orderkey % 2 = 0")
def memo_existing(s, d):
    pod, _ = memo(s, d)
    return pod.stored().agg(F.count(F.lit(1)).alias("packets"))


@query("SELECT o_orderkey AS orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def memo_latest(s, d):
    pod, all_ = memo(s, d)
    return pod(all_).as_df()


def stored(s, d):
    """Orders by customer: the last order of each in two writes, of which the first stays."""
    st, o = store(s), s.read.parquet(f"{d}/orders.parquet").selectExpr("CAST(o_custkey AS STRING) AS id", "o_orderkey", "o_orderstatus")
    st.add_records(("orders",), o.where("o_orderkey % 3 = 0"), "id", order="o_orderkey")
    st.add_records(("orders",), o, "id", order="o_orderkey")
    return st


_KEPT = (
    "(SELECT CAST(o_custkey AS VARCHAR) AS id, coalesce(max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END), max(o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey) k"
)
_STORED = f"SELECT k.id, k.o_orderkey, o.o_orderstatus FROM {_KEPT} JOIN orders o ON o.o_orderkey = k.o_orderkey"


@query("SELECT CAST(o_custkey AS VARCHAR) AS id, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def store_keep_last(s, d):
    st = store(s)
    st.add_records(("last",), s.read.parquet(f"{d}/orders.parquet").selectExpr("CAST(o_custkey AS STRING) AS id", "o_orderkey"), "id", order="o_orderkey")
    return st.all_records(("last",), "id")


@query(_STORED)
def store_insert_if_absent(s, d):
    return stored(s, d).all_records(("orders",), "id")


@query(_STORED + " WHERE k.id = '7'")
def store_by_id(s, d):
    return stored(s, d).record_by_id(("orders",), "7", "id")


@query(_STORED + " WHERE k.id IN ('1', '2', '5', '8')")
def store_by_ids(s, d):
    return stored(s, d).records_by_ids(("orders",), ["1", "2", "5", "8"], "id")


@query(f"SELECT k.o_orderkey, o.o_orderstatus FROM {_KEPT} JOIN orders o ON o.o_orderkey = k.o_orderkey WHERE o.o_orderstatus = 'F'")
def store_by_value(s, d):
    return stored(s, d).records_with(("orders",), {"o_orderstatus": "F"})


@query("SELECT n_nationkey, n_name FROM nation")
def source_insert_skip(s, d):
    n = s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name")
    source = ManualTableSource(s, f"{shared_folder(s)}/weftline/manual-{uuid.uuid4().hex}", n.schema, "n_nationkey", registry=None)
    source.insert(n.where("n_nationkey < 10"))
    source.insert(n, skip_duplicates=True)
    return source.frame().as_df()


@query("SELECT r_regionkey, r_name, 'regions::row_' || CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS VARCHAR) || '::r_name' AS _source_r_name FROM region")
def source_info(s, d):
    return ParquetSource(s, f"{d}/region.parquet", "r_regionkey", source_name="regions", registry=None).frame().as_df(source=True)


@query("SELECT 0 AS element_index, 'a' AS x UNION ALL SELECT 1, 'b'")
def source_list(s, d):
    return ListSource(s, "x", ["a", "b"], registry=None).frame().as_df().withColumn("element_index", F.col("element_index").cast("int"))


@query("SELECT 1 AS k, 'x' AS v UNION ALL SELECT 2, NULL")
def source_dict(s, d):
    return DictSource(s, [{"k": 1, "v": "x"}, {"k": 2, "v": None}], "k", "k int, v string", registry=None).frame().as_df()


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def content_hash_relation(s, d):
    f = t(s, d, "documents", "doc_id", ["doc_id", "lang", "source"])
    return f.as_df(content_hash="h").groupBy("h").agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.count(F.lit(1)).alias("n")).drop("h")


@query("SELECT o_orderkey AS orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderstatus = 'F'")
def node_records(s, d):
    p = Pipeline("orders", store(s))
    with p:
        FunctionPod(lambda_free_price, "cents")(orders(s, d).filter("o_orderstatus = 'F'").select_packets("o_totalprice"))
    p.run()
    return p.records("lambda_free_price").select("orderkey", "cents")


# --- sources, stores and streams over folders of their own


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/weftline/{name}-{uuid.uuid4().hex}"


def nation(s, d, *columns):
    return s.read.parquet(f"{d}/nation.parquet").select(*(columns or ("n_nationkey", "n_name", "n_regionkey")))


@query("SELECT n_nationkey, n_name FROM nation")
def source_csv(s, d):
    path = folder(s, "csv")
    nation(s, d, "n_nationkey", "n_name").write.option("header", True).csv(path)
    return CSVSource(s, path, "n_nationkey", schema=nation(s, d, "n_nationkey", "n_name").schema, registry=None).frame().as_df()


@query("SELECT r_name FROM region")
def source_glob(s, d):
    path = folder(s, "glob")
    s.read.parquet(f"{d}/region.parquet").select("r_name").coalesce(1).write.text(path)
    found = GlobSource(s, path + "/part-*", registry=None).frame().as_df()
    return found.select(F.explode(F.split(F.regexp_replace(F.col("content").cast("string"), r"\n+$", ""), r"\n")).alias("r_name"))


@query("SELECT n_nationkey, n_name, 2 AS version FROM nation")
def source_versioned(s, d):
    path, df = folder(s, "versioned"), nation(s, d, "n_nationkey", "n_name")
    made = VersionedTable(s, path)
    made.append(df.where("n_nationkey < 10"))
    made.append(df.where("n_nationkey >= 10"))
    source = VersionedSource(s, path, "n_nationkey", registry=None)
    return source.frame().as_df().withColumn("version", F.lit(source.version()))


@query("SELECT 1 AS after, true AS newer, (SELECT n_name FROM nation WHERE n_nationkey = 6) AS by_tags, n_name AS by_row FROM nation WHERE n_nationkey = 7")
def source_fields(s, d):
    df = nation(s, d, "n_nationkey", "n_name")
    source = ManualTableSource(s, folder(s, "manual"), df.schema, "n_nationkey", registry=None)
    first = source.modified
    source.insert(df)
    row = (source.info()["version"] - 1, source.modified >= first, source.resolve_field({"n_nationkey": 6}, "n_name"), source.resolve_field(7, "n_name"))
    return s.createDataFrame([row], "after int, newer boolean, by_tags string, by_row string")


@query("SELECT 'a' AS id, 'DictSource' AS kind UNION ALL SELECT 'b', 'ListSource'")
def source_registry(s, d):
    known = SourceRegistry()
    DictSource(s, [{"k": 1, "v": 2}], "k", source_name="a", registry=known)
    ListSource(s, "x", [1, 2], source_name="b", registry=known)
    return s.createDataFrame([(i, known.info(i)["type"]) for i in known.list_sources()], "id string, kind string")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def source_frame(s, d):
    f = t(s, d, "nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]).filter("n_regionkey = 1").select_packets("n_name")
    return FrameSource(f, registry=None).frame().as_df()


@query(
    "SELECT v.k, CASE WHEN o.o_orderkey IS NULL THEN NULL ELSE v.id END AS id, o.o_orderkey FROM (VALUES (0, '8'), (1, 'none'), (2, '1'), (3, '8')) v(k, id) "
    f"LEFT JOIN ({_STORED}) o ON o.id = v.id"
)
def store_preserve_order(s, d):
    found = stored(s, d).records_by_ids(("orders",), ["8", "none", "1", "8"], "id", preserve_order=True)
    rows = [(i, r.id if r.o_orderkey is not None else None, r.o_orderkey) for i, r in enumerate(found.collect())]
    return s.createDataFrame(rows, "k int, id string, o_orderkey long")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey < 5 THEN lower(n_name) ELSE n_name END AS n_name FROM nation")
def store_overwrite(s, d):
    st, df = store(s), nation(s, d).selectExpr("CAST(n_nationkey AS STRING) AS id", "n_name")
    st.add_records(("n",), df, "id")
    st.overwrite_records(("n",), df.where("CAST(id AS INT) < 5").withColumn("n_name", F.lower("n_name")), "id")
    return st.all_records(("n",), "id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name FROM nation WHERE n_nationkey <> 3")
def store_delete(s, d):
    st = store(s)
    st.add_records(("n",), nation(s, d).selectExpr("CAST(n_nationkey AS STRING) AS id", "n_name"), "id")
    st.delete_record(("n",), "3")
    return st.all_records(("n",), "id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name, CASE WHEN n_nationkey < 10 THEN n_regionkey END AS n_regionkey FROM nation")
def store_coerce(s, d):
    st, df = store(s), nation(s, d).selectExpr("CAST(n_nationkey AS STRING) AS id", "n_name", "n_regionkey", "n_nationkey AS k")
    st.add_records(("n",), df.where("k < 10").drop("k"), "id")
    st.add_records(("n",), df.where("k >= 10").drop("k", "n_regionkey"), "id", schema_handling="coerce")
    return st.all_records(("n",), "id")


@query("SELECT 'a/b c' AS path, 20 AS n UNION ALL SELECT 'x_y/z', 5")
def store_tables(s, d):
    st, df = RecordStore(s, folder(s, "store"), batch_size=20), nation(s, d).selectExpr("CAST(n_nationkey AS STRING) AS id", "n_name", "n_nationkey AS k")
    st.add_records(("x_y", "z"), df.where("k < 5").drop("k"), "id")
    st.add_records(("a", "b c"), df.where("k < 10").drop("k"), "id", flush=False)
    st.add_records(("a", "b c"), df.where("k >= 10 AND k < 20").drop("k"), "id", flush=False)  # 20 are waiting: written
    return s.createDataFrame([("/".join(p), st.table(p).read().count()) for p in st.tables()], "path string, n int")


@query("SELECT n_name, true AS kept FROM nation WHERE n_nationkey = 4")
def store_read_through(s, d):
    near, far = store(s), store(s)
    far.add_records(("n",), nation(s, d).selectExpr("CAST(n_nationkey AS STRING) AS id", "n_name"), "id")
    found = ReadThroughStore(near, far).record_by_id(("n",), "4")
    return found.withColumn("kept", F.lit(near.all_records(("n",), ID).count() == 1))


# --- orders of rows, filters, joins of widths


@query("SELECT o_orderkey AS orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders ORDER BY 1")
def pod_sorted(s, d):
    return FunctionPod(lambda_free_price, "cents")(orders(s, d).select_packets("o_totalprice")).as_df(sort_by_tags=True)


@query("SELECT o_orderkey AS orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_list(s, d):
    return Filter([[F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F"], True])(orders(s, d)).select_packets("o_totalprice").as_df()


@query("SELECT r_regionkey, r_name FROM region WHERE false")
def filter_false(s, d):
    return t(s, d, "region", "r_regionkey", ["r_regionkey", "r_name"]).filter(False).as_df()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 7")
def join_int_long(s, d):
    a = TagFrame.of(nation(s, d, "n_nationkey", "n_name").withColumn("n_nationkey", F.col("n_nationkey").cast("int")), "n_nationkey")
    b = TagFrame.of(nation(s, d, "n_nationkey", "n_regionkey").where("n_nationkey < 7").withColumn("n_nationkey", F.col("n_nationkey").cast("long")), "n_nationkey")
    return a.join(b).as_df().withColumn("n_nationkey", F.col("n_nationkey").cast(nation(s, d).schema["n_nationkey"].dataType))


# --- values of rows


def nations(s, d):
    return t(s, d, "nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])


@query("SELECT n_nationkey, lower(n_name) AS n_name, 9 AS n_regionkey FROM nation")
def row_update(s, d):
    return nations(s, d).update(n_name=F.lower("n_name"), n_regionkey=9).as_df()


@query("SELECT n_nationkey, n_name, n_regionkey, length(n_name) AS size, 'x' AS mark, CAST(NULL AS VARCHAR) AS _source_mark FROM nation")
def row_with_columns(s, d):
    out = nations(s, d).with_columns({"size": "bigint"}, size=F.length("n_name"), mark="x")
    return out.as_df(source=True).drop("_source_n_name", "_source_n_regionkey", "_source_size")


@query("SELECT n_nationkey, n_name, n_regionkey * 2 AS __twice FROM nation WHERE n_regionkey * 2 > 4")
def row_meta(s, d):
    f = nations(s, d).with_meta(twice=F.col("n_regionkey") * 2, gone=1).drop_meta("gone").select_packets("n_name")
    return f.filter(f.meta("twice") > 4).as_df(meta=True)


@query("SELECT n_nationkey, n_name, 'here' AS _source_n_name, 'night' AS _context_key FROM nation")
def row_source_and_context(s, d):
    f = nations(s, d).select_packets("n_name").with_source_info(n_name="here", absent="no").with_context("night")
    return f.as_df(source=True, context=True)


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS name, length(n_name) AS size, 'new' AS mark FROM nation WHERE n_regionkey = 2")
def row_records(s, d):
    rows = []
    for r in nations(s, d).filter("n_regionkey = 2").iter_records():
        r = r.rename({"n_name": "name"}).update(n_regionkey=len(r["n_name"])).rename({"n_regionkey": "size"}).with_columns(mark="new")
        rows.append(r.with_meta(seen=1).drop_meta("seen").select("n_nationkey", "name", "size", "mark").as_dict())
    return s.createDataFrame(rows, "n_nationkey long, name string, size long, mark string")


@query("SELECT 5 AS n, 5 AS hashes, true AS same, true AS meta_left_out")
def row_content_hash(s, d):
    rows = list(nations(s, d).filter("n_nationkey < 5").iter_records())
    hashes = {r.content_hash().to_string() for r in rows}
    again = {r.copy().content_hash().to_string() for r in rows}
    other = {r.with_meta(x=1).with_context("c").content_hash().to_string() for r in rows}
    return s.createDataFrame([(len(rows), len(hashes), hashes == again, hashes == other)], "n int, hashes int, same boolean, meta_left_out boolean")


# --- hashes and names


@query("SELECT true AS any_order, false AS fewer_rows")
def table_hashes(s, d):
    df = nation(s, d)
    return s.createDataFrame([(table_hash(df) == table_hash(df.orderBy(F.desc("n_name")).select("n_regionkey", "n_name", "n_nationkey")), table_hash(df) == table_hash(df.limit(24)))], "any_order boolean, fewer_rows boolean")


@query("SELECT 'sha256@' || sha256(string_agg(r_name, chr(10) ORDER BY r_name) || chr(10)) AS hash FROM region")
def file_content_hash(s, d):
    path = folder(s, "text")
    s.read.parquet(f"{d}/region.parquet").select("r_name").coalesce(1).sortWithinPartitions("r_name").write.text(path)
    return file_hashes(s, path + "/part-*").select("hash")


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, substr(sha256(CAST(r_regionkey AS VARCHAR)), 1, 20) AS own, substr(sha256('a' || CAST(r_regionkey AS VARCHAR)), 1, 20) AS both FROM region")
def object_hashes(s, d):
    keys = [r[0] for r in s.read.parquet(f"{d}/region.parquet").select("r_regionkey").collect()]
    return s.createDataFrame([(k, hash_object(k).to_hex(), combine_hashes(str(k), "a", order=False) if k is None else combine_hashes("a", str(k))) for k in keys], "r_regionkey long, own string, both string")


@query("SELECT lower(n_name) AS name FROM nation WHERE n_name NOT LIKE '% %'")
def snake_names(s, d):
    return s.createDataFrame([(snake_case(r[0].title()),) for r in nation(s, d, "n_name").where("n_name NOT LIKE '% %'").collect()], "name string")


# --- pods


def raised(o_totalprice: float, by: int = 2) -> float:
    return o_totalprice * by


def optional(n_name: str, n_regionkey: int | None) -> str | None:
    return None if n_regionkey is None else f"{n_name}:{n_regionkey}"


def size_of(path: pathlib.Path) -> int:
    return len(path.read_bytes())


def odd_only(n_regionkey: int) -> int:
    if n_regionkey % 2 == 0:
        raise ValueError(n_regionkey)
    return n_regionkey


def doubled(x: int) -> int:
    return 2 * x


def untyped(n_regionkey, n_name) -> None:
    return n_regionkey, n_name.lower()


@query("SELECT o_orderkey AS orderkey, o_totalprice * 2 AS raised FROM orders")
def pod_default_argument(s, d):
    return FunctionPod(raised, "raised")(orders(s, d).select_packets("o_totalprice")).as_df()


@query("SELECT n_nationkey, CASE WHEN n_regionkey <> 2 THEN n_name || ':' || n_regionkey END AS text FROM nation")
def pod_optional(s, d):
    df = nation(s, d).withColumn("n_regionkey", F.expr("nullif(n_regionkey, 2)"))
    return FunctionPod(optional, "text")(TagFrame.of(df, "n_nationkey")).as_df()


@query("SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS region, lower(n_name) AS name FROM nation")
def pod_given_types(s, d):
    pod = FunctionPod(untyped, ["region", "name"], input_schema={"n_regionkey": int, "n_name": str}, output_schema=[int, str])
    return pod(nations(s, d)).as_df()


@query("SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS odd FROM nation WHERE n_regionkey % 2 = 1")
def pod_warn(s, d):
    return FunctionPod(odd_only, "odd", error_handling="warn")(nations(s, d).select_packets("n_regionkey")).as_df()


@query("SELECT count(*) AS n, count(DISTINCT o_totalprice) AS records FROM orders")
def pod_provenance(s, d):
    out = FunctionPod(lambda_free_price, "cents")(orders(s, d).select_packets("o_totalprice")).as_df(source=True)
    parts = F.split("_source_cents", "::")
    named = out.select(parts[0].alias("pod"), parts[1].alias("record"), parts[2].alias("output")).where("pod LIKE 'lambda_free_price:%:v0' AND output = 'cents'")
    return named.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record").alias("records"))


@query("SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS odd, 'renamed' AS label FROM nation WHERE n_regionkey % 2 = 1")
def pod_wrapped(s, d):
    pod = WrappedPod(FunctionPod(odd_only, "odd", error_handling="ignore"), "renamed")
    p, f = Pipeline("wrapped", store(s)), nations(s, d).select_packets("n_regionkey")
    with p:
        pod(f)
    p.run()
    (label,) = p.nodes
    return p.renamed.frame.as_df().withColumn("label", F.lit(label))


@query("SELECT count(DISTINCT o_totalprice) AS n, 'box' AS engine, 'night' AS context, true AS tiers FROM orders")
def memo_record_layout(s, d):
    st = store(s)
    pod = CachedPod(FunctionPod(lambda_free_price, "cents", engine="box"), st)
    pod(orders(s, d).select_packets("o_totalprice").with_context("night"))
    rows = st.all_records(pod.path, META + "packet_id")
    tiers = all(f"{META}pod_id_{k}" in rows.columns for k in ("version", "signature", "content", "git"))
    return rows.where("_source_cents IS NOT NULL").groupBy(F.col(ENGINE).alias("engine"), F.col("_context_key").alias("context")).agg(F.count(F.lit(1)).alias("n")).withColumn("tiers", F.lit(tiers))


@query("SELECT 0 AS of_other_version, count(DISTINCT o_totalprice) AS of_this FROM orders")
def memo_match_tier(s, d):
    st, f = store(s), orders(s, d).select_packets("o_totalprice")
    CachedPod(FunctionPod(lambda_free_price, "cents", version="v0.1"), st)(f)
    n = [CachedPod(FunctionPod(lambda_free_price, "cents", version=v), st, match_tier="version").stored().count() for v in ("v0.2", "v0.1")]
    return s.createDataFrame([tuple(n)], "of_other_version int, of_this long")


@query("SELECT 1 AS at, CAST(3 AS BIGINT) AS size UNION ALL SELECT 2, 5")
def memo_path_content(s, d):
    """The file behind a path changes: its result is computed anew."""
    path, sizes = folder(s, "file").removeprefix("file:"), []
    pod = CachedPod(FunctionPod(size_of, "size"), store(s))
    for at, text in ((1, "abc"), (2, "abcde")):
        pathlib.Path(path).parent.mkdir(parents=True, exist_ok=True)
        pathlib.Path(path).write_text(text)
        f = TagFrame.of(s.createDataFrame([(1, (path,))], "k int, path struct<path:string>"), "k")
        sizes.append((at, pod(f).as_df().first()["size"]))
    return s.createDataFrame(sizes, "at int, size long")


# --- graphs, live frames, streams


@query("SELECT n_nationkey, CAST(2 * n_regionkey AS BIGINT) AS y, CASE WHEN n_nationkey < 10 THEN 'doubled_1' ELSE 'doubled_2' END AS label FROM nation")
def node_same_schema(s, d):
    """Two unnamed inputs of one schema are two inputs."""
    df = nation(s, d).selectExpr("n_nationkey", "n_regionkey AS x")
    p = Pipeline("same", store(s))
    with p:
        pod = FunctionPod(doubled, "y")
        pod(TagFrame.of(df.where("n_nationkey < 10"), "n_nationkey"))
        pod(TagFrame.of(df.where("n_nationkey >= 10"), "n_nationkey"))
    p.run()
    a, b = (n.frame.as_df().withColumn("label", F.lit(label)) for label, n in p.nodes.items())
    return a.unionByName(b)


@query("SELECT n_nationkey, CAST(2 * n_regionkey AS BIGINT) AS y FROM nation WHERE n_nationkey < 12")
def node_run_filtered(s, d):
    p = Pipeline("filtered", store(s))
    with p:
        FunctionPod(doubled, "y")(nations(s, d).select_packets("n_regionkey").map_packets({"n_regionkey": "x"}))
    p.run("n_nationkey < 12", only="doubled")
    return p.records("doubled").select("n_nationkey", "y")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3")
def kernel_records(s, d):
    st = store(s)
    p = Pipeline("kernels", st)
    with p:
        nations(s, d).filter("n_regionkey = 3").select_packets("n_name")
    p.run(record_kernels=True)
    return st.all_records(p.path(p.SelectPacketColumns)).select("n_nationkey", "n_name")


@query("SELECT 'Filter' AS label, 0 AS pod, 1 AS inputs UNION ALL SELECT 'twice', 1, 1 UNION ALL SELECT 'MapPackets', 0, 1")
def graph_nodes(s, d):
    p = Pipeline("graph", store(s))
    with p:
        FunctionPod(doubled, "y")(nations(s, d).filter("n_regionkey = 3").map_packets({"n_regionkey": "x"}))
    p.rename("doubled", "twice")
    return s.createDataFrame([(label, int(n.is_pod), len(n.inputs)) for label, n in p.nodes.items() if f'"{label}"' in p.to_dot()], "label string, pod int, inputs int")


@query("SELECT 10 AS before, true AS stale, 25 AS after, true AS rebuilt")
def live_frame(s, d):
    df = nation(s, d, "n_nationkey", "n_name")
    source = ManualTableSource(s, folder(s, "manual"), df.schema, "n_nationkey", registry=None)
    source.insert(df.where("n_nationkey < 10"))
    near = LiveFrame(lambda f: f.filter("n_nationkey >= 0"), source)
    far = LiveFrame(lambda f: f.map_packets({"n_name": "name"}), near)
    before = far.frame.as_df().count()
    source.insert(df, skip_duplicates=True)
    stale = not far.is_current and not near.is_current
    return s.createDataFrame([(before, stale, far.frame.as_df().count(), far.is_current)], "before int, stale boolean, after int, rebuilt boolean")


@query("SELECT CAST(n_nationkey % 5 AS BIGINT) AS x, CAST(2 * (n_nationkey % 5) AS BIGINT) AS y FROM nation GROUP BY 1, 2")
def stream_memo(s, d):
    """A remembering pod over micro-batches: equal packets of any batch are computed once."""
    path, pod = folder(s, "stream"), CachedPod(FunctionPod(doubled, "y"), store(s))
    df = nation(s, d).selectExpr("n_nationkey", "n_nationkey % 5 AS x")
    df.repartition(3).write.parquet(path)
    stream = s.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream_pod(stream, "n_nationkey", pod, folder(s, "progress")).awaitTermination()
    return pod.stored().select((F.col("y") / 2).cast("long").alias("x"), "y")
