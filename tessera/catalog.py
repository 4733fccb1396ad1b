"""The registered queries of the engine and their DuckDB equivalents.

Each entry states the query in the engine's own language; the SQL beside it is
written independently.  Sums and averages of doubles are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import QueryError
from .facade import Facade
from .functions import crypto
from .model import Field, Model
from .operators import actions, integrity, sync, writes
from .sources import readers
from .sources.space import Space
from .tables import ARRAYS, CUSTOMER, MODELS, VERSIONED, space

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Space], DataFrame]], Callable[[Space], DataFrame]]:
    """Registers a function of a space under a name, with its SQL."""
    def add(f: Callable[[Space], DataFrame]) -> Callable[[Space], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: flat(f(space(spark, sf_dir)))
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def find(name: str, table: str, q: dict, sql: str) -> None:
    query(name, sql)(lambda s: s.table(table).find_many(q))


def url(name: str, table: str, text: str, sql: str) -> None:
    query(name, sql)(lambda s: Facade(s, table).query(text))


def _joined(names: list[str]) -> Callable:
    return lambda x: F.concat_ws(":", *[x[n].cast("string") for n in names])


def flat(df: DataFrame) -> DataFrame:
    """Nested columns in a form that compares alike everywhere: objects as ``column_field``, lists as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType):
            out += [c[x].alias(f"{f.name}_{x}") for x in f.dataType.names]
        elif isinstance(f.dataType, T.ArrayType):
            element = f.dataType.elementType
            item = _joined(element.names) if isinstance(element, T.StructType) else None
            out.append(F.concat_ws(",", F.transform(c, item or (lambda x: x.cast("string")))).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def as_text(df: DataFrame, *names: str) -> DataFrame:
    """Columns as text, so that nulls among integers compare alike everywhere."""
    return df.withColumns({n: F.col(f"`{n}`").cast("string") for n in names})


def rounded(df: DataFrame, *names: str, digits: int = 2) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


# Scans and projections ---------------------------------------------------
find("scan_project", "customer", {"controls": {"$select": ["c_custkey", "c_name"]}}, "SELECT c_custkey, c_name FROM customer")
find("select_map", "customer", {"controls": {"$select": {"c_custkey": 1, "c_acctbal": 1}}}, "SELECT c_custkey, c_acctbal FROM customer")
find("select_exclude", "supplier", {"controls": {"$select": ["-s_name", "-s_acctbal"]}}, "SELECT s_suppkey, s_nationkey FROM supplier")
find("select_exclude_map", "supplier", {"controls": {"$select": {"s_name": 0}}}, "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
find("select_all", "region", {}, "SELECT r_regionkey, r_name FROM region")
find("select_with_keys", "customer", {"controls": {"$select": ["c_custkey"], "$with": [{"name": "nation", "controls": {"$select": ["n_name"]}}]}}, "SELECT c_custkey, c_nationkey, n_name AS nation_n_name, n_nationkey AS nation_n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey")


@query("select_nested", "SELECT doc_id, lang AS info_lang FROM documents")
def _select_nested(s: Space) -> DataFrame:
    nested = s.table("documents").frame().select("doc_id", F.struct("lang", "source").alias("info"))
    model = Model("n", (Field("doc_id", "int64", pk=True), Field("info", fields=(Field("lang"), Field("source")))))
    return s.add(model, nested).find_many({"controls": {"$select": ["doc_id", "info.lang"]}})


@query("select_nested_exclude", "SELECT doc_id, source AS info_source FROM documents WHERE lang = 'en'")
def _select_nested_exclude(s: Space) -> DataFrame:
    nested = s.table("documents").frame().select("doc_id", F.struct("lang", "source").alias("info"))
    model = Model("n", (Field("doc_id", "int64", pk=True), Field("info", fields=(Field("lang"), Field("source")))))
    return s.add(model, nested).find_many({"filter": {"info.lang": "en"}, "controls": {"$select": {"info.lang": 0}}})


@query("flattened_read", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name END AS account_name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS account_balance FROM supplier")
def _flattened(s: Space) -> DataFrame:
    rich = F.col("s_acctbal") > 0
    flat = s.table("supplier").frame().select("s_suppkey", F.when(rich, F.col("s_name")).alias("account__name"), F.when(rich, F.col("s_acctbal")).alias("account__balance"))
    model = Model("f", (Field("s_suppkey", "int64", pk=True), Field("account", optional=True, fields=(Field("name", optional=True), Field("balance", "double", optional=True)))), flattened=True)
    return s.add(model, flat).find_many({})


@query("renamed_column", "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_name LIKE 'red%'")
def _renamed(s: Space) -> DataFrame:
    model = Model("r", (Field("id", "int64", pk=True, column="p_partkey"), Field("title", column="p_name")))
    return s.add(model, s.table("part").frame().select("p_partkey", "p_name")).find_many({"filter": {"title": {"$regex": "^red"}}})


@query("json_column", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _json_column(s: Space) -> DataFrame:
    return s.table("events").frame().select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("provider_table", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 10")
def _provider(s: Space) -> DataFrame:
    model = Model("p", (Field("n_nationkey", "int32", pk=True), Field("n_name")))
    return s.add_provider(model, lambda: s.table("nation").frame().select("n_nationkey", "n_name")).find_many({"filter": {"n_nationkey": {"$gte": 10}}})


query("dictionary_search", "SELECT r_regionkey, r_name FROM region WHERE contains(lower(r_name), 'a')")(lambda s: readers.dictionary_search(s.table("region").frame(), ["r_name"], "A"))

# Filters ------------------------------------------------------------------
_O = "SELECT o_orderkey FROM orders WHERE "
for _name, _filter, _where in (
    ("filter_eq", {"o_orderstatus": "F"}, "o_orderstatus = 'F'"),
    ("filter_ne", {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus <> 'F'"),
    ("filter_range", {"o_totalprice": {"$gte": 100000, "$lt": 200000}}, "o_totalprice >= 100000 AND o_totalprice < 200000"),
    ("filter_gt_lte", {"o_totalprice": {"$gt": 250000.5}, "o_custkey": {"$lte": 700}}, "o_totalprice > 250000.5 AND o_custkey <= 700"),
    ("filter_in", {"o_orderpriority": {"$in": ["1-URGENT", "5-LOW"]}}, "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    ("filter_nin", {"o_orderpriority": {"$nin": ["1-URGENT", "5-LOW"]}}, "o_orderpriority NOT IN ('1-URGENT', '5-LOW')"),
    ("filter_in_empty", {"o_orderpriority": {"$in": []}}, "false"),
    ("filter_nin_empty", {"o_orderpriority": {"$nin": []}}, "true"),
    ("filter_in_long", {"o_custkey": {"$in": list(range(0, 2400, 2))}}, "o_custkey % 2 = 0 AND o_custkey < 2400"),
    ("filter_time", {"o_orderdate": {"$gte": "1998-01-01", "$lt": "1999-01-01"}}, "o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'"),
    ("filter_time_millis", {"o_orderdate": {"$gte": 946684800000}}, "o_orderdate >= TIMESTAMP '2000-01-01'"),
    ("filter_and_or_not", {"$or": [{"o_orderstatus": "P"}, {"$and": [{"o_totalprice": {"$gt": 300000}}, {"$not": {"o_orderpriority": "5-LOW"}}]}]}, "o_orderstatus = 'P' OR (o_totalprice > 300000 AND NOT o_orderpriority = '5-LOW')"),
    ("filter_empty_and", {"$and": []}, "true"),
    ("filter_empty_or", {"$or": []}, "false"),
    ("filter_regex", {"o_orderpriority": {"$regex": "^[12]-"}}, "regexp_matches(o_orderpriority, '^[12]-')"),
    ("filter_regex_flags", {"o_orderpriority": {"$regex": "/not spec/i"}}, "regexp_matches(o_orderpriority, '(?i)not spec')"),
):
    find(_name, "orders", {"filter": _filter, "controls": {"$select": ["o_orderkey"]}}, _O + _where)
find("filter_nocase", "customer", {"filter": {"c_mktsegment": "building"}, "controls": {"$select": ["c_custkey"]}}, "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
_L = "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE "
for _name, _filter, _where in (
    ("filter_exists", {"quality": {"$exists": True}}, "quality IS NOT NULL"),
    ("filter_null_eq", {"quality": None}, "quality IS NULL"),
    ("filter_null_ne", {"quality": {"$ne": None}}, "quality IS NOT NULL"),
    ("filter_ne_sql", {"quality": {"$ne": 1}}, "quality <> 1"),
    ("filter_nin_sql", {"quality": {"$nin": [1]}}, "quality NOT IN (1)"),
    ("filter_not_sql", {"$not": {"quality": 1}}, "NOT quality = 1"),
):
    find(_name, "labelled", {"filter": _filter, "controls": {"$select": ["doc_id"]}}, _L + _where)


def _document_model(name: str, filter: dict, where: str) -> None:
    def run(s: Space) -> DataFrame:
        table = s.table("labelled")
        table.null_model = "document"
        return table.find_many({"filter": filter, "controls": {"$select": ["doc_id"]}})

    query(name, _L + where)(run)


_document_model("filter_ne_document", {"quality": {"$ne": 1}}, "quality IS DISTINCT FROM 1")
_document_model("filter_nin_document", {"quality": {"$nin": [1]}}, "quality IS NULL OR quality <> 1")
_document_model("filter_in_null_document", {"quality": {"$in": [0, None]}}, "quality IS NULL OR quality = 0")
_document_model("filter_not_document", {"$not": {"quality": 1}}, "NOT coalesce(quality = 1, false)")


# Sorting, paging, identification -------------------------------------------
find("sort_skip_limit", "orders", {"controls": {"$sort": {"o_orderstatus": 1, "o_totalprice": -1}, "$skip": 20, "$limit": 30}}, "SELECT * FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 20")
query("sort_nulls_low", "SELECT d.doc_id, lang, CAST(quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels ON d.doc_id = labels.doc_id ORDER BY labels.quality NULLS FIRST, d.doc_id LIMIT 40")(lambda s: as_text(s.table("labelled").find_many({"controls": {"$sort": {"quality": 1}, "$limit": 40}}), "quality"))
query("page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")(lambda s: s.table("orders").pages({"controls": {"$sort": "-o_totalprice", "$page": 3, "$size": 25, "$select": ["o_orderkey", "o_totalprice"]}})["data"])
query("find_one", "SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice, o_orderkey LIMIT 1")(lambda s: s.table("orders").find_one({"filter": {"o_orderstatus": "P"}, "controls": {"$sort": {"o_totalprice": 1}}}))
query("count_rows", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'P'")(lambda s: s.table("orders").count({"filter": {"o_orderstatus": "P"}}))
query("find_by_id", "SELECT * FROM orders WHERE o_orderkey = 4711")(lambda s: s.table("orders").find_by_id("4711"))
query("find_by_compound", "SELECT * FROM conversations WHERE conv_id = 3 AND turn = 1")(lambda s: s.table("conversations").find_by_id({"conv_id": 3, "turn": 1}))
query("find_by_unique", "SELECT * FROM nation WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 7)")(lambda s: s.table("nation").find_by_id(s.table("nation").find_by_id(7).first()["n_name"]))

# Aggregation -----------------------------------------------------------------
def _agg(name: str, table: str, q: dict, sql: str, *numbers: str) -> None:
    query(name, sql)(lambda s: rounded(s.table(table).aggregate(q), *numbers))


def fn(f: str, name: str, alias: str | None = None) -> dict:
    return {"$fn": f, "$field": name} | ({"$as": alias} if alias else {})


_G = {"$groupBy": ["l_returnflag", "l_linestatus"]}
_agg("agg_sum", "lineitem", {"controls": {"$groupBy": ["l_returnflag"], "$select": ["l_returnflag", fn("sum", "l_quantity")]}}, "SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem GROUP BY l_returnflag", "sum_l_quantity")
_agg("agg_avg", "lineitem", {"controls": {"$groupBy": ["l_returnflag"], "$select": ["l_returnflag", fn("avg", "l_quantity", "mean")]}}, "SELECT l_returnflag, round(avg(l_quantity), 2) AS mean FROM lineitem GROUP BY l_returnflag", "mean")
_agg("agg_count_star", "lineitem", {"controls": {"$groupBy": ["l_linestatus"], "$select": ["l_linestatus", fn("count", "*", "n")]}}, "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY l_linestatus")
_agg("agg_count_field", "labelled", {"controls": {"$groupBy": ["lang"], "$select": ["lang", fn("count", "quality")]}}, "SELECT lang, count(quality) AS count_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
_agg("agg_min_max", "orders", {"controls": {"$groupBy": ["o_orderpriority"], "$select": ["o_orderpriority", fn("min", "o_totalprice", "least"), fn("max", "o_orderdate", "latest")]}}, "SELECT o_orderpriority, min(o_totalprice) AS least, max(o_orderdate) AS latest FROM orders GROUP BY o_orderpriority")
_agg("agg_multi_key", "lineitem", {"controls": {**_G, "$select": ["l_returnflag", "l_linestatus", fn("sum", "l_extendedprice", "gross"), fn("count", "*", "n")]}}, "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS gross, count(*) AS n FROM lineitem GROUP BY ALL", "gross")
_agg("agg_global", "orders", {"controls": {"$select": [fn("sum", "o_totalprice", "total"), fn("count", "*", "n")]}}, "SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders", "total")
_agg("agg_dims_only", "lineitem", {"controls": _G}, "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_agg("agg_having", "orders", {"controls": {"$groupBy": ["o_custkey"], "$select": ["o_custkey", fn("count", "*", "n"), fn("sum", "o_totalprice", "total")], "$having": {"n": {"$gte": 12}, "$not": {"total": {"$lt": 1000000}}}}}, "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND NOT sum(o_totalprice) < 1000000", "total")
_agg("agg_sort_paged", "orders", {"controls": {"$groupBy": ["o_custkey"], "$select": ["o_custkey", fn("count", "*", "n")], "$sort": {"n": -1, "o_custkey": 1}, "$skip": 5, "$limit": 20}}, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20 OFFSET 5")
_agg("agg_group_count", "orders", {"controls": {"$groupBy": ["o_custkey"], "$count": True}}, "SELECT count(DISTINCT o_custkey) AS count FROM orders")
_agg("agg_group_count_having", "orders", {"controls": {"$groupBy": ["o_custkey"], "$select": [fn("count", "*", "n")], "$having": {"n": {"$gt": 10}}, "$count": True}}, "SELECT count(*) AS count FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 10)")
_agg("agg_prefilter", "events", {"filter": {"value": {"$gt": 20}}, "controls": {"$groupBy": ["event_type"], "$select": ["event_type", fn("sum", "value", "total"), fn("count", "*", "n")]}}, "SELECT event_type, round(sum(value), 2) AS total, count(*) AS n FROM events WHERE value > 20 GROUP BY event_type", "total")
_agg("agg_hidden_key", "lineitem", {"controls": {**_G, "$select": ["l_returnflag", fn("count", "*", "n")]}}, "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
_agg("agg_strict", "sales", {"controls": {"$groupBy": ["l_linestatus"], "$select": ["l_linestatus", fn("sum", "l_extendedprice", "gross")]}}, "SELECT l_linestatus, round(sum(l_extendedprice), 2) AS gross FROM lineitem GROUP BY l_linestatus", "gross")

# Views -------------------------------------------------------------------------
_V = "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"
find("view_join", "customer_nation", {}, _V)
find("view_multi_join", "customer_region", {}, "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
query("view_left", "SELECT d.doc_id, lang, CAST(quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(lambda s: as_text(s.table("document_labels").find_many({}), "quality"))
find("view_theta", "richer_suppliers", {}, "SELECT r_name, s_suppkey FROM region JOIN supplier ON s_nationkey > r_regionkey AND s_acctbal > 5000")
find("view_filter", "urgent_orders", {}, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT o_orderstatus = 'P' AND o_orderdate IS NOT NULL")
_SALES = """SELECT c_mktsegment, o_orderstatus, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders, round(avg(o_totalprice), 2) AS avg_price
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 AND o_orderstatus <> 'X' GROUP BY c_mktsegment, o_orderstatus HAVING count(*) >= 2"""


def _flagship(s: Space) -> DataFrame:
    return rounded(s.table("segment_sales").find_many({"controls": {"$sort": {"revenue": -1}}}), "revenue", "avg_price")


query("view_agg_having", _SALES)(_flagship)
query("view_agg_global", "SELECT count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")(lambda s: s.table("order_totals").find_many({}))
find("view_queried", "customer_region", {"filter": {"r_name": {"$in": ["ASIA", "EUROPE"]}}, "controls": {"$sort": {"c_custkey": -1}, "$limit": 50}}, "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') ORDER BY c_custkey DESC LIMIT 50")
query("view_field_to_field", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount > l_tax")(lambda s: _field_to_field(s))


def _field_to_field(s: Space) -> DataFrame:
    from .model import View, ViewColumn

    columns = tuple(ViewColumn(c, f"lineitem.{c}") for c in ("l_orderkey", "l_linenumber", "l_partkey"))
    return s.add_view(View("discounted", columns, "lineitem", filter={"lineitem.l_discount": {"$gt": "lineitem.l_tax"}})).find_many({})


@query("view_external", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice < 5000")
def _external(s: Space) -> DataFrame:
    from .model import View

    s.table("orders").frame().where("o_totalprice < 5000").select("o_orderkey", "o_orderstatus").createOrReplaceTempView("tessera_cheap_orders")
    return s.add_view(View("tessera_cheap_orders")).find_many({})


# Relations -----------------------------------------------------------------------
def _with(table: str, specs: list, select: list[str] | None = None) -> Callable[[Space], DataFrame]:
    return lambda s: s.table(table).find_many({"controls": {"$with": specs} | ({"$select": select} if select else {})})


query("with_to", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")(lambda s: _with("orders", ["customer"])(s).select("o_orderkey", "customer.c_name", "customer.c_mktsegment"))
query("with_to_null", "SELECT d.doc_id, CAST(quality AS VARCHAR) AS label_quality, CAST(toxic AS VARCHAR) AS label_toxic, CAST(l.doc_id AS VARCHAR) AS label_doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(lambda s: as_text(flat(_with("documents", [{"name": "label", "controls": {"$select": ["quality", "toxic"]}}], ["doc_id"])(s)), "label_quality", "label_toxic", "label_doc_id"))
query("with_from_array", "SELECT c_custkey, array_to_string(coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL), []), ',') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")(lambda s: _with("customer", ["orders"])(s).select("c_custkey", F.transform("orders", lambda o: o["o_orderkey"]).alias("keys")))
query("with_from_empty", "SELECT c_custkey, array_to_string(coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_totalprice > 400000), []), ',') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")(lambda s: _with("customer", [{"name": "orders", "filter": {"o_totalprice": {"$gt": 400000}}}])(s).select("c_custkey", F.transform("orders", lambda o: o["o_orderkey"]).alias("keys")))
query("with_from_single", "SELECT c_custkey, min(o_orderkey) AS first FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")(lambda s: _with("customer", ["order"])(s).select("c_custkey", F.col("order.o_orderkey").alias("first")))
query("with_from_topn", """SELECT c_custkey, array_to_string(coalesce(list(o_orderkey ORDER BY r) FILTER (WHERE r BETWEEN 2 AND 3), []), ',') AS keys FROM customer LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey GROUP BY c_custkey""")(lambda s: _with("customer", [{"name": "orders", "controls": {"$sort": {"o_totalprice": -1}, "$skip": 1, "$limit": 2}}])(s).select("c_custkey", F.transform("orders", lambda o: o["o_orderkey"]).alias("keys")))
query("with_via", "SELECT o_orderkey, array_to_string(coalesce(list(p_partkey ORDER BY p_partkey) FILTER (WHERE p_partkey IS NOT NULL), []), ',') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey")(lambda s: _with("orders", ["parts"])(s).select("o_orderkey", F.transform("parts", lambda p: p["p_partkey"]).alias("parts")))
query("with_composite", "SELECT t.conv_id, t.turn, p.role AS before_role FROM conversations t LEFT JOIN conversations p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1 AND t.turn > 0")(lambda s: _with("turns", ["before"])(s).select("conv_id", "turn", F.col("before.role").alias("before_role")))
query("with_nested", "SELECT r_regionkey, n_nationkey, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")(
    lambda s: _with("region", [{"name": "nations", "controls": {"$with": [{"name": "customers", "controls": {"$select": ["c_custkey"]}}]}}])(s)
    .select("r_regionkey", F.explode("nations").alias("n")).select("r_regionkey", "n.n_nationkey", F.size("n.customers").cast("long").alias("customers"))
)
query("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)")(lambda s: _semi(s, "left_semi"))
query("anti_missing", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)")(lambda s: _semi(s, "left_anti"))


def ordered(df: DataFrame) -> DataFrame:
    """The rows of one short page with their numbers in the order they come, so that a comparison of sets checks the order."""
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(df.collect(), 1)], T.StructType([T.StructField("n", T.LongType()), *df.schema.fields]))


_TOP = {"$sort": "-o_totalprice", "$limit": 50}
query("sort_order", "SELECT row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS n, o_orderkey FROM orders QUALIFY n <= 60")(lambda s: ordered(s.table("orders").find_many({"controls": {"$sort": {"o_orderstatus": 1, "o_totalprice": -1}, "$limit": 60, "$select": ["o_orderkey"]}})))
query("with_sorted", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n, o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey QUALIFY n <= 50")(
    lambda s: ordered(s.table("orders").find_many({"controls": {**_TOP, "$with": ["customer", "lines"]}}).select("o_orderkey", F.col("customer.c_name").alias("c_name")))
)
find("filter_int_text", "orders", {"filter": {"o_orderkey": "4711"}, "controls": {"$select": ["o_orderkey"]}}, "SELECT o_orderkey FROM orders WHERE o_orderkey = 4711")


@query("with_hidden", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_custkey AS customer_c_custkey, c_nationkey AS customer_c_nationkey, c_acctbal AS customer_c_acctbal, c_mktsegment AS customer_c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey < 500")
def _with_hidden(s: Space) -> DataFrame:
    s.add(CUSTOMER.with_fields(c_name=Field("c_name", write_only=True)))
    return s.table("orders").find_many({"filter": {"o_orderkey": {"$lt": 500}}, "controls": {"$with": ["customer"]}})


def _semi(s: Space, how: str) -> DataFrame:
    orders = s.table("orders").filtered({"filter": {"o_orderstatus": "F", "o_totalprice": {"$gt": 300000}}})
    customers = s.table("customer").frame()
    return customers.join(orders, customers["c_custkey"] == orders["o_custkey"], how).select("c_custkey")


# Searches --------------------------------------------------------------------------
_T = "WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w, regexp_extract_all(lower(coalesce(source, '')), '[\\p{L}\\p{N}]+') AS v FROM documents) "
query("search_all", _T + "SELECT doc_id, CAST(len(list_filter(w, lambda x: x IN ('the', 'tion'))) + 5 * len(list_filter(v, lambda x: x IN ('the', 'tion'))) AS DOUBLE) AS score FROM t WHERE list_contains(w || v, 'the') AND list_contains(w || v, 'tion')")(lambda s: s.table("documents").search("The TION").select("doc_id", F.col("_score").alias("score")))
query("search_any", _T + "SELECT doc_id FROM t WHERE list_contains(w || v, 'src3') OR list_contains(w || v, 'tion')")(lambda s: s.table("documents").search("src3, tion!", mode="any").select("doc_id"))
query("search_ranked", _T + "SELECT doc_id, CAST(len(list_filter(w, lambda x: x = 'of')) + 5 * len(list_filter(v, lambda x: x = 'of')) AS DOUBLE) AS score FROM t WHERE list_contains(w || v, 'of') ORDER BY score DESC, doc_id LIMIT 30")(lambda s: s.table("documents").search("of", {"controls": {"$limit": 30}}).select("doc_id", F.col("_score").alias("score")))
query("search_prefix", _T + "SELECT doc_id FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'tionth'))) > 0")(lambda s: s.table("documents").search("tionth", index="text_prefix").select("doc_id"))
query("search_order", _T + "SELECT row_number() OVER (ORDER BY len(list_filter(w, lambda x: x = 'of')) + 5 * len(list_filter(v, lambda x: x = 'of')) DESC, doc_id) AS n, doc_id FROM t WHERE list_contains(w || v, 'of') QUALIFY n <= 40")(lambda s: ordered(s.table("documents").search("of", {"controls": {"$limit": 40, "$select": ["doc_id"]}}).select("doc_id")))
query("search_fuzzy", _T + "SELECT doc_id, CAST(len(list_filter(w, lambda x: levenshtein(x, 'off') <= 1)) AS DOUBLE) AS _score FROM t WHERE len(list_filter(w, lambda x: levenshtein(x, 'off') <= 1 OR starts_with(x, 'off'))) > 0")(lambda s: s.table("documents").search("off", index="text_both").select("doc_id", "_score"))
query("search_pages_count", _T + "SELECT count(*) AS count FROM t WHERE list_contains(w || v, 'of')")(lambda s: s.spark.createDataFrame([(Facade(s, "documents").pages("$search=of")["count"],)], "count long"))
query("search_group", _T + "SELECT lang, count(*) AS n FROM t JOIN documents USING (doc_id) WHERE list_contains(w || v, 'of') GROUP BY lang")(lambda s: Facade(s, "documents").query("$search=of&$groupBy=lang&$select=lang,count(*):n"))
query("search_blank", "SELECT doc_id FROM documents WHERE false")(lambda s: s.table("documents").search(" ?! ").select("doc_id"))
query("search_filtered", _T + "SELECT doc_id FROM t JOIN documents USING (doc_id) WHERE lang = 'en' AND list_contains(w || v, 'of')")(lambda s: s.table("documents").search("of", {"filter": {"lang": "en"}}).select("doc_id"))
query("search_count", _T + "SELECT count(*) AS count FROM t WHERE list_contains(w || v, 'of')")(lambda s: s.table("documents").search_count("of"))
query("search_fallback", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ing') OR contains(lower(p_type), 'ing')")(lambda s: s.table("part").search_plain("ING").select("p_partkey"))


def vector(n: int = 64) -> list[float]:
    """The query vector of the examples."""
    return [((i * 37) % 11 - 5) / 10 for i in range(n)]


_Q = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in vector()) + "]"
_E = f"WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {_Q} AS q FROM embeddings), d AS (SELECT *, 1 - list_cosine_similarity(v, q) AS c, list_distance(v, q) AS l2, -list_inner_product(v, q) AS ip FROM e) "


def _metric(s: Space, metric: str):
    from dataclasses import replace

    model = s.table("embeddings").model
    s.table("embeddings").model = model.with_fields(embedding=replace(model.find("embedding"), metric=metric))
    return s.table("embeddings")


def _vectors(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("_distance", 6).alias("distance"))


query("vector_cosine", _E + "SELECT vec_id, round(c, 6) AS distance FROM d ORDER BY c, vec_id LIMIT 20")(lambda s: _vectors(_metric(s, "cosine").vector_search(vector())))
query("vector_l2", _E + "SELECT vec_id, round(l2, 6) AS distance FROM d ORDER BY l2, vec_id LIMIT 15")(lambda s: _vectors(_metric(s, "euclidean").vector_search(vector(), {"controls": {"$limit": 15}})))
query("vector_dot", _E + "SELECT vec_id, round(ip, 6) AS distance FROM d ORDER BY ip, vec_id LIMIT 20 OFFSET 5")(lambda s: _vectors(_metric(s, "dotProduct").vector_search(vector(), {"controls": {"$skip": 5, "$limit": 20}})))
query("vector_threshold", _E + "SELECT vec_id, round(c, 6) AS distance FROM d WHERE c <= 2 * (1 - 0.55) ORDER BY c, vec_id LIMIT 1000")(lambda s: _vectors(_metric(s, "cosine").vector_search(vector(), {"controls": {"$threshold": 0.55, "$limit": 1000}})))
query("vector_prefilter", _E + "SELECT vec_id, round(c, 6) AS distance FROM d WHERE label = 2 ORDER BY c, vec_id LIMIT 20")(lambda s: _vectors(_metric(s, "cosine").vector_search(vector(), {"filter": {"label": 2}})))
query("vector_count", _E + "SELECT count(*) AS count FROM d WHERE c <= 2 * (1 - 0.5)")(lambda s: _metric(s, "cosine").vector_count(vector(), {"controls": {"$threshold": 0.5}}))

_P = """WITH p AS (SELECT c_custkey AS id, CAST(c_custkey * 7 % 360 - 180 AS DOUBLE) AS x, CAST(c_custkey * 13 % 180 - 90 AS DOUBLE) AS y FROM customer WHERE c_custkey % 10 <> 0),
d AS (SELECT *, 12742000 * asin(least(1, sqrt(pow(sin(radians(y - 48.1) / 2), 2) + cos(radians(y)) * cos(radians(48.1)) * pow(sin(radians(x - 11.5) / 2), 2)))) AS m FROM p) """


def _places(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("`$distance`", 1).alias("metres"))


query("geo_search", _P + "SELECT id, round(m, 1) AS metres FROM d ORDER BY m, id LIMIT 40")(lambda s: _places(s.table("places").geo_search([11.5, 48.1], {"controls": {"$limit": 40}})))
query("geo_window", _P + "SELECT id, round(m, 1) AS metres FROM d WHERE m BETWEEN 500000 AND 3000000")(lambda s: _places(s.table("places").geo_search([11.5, 48.1], {"controls": {"$minDistance": 500000, "$maxDistance": 3000000}})))
query("geo_within", _P + "SELECT id FROM d WHERE NOT m <= 4000000")(lambda s: s.table("places").find_many({"filter": {"$not": {"point": {"$geoWithin": {"center": [11.5, 48.1], "radius": 4000000}}}}}).select("id"))
query("geo_count", _P + "SELECT count(*) AS count FROM d WHERE m <= 5000000")(lambda s: s.table("places").geo_count([11.5, 48.1], {"controls": {"$maxDistance": 5000000}}))
query("geo_url", _P + "SELECT id, round(m, 1) AS metres FROM d WHERE m <= 6000000 AND id > 100")(lambda s: _places(Facade(s, "places").geo("id>100&$center=11.5,48.1&$maxDistance=6000000&$limit=none")))

# Writes ------------------------------------------------------------------------------
_NEW = [{"c_custkey": -1, "c_name": "new one", "c_nationkey": 3, "c_acctbal": 10.5, "c_mktsegment": "BUILDING"}, {"c_custkey": -2, "c_name": "new two", "c_nationkey": 4, "c_acctbal": 0.0, "c_mktsegment": "MACHINERY"}]
query("insert_rows", "SELECT * FROM customer UNION ALL SELECT * FROM (VALUES (-1, 'new one', 3, 10.5, 'BUILDING'), (-2, 'new two', 4, 0.0, 'MACHINERY'))")(lambda s: s.table("customer").insert(_NEW))


@query("insert_increment", "SELECT n_nationkey AS id, n_name AS name, 'plain' AS kind FROM nation UNION ALL SELECT 100, 'x', 'plain' UNION ALL SELECT 101, 'y', 'plain'")
def _increment(s: Space) -> DataFrame:
    model = Model("inc", (Field("id", "int32", pk=True, default_fn="increment", start=100), Field("name"), Field("kind", default="plain")))
    table = s.add(model, s.table("nation").frame().select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("plain").alias("kind")))
    return table.insert([{"name": "x"}, {"name": "y"}])


query("replace_rows", "SELECT o_orderkey, CASE WHEN o_orderkey < 10 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey < 10 THEN NULL ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey < 10 THEN 'new' ELSE 'old' END AS note, o_orderkey % 3 + CASE WHEN o_orderkey < 10 THEN 1 ELSE 0 END AS version FROM orders")(
    lambda s: writes.replace_rows(s.table("versioned").frame(), s.spark.range(10).select(F.col("id").alias("o_orderkey"), F.lit("Z").alias("o_orderstatus")), VERSIONED)
)
query("update_rows", "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey < 100 THEN o_orderkey * 1.5 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")(
    lambda s: s.table("orders").update(s.spark.range(100).select(F.col("id").alias("o_orderkey"), (F.col("id") * 1.5).alias("o_totalprice")))
)
query("update_many", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")(lambda s: s.table("customer").update_many({"c_acctbal": {"$lt": 0}}, {"c_mktsegment": "DEBT"}))
query("replace_many", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'gone' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_nationkey = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")(lambda s: s.table("supplier").replace_many({"s_nationkey": 3}, {"s_name": "gone", "s_acctbal": 0.0}))
query("update_inc_mul", "SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_type = 'PROMO' THEN p_size + 3 ELSE p_size END AS p_size, round(CASE WHEN p_type = 'PROMO' THEN p_retailprice * 2 ELSE p_retailprice END, 2) AS p_retailprice FROM part")(lambda s: rounded(s.table("part").update_many({"p_type": "PROMO"}, {"p_size": {"$inc": 3}, "p_retailprice": {"$mul": 2}}), "p_retailprice"))
query("delete_many", "SELECT * FROM customer WHERE NOT c_acctbal < 0")(lambda s: s.table("customer").delete_many({"c_acctbal": {"$lt": 0}}))
query("agg_nocase", "SELECT c_nationkey, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' GROUP BY c_nationkey")(lambda s: s.table("customer").aggregate({"filter": {"c_mktsegment": "building"}, "controls": {"$groupBy": ["c_nationkey"], "$select": ["c_nationkey", {"$fn": "count", "$field": "*", "$as": "n"}]}}))
query("delete_nocase", "SELECT * FROM customer WHERE lower(c_mktsegment) <> 'building'")(lambda s: s.table("customer").delete_many({"c_mktsegment": "building"}))
query("update_nocase", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN lower(c_mktsegment) = 'building' THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")(lambda s: s.table("customer").update_many({"c_mktsegment": "building"}, {"c_acctbal": 0.0}))
query("update_null", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey >= 100 THEN o_custkey END AS VARCHAR) AS o_custkey, o_orderstatus FROM orders")(
    lambda s: as_text(s.table("orders").update(s.spark.range(100).select(F.col("id").alias("o_orderkey"), F.lit(None).cast("long").alias("o_custkey"), F.lit(None).cast("string").alias("o_orderstatus")), nulls=("o_custkey",)).select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey")
)


def refused(write: Callable[[Space], DataFrame]) -> Query:
    """The code with which a write is refused, as a one-row table."""
    def run(s: Space) -> DataFrame:
        try:
            write(s)
            code = "none"
        except QueryError as e:
            code = e.code
        return s.spark.createDataFrame([(code,)], "code string")

    return run


query("replace_fk_bad", "SELECT 'FK_VIOLATION' AS code")(refused(lambda s: s.table("nation").replace([{"n_nationkey": 3, "n_name": "x", "n_regionkey": 99}])))
query("update_fk_bad", "SELECT 'FK_VIOLATION' AS code")(refused(lambda s: s.table("nation").update_many({"n_nationkey": 3}, {"n_regionkey": 99})))
query("update_unique_bad", "SELECT 'CONFLICT' AS code")(refused(lambda s: s.table("nation").update_many({"n_nationkey": {"$lt": 2}}, {"n_name": "same"})))


@query("commit_twice", "SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN 'renamed' || n_nationkey ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 1")
def _commit_twice(s: Space) -> DataFrame:
    """A cascade over three tables stored as one step, then one table over itself."""
    root = f"{s.spark.conf.get('spark.checkpoint.dir', None) or s.spark.conf.get('spark.sql.warehouse.dir')}/commits/{uuid.uuid4().hex}"
    s.commit(s.table("region").delete({"r_regionkey": 1}), root)
    nation = s.table("nation").frame()
    s.commit({"nation": nation.withColumn("n_name", F.when(F.col("n_nationkey") < 10, F.concat(F.lit("renamed"), F.col("n_nationkey").cast("string"))).otherwise(F.col("n_name")))}, root)
    return s.table("nation").find_many({})


query("version_bump", "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'hit' ELSE 'old' END AS note, o_orderkey % 3 + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS version FROM orders")(lambda s: s.table("versioned").update_many({"o_orderstatus": "P"}, {"note": "hit"}))
query("cas_update", "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey = 5 THEN 'hit' ELSE 'old' END AS note, o_orderkey % 3 + CASE WHEN o_orderkey = 5 THEN 1 ELSE 0 END AS version FROM orders")(lambda s: s.table("versioned").update({"o_orderkey": 5, "note": "hit", "$cas": 2}))
query("cas_stale", "SELECT o_orderkey, o_orderstatus, o_totalprice, 'old' AS note, o_orderkey % 3 AS version FROM orders")(lambda s: s.table("versioned").update({"o_orderkey": 5, "note": "hit", "$cas": 1}))
query("matched_count", "SELECT count(*) AS matched FROM orders WHERE o_orderstatus = 'P'")(lambda s: writes.matched_count(s.table("orders").frame(), {"o_orderstatus": "P"}))

_I = "WITH b AS (SELECT l_orderkey, list({'part': l_partkey, 'qty': l_quantity} ORDER BY l_partkey, l_quantity) AS items, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS tags FROM lineitem GROUP BY l_orderkey) "


def _patched(changes: dict) -> Callable[[Space], DataFrame]:
    return lambda s: writes.update_many(s.table("baskets").frame(), {}, changes, ARRAYS).select("l_orderkey", *changes)


query("patch_insert", _I + "SELECT l_orderkey, array_to_string(list_transform(items || [{'part': CAST(-1 AS BIGINT), 'qty': CAST(2.0 AS DOUBLE)}], lambda x: x.part || ':' || x.qty), ',') AS items FROM b")(_patched({"items": {"$insert": [{"part": -1, "qty": 2.0}]}}))
query("patch_upsert", _I + "SELECT l_orderkey, array_to_string(list_transform(list_transform(items, lambda x: CASE WHEN x.part = 5 THEN {'part': x.part, 'qty': CAST(0.5 AS DOUBLE)} ELSE x END) || CASE WHEN len(list_filter(items, lambda x: x.part = 5)) = 0 THEN [{'part': CAST(5 AS BIGINT), 'qty': CAST(0.5 AS DOUBLE)}] ELSE [] END, lambda x: x.part || ':' || x.qty), ',') AS items FROM b")(_patched({"items": {"$upsert": [{"part": 5, "qty": 0.5}]}}))
query("patch_update", _I + "SELECT l_orderkey, array_to_string(list_transform(list_transform(items, lambda x: CASE WHEN x.part = 7 THEN {'part': x.part, 'qty': CAST(9.0 AS DOUBLE)} ELSE x END), lambda x: x.part || ':' || x.qty), ',') AS items FROM b")(_patched({"items": {"$update": [{"part": 7, "qty": 9.0}]}}))
query("patch_remove", _I + "SELECT l_orderkey, array_to_string(list_transform(list_filter(items, lambda x: x.part NOT IN (5, 7)), lambda x: x.part || ':' || x.qty), ',') AS items FROM b")(_patched({"items": {"$remove": [{"part": 5}, {"part": 7}]}}))
query("patch_replace", _I + "SELECT l_orderkey, array_to_string(list_transform([{'part': CAST(1 AS BIGINT), 'qty': CAST(1.0 AS DOUBLE)}], lambda x: x.part || ':' || x.qty), ',') AS items FROM b")(_patched({"items": {"$replace": [{"part": 1, "qty": 1.0}]}}))
query("patch_unique_insert", _I + "SELECT l_orderkey, array_to_string(tags || list_filter(['A', 'new'], lambda x: NOT list_contains(tags, x)), ',') AS tags FROM b")(_patched({"tags": {"$insert": ["A", "new"]}}))
query("patch_merge", _I + "SELECT l_orderkey, array_to_string(list_transform(list_transform(items, lambda x: {'part': x.part, 'qty': CASE WHEN x.part = 7 THEN CAST(9.0 AS DOUBLE) ELSE x.qty END, 'note': 'a'}), lambda x: x.part || ':' || x.qty || ':' || x.note), ',') AS merged FROM b")(_patched({"merged": {"$update": [{"part": 7, "qty": 9.0}]}}))

query("fk_check", "SELECT 'labels(doc_id) -> documents' AS \"constraint\", '{\"doc_id\":' || doc_id || '}' AS \"values\" FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")(lambda s: _fk_check(s))


def _fk_check(s: Space) -> DataFrame:
    english = s.table("documents").filtered({"filter": {"lang": "en"}})
    s.table("documents").source = lambda: english
    return integrity.check_foreign_keys(s.table("labels").frame(), s, "labels")


def _deleted(table: str, filter: dict, of: str) -> Callable[[Space], DataFrame]:
    def run(s: Space) -> DataFrame:
        for name in ("sales", "turns", "places", "versioned", "labelled", "baskets"):
            s.drop(name)
        return s.table(table).delete(filter)[of]

    return run


query("delete_cascade", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1")(lambda s: _deleted("region", {"r_regionkey": 1}, "orders")(s).select("o_orderkey"))
query("delete_set_null", "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS s_nationkey FROM supplier")(lambda s: as_text(_deleted("nation", {"n_nationkey": {"$lt": 5}}, "supplier")(s).select("s_suppkey", "s_nationkey"), "s_nationkey"))
query("unique_check", "SELECT 'l_orderkey,l_linenumber' AS \"constraint\", '{\"l_orderkey\":' || l_orderkey || ',\"l_linenumber\":' || l_linenumber || '}' AS \"values\", count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")(lambda s: writes.duplicates(s.table("lineitem").frame(), Model("l", (Field("l_orderkey", "int64", pk=True), Field("l_linenumber", "int32", pk=True)))))
query("validate_rows", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN NULL ELSE 'c_acctbal is required' END AS problem FROM customer WHERE c_acctbal <= 0")(lambda s: _validated(s))


def _validated(s: Space) -> DataFrame:
    model = Model("v", (Field("c_custkey", "int64", pk=True), Field("c_acctbal", "double")))
    rows = s.table("customer").frame().select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"))
    return writes.violations(rows, model).select("c_custkey", "problem")


@query("encrypt_roundtrip", "SELECT c_custkey, c_name FROM customer")
def _encrypted(s: Space) -> DataFrame:
    key = bytes(range(32))
    sealed = s.table("customer").frame().select("c_custkey", crypto.encrypt(F.col("c_name"), key).alias("c_name"))
    model = Model("sealed", (Field("c_custkey", "int64", pk=True), Field("c_name", encrypted=True)))
    return s.add(model, sealed).find_many({})


@query("actions_gate", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'ship' END, CASE WHEN NOT (o_orderstatus = 'P' OR o_totalprice > 300000) THEN 'cancel' END, 'print'], lambda x: x IS NOT NULL), ',') AS actions FROM orders")
def _actions(s: Space) -> DataFrame:
    off: list[actions.Action] = [
        actions.Action("ship", required=("o_orderstatus",), disabled=lambda c: c["o_orderstatus"] == "F"),
        actions.Action("cancel", required=("o_orderstatus", "o_totalprice"), disabled=lambda c: (c["o_orderstatus"] == "P") | (c["o_totalprice"] > 300000)),
        actions.Action("print"),
    ]
    return actions.augment(s.table("orders").frame(), off).select("o_orderkey", F.col("`$actions`").alias("actions"))


@query("schema_diff", "SELECT * FROM (VALUES ('added', 'c_email', ''), ('removed', 'c_acctbal', ''), ('renamed', 'c_name', 'c_label'), ('retyped', 'c_nationkey', 'int -> bigint'), ('nullability', 'c_mktsegment', '')) AS t(change, col, detail)")
def _schema_diff(s: Space) -> DataFrame:
    new = Model("customer", (Field("c_custkey", "int64", pk=True), Field("c_label", optional=True), Field("c_nationkey", "int64", optional=True), Field("c_mktsegment", collate="nocase"), Field("c_email", optional=True)))
    old = sync.snapshot(Model("customer", tuple(f if f.name != "c_mktsegment" else Field("c_mktsegment", collate="nocase", optional=True) for f in CUSTOMER.fields)))
    return s.spark.createDataFrame(sync.column_diff(old, sync.snapshot(new), {"c_label": "c_name"}).rows(), "change string, col string, detail string")


@query("schema_apply", "SELECT c_custkey, c_name AS c_label, CAST(c_nationkey AS BIGINT) AS c_nationkey, 'none' AS c_email FROM customer")
def _schema_apply(s: Space) -> DataFrame:
    old = Model("customer", (Field("c_custkey", "int64", pk=True), Field("c_name"), Field("c_nationkey", "int32"), Field("c_acctbal", "double")))
    new = Model("customer", (Field("c_custkey", "int64", pk=True), Field("c_label"), Field("c_nationkey", "int64"), Field("c_email", default="none")))
    diff = sync.column_diff(sync.snapshot(old), sync.snapshot(new), {"c_label": "c_name"})
    return sync.apply_diff(s.table("customer").frame().select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), diff, new)


# URL forms ---------------------------------------------------------------------------------
url("url_filter", "orders", "o_orderstatus=F&o_totalprice>=100000&$limit=none&$select=o_orderkey", _O + "o_orderstatus = 'F' AND o_totalprice >= 100000")
url("url_or_precedence", "orders", "o_orderstatus=P^o_totalprice>300000&o_orderpriority!=5-LOW&$limit=none&$select=o_orderkey", _O + "o_orderstatus = 'P' OR (o_totalprice > 300000 AND o_orderpriority <> '5-LOW')")
url("url_not_group", "orders", "!(o_orderstatus=P^o_orderstatus=O)&(o_custkey<100^o_custkey>1000)&$limit=none&$select=o_orderkey", _O + "NOT (o_orderstatus = 'P' OR o_orderstatus = 'O') AND (o_custkey < 100 OR o_custkey > 1000)")
url("url_sets", "orders", "o_orderpriority{1-URGENT,2-HIGH}&o_orderstatus!{F,P}&$limit=none&$select=o_orderkey", _O + "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F', 'P')")
url("url_between", "orders", "100000<o_totalprice<=150000&$limit=none&$select=o_orderkey", _O + "o_totalprice > 100000 AND o_totalprice <= 150000")
url("url_regex", "orders", "o_orderpriority~=/^[1-3].*h/i&$limit=none&$select=o_orderkey", _O + "regexp_matches(o_orderpriority, '(?i)^[1-3].*h')")
url("url_exists", "labelled", "$exists=quality&$limit=none&$select=doc_id", _L + "quality IS NOT NULL")
url("url_null", "labelled", "quality=null&$limit=none&$select=doc_id", _L + "quality IS NULL")
url("url_sort_page", "orders", "$sort=-o_totalprice,o_orderkey&$skip=10&$limit=25", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
url("url_exclude", "supplier", "$select=-s_name,-s_acctbal&$limit=none", "SELECT s_suppkey, s_nationkey FROM supplier")
url("url_count", "orders", "o_orderstatus=F&$count", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
url("url_group", "orders", "o_totalprice>5000&$groupBy=o_orderstatus&$select=o_orderstatus,count(*):n,max(o_totalprice):most&$sort=-n", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_totalprice > 5000 GROUP BY o_orderstatus")
query("url_with", """SELECT c_custkey, array_to_string(coalesce(list(o_orderkey ORDER BY r) FILTER (WHERE r <= 3), []), ',') AS keys FROM customer LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey GROUP BY c_custkey""")(
    lambda s: Facade(s, "customer").query("$with=orders(o_orderstatus=F&$sort=-o_totalprice&$limit=3)&$limit=none").select("c_custkey", F.transform("orders", lambda o: o["o_orderkey"]).alias("keys"))
)
query("url_search", _T + "SELECT doc_id FROM t WHERE list_contains(w || v, 'of') AND list_contains(w || v, 'the')")(lambda s: Facade(s, "documents").query("$search=of the&$limit=none").select("doc_id"))
query("url_one", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 17")(lambda s: Facade(s, "orders").one("17", "$select=o_orderkey,o_totalprice"))
query("overlay", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")(lambda s: Facade(s, "orders", overlay={"o_orderstatus": "F"}).query("o_totalprice>200000&$limit=none&$select=o_orderkey"))
query("meta_fields", """
SELECT table_name AS tbl, column_name AS name, CASE WHEN column_name = 'embedding' THEN 'vector' ELSE
  CASE data_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp' END END AS type, true AS filterable
FROM information_schema.columns
WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')
""")(lambda s: s.spark.createDataFrame([(m.name, f["name"], f["type"], f["filterable"]) for m in MODELS for f in s.table(m.name).meta()["fields"]], "tbl string, name string, type string, filterable boolean"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by market segment and order status, from a declared view."""
    return _flagship(space(spark, sf_dir))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
