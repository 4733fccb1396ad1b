"""Models of the synthetic tables, and spaces over a folder of them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .model import Field, ForeignKey, Index, JoinSpec, Model, Relation, View, ViewColumn
from .sources.space import Space


def _fields(**kinds: str | Field) -> tuple[Field, ...]:
    return tuple(v if isinstance(v, Field) else Field(k, v, optional=True) for k, v in kinds.items())


def _pk(name: str, kind: str) -> Field:
    return Field(name, kind, pk=True)


REGION = Model("region", _fields(r_regionkey=_pk("r_regionkey", "int32"), r_name=Field("r_name", searchable=True)), relations=(Relation("nations", "from", "nation"),))
NATION = Model(
    "nation", _fields(n_nationkey=_pk("n_nationkey", "int32"), n_name="string", n_regionkey="int32"),
    fks=(ForeignKey(("n_regionkey",), "region", ("r_regionkey",), on_delete="cascade"),),
    relations=(Relation("region", "to", "region"), Relation("customers", "from", "customer")), indexes=(Index("n_name_unique", "unique", ("n_name",)),),
)
CUSTOMER = Model(
    "customer", _fields(c_custkey=_pk("c_custkey", "int64"), c_name="string", c_nationkey="int32", c_acctbal="double", c_mktsegment=Field("c_mktsegment", collate="nocase")),
    fks=(ForeignKey(("c_nationkey",), "nation", ("n_nationkey",), on_delete="cascade"),),
    relations=(Relation("nation", "to", "nation"), Relation("orders", "from", "orders"), Relation("order", "from", "orders", many=False)),
)
SUPPLIER = Model("supplier", _fields(s_suppkey=_pk("s_suppkey", "int64"), s_name="string", s_nationkey="int32", s_acctbal="double"), fks=(ForeignKey(("s_nationkey",), "nation", ("n_nationkey",), on_delete="setNull"),), relations=(Relation("nation", "to", "nation"),))
PART = Model("part", _fields(p_partkey=_pk("p_partkey", "int64"), p_name=Field("p_name", searchable=True), p_brand="string", p_type=Field("p_type", searchable=True), p_size="int32", p_retailprice="double"))
ORDERS = Model(
    "orders", _fields(o_orderkey=_pk("o_orderkey", "int64"), o_custkey="int64", o_orderstatus="string", o_totalprice="double", o_orderdate="timestamp", o_orderpriority="string"),
    fks=(ForeignKey(("o_custkey",), "customer", ("c_custkey",), on_delete="cascade"),),
    relations=(Relation("customer", "to", "customer"), Relation("lines", "from", "lineitem"), Relation("parts", "via", "part", junction="lineitem")),
)
LINEITEM = Model(
    "lineitem", _fields(l_orderkey="int64", l_partkey="int64", l_suppkey="int64", l_linenumber="int32", l_quantity="double", l_extendedprice="double", l_discount="double", l_tax="double", l_returnflag="string", l_linestatus="string", l_shipdate="timestamp"),
    fks=(ForeignKey(("l_orderkey",), "orders", ("o_orderkey",), on_delete="cascade"), ForeignKey(("l_partkey",), "part", ("p_partkey",), on_delete="restrict")),
    relations=(Relation("order", "to", "orders"), Relation("part", "to", "part")),
)
EVENTS = Model("events", _fields(event_id=_pk("event_id", "int64"), ts="timestamp", user_id="int64", event_type="string", value="double", props="string"))
DOCUMENTS = Model(
    "documents", _fields(doc_id=_pk("doc_id", "int64"), text=Field("text", searchable=True, optional=True), lang="string", source="string", n_chars="int64"),
    indexes=(Index("text_all", "fulltext", ("text", "source"), (1.0, 5.0)), Index("text_prefix", "fulltext", ("text",), strategy="autocomplete"), Index("text_both", "fulltext", ("text",), strategy="compound", fuzzy=1)),
    relations=(Relation("label", "from", "labels", many=False),),
)
EMBEDDINGS = Model("embeddings", _fields(vec_id=_pk("vec_id", "int64"), embedding=Field("embedding", "vector", dims=64, optional=True), label="int32"))
PAGES = Model("pages", _fields(page_id=_pk("page_id", "int64"), url="string", html="string"))
BENCHMARK = Model("benchmark", _fields(item_id=_pk("item_id", "int64"), text="string"))
LABELS = Model("labels", _fields(doc_id=_pk("doc_id", "int64"), quality="int32", toxic="int32"), fks=(ForeignKey(("doc_id",), "documents", ("doc_id",)),))
CONVERSATIONS = Model(
    "conversations", _fields(conv_id=_pk("conv_id", "int64"), turn=_pk("turn", "int64"), role="string", text="string"),
)
MODELS = (REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS, DOCUMENTS, EMBEDDINGS, PAGES, BENCHMARK, LABELS, CONVERSATIONS)

#: Lines of orders with grouping rules declared, for strict aggregation.
SALES = Model("sales", _fields(
    l_returnflag=Field("l_returnflag", dimension=True), l_linestatus=Field("l_linestatus", dimension=True),
    l_quantity=Field("l_quantity", "double", measure=True), l_extendedprice=Field("l_extendedprice", "double", measure=True, currency_ref="l_linestatus"),
), table="lineitem")
#: Turns with their predecessor: a composite key that refers to its own table.
TURNS = Model(
    "turns", _fields(conv_id=_pk("conv_id", "int64"), turn=_pk("turn", "int64"), role="string", previous="int64"),
    fks=(ForeignKey(("conv_id", "previous"), "conversations", ("conv_id", "turn"), alias="before"),),
    relations=(Relation("before", "to", "conversations", alias="before"),),
)
#: Customers placed on a map by a rule over their key.
PLACES = Model("places", _fields(id=_pk("id", "int64"), name="string", point=Field("point", "geopoint", optional=True)), indexes=(Index("by_point", "geo", ("point",)),))
#: Orders with a version column.
VERSIONED = Model("versioned", _fields(o_orderkey=_pk("o_orderkey", "int64"), o_orderstatus="string", o_totalprice="double", note=Field("note", optional=True, default="new"), version=Field("version", "int64", version=True)))
#: Customers and their documents' labels, where there are any: a source of nulls.
LABELLED = Model("labelled", _fields(doc_id=_pk("doc_id", "int64"), lang="string", quality=Field("quality", "int32", optional=True)))
ARRAYS = Model("baskets", _fields(
    l_orderkey=_pk("l_orderkey", "int64"),
    items=Field("items", array=True, keys=("part",), fields=(Field("part", "int64"), Field("qty", "double", optional=True))),
    merged=Field("merged", array=True, keys=("part",), merge=True, fields=(Field("part", "int64"), Field("qty", "double", optional=True), Field("note", "string", optional=True))),
    tags=Field("tags", "string", array=True, unique_items=True),
))

VIEWS = (
    View("customer_nation", (ViewColumn("c_custkey", "customer.c_custkey"), ViewColumn("c_name", "customer.c_name"), ViewColumn("n_name", "nation.n_name")), "customer", (JoinSpec("nation", "customer.c_nationkey = nation.n_nationkey"),)),
    View("customer_region", (ViewColumn("c_custkey", "customer.c_custkey"), ViewColumn("n_name", "nation.n_name"), ViewColumn("r_name", "region.r_name")), "customer", (JoinSpec("nation", "customer.c_nationkey = nation.n_nationkey"), JoinSpec("region", "nation.n_regionkey = region.r_regionkey"))),
    View("document_labels", (ViewColumn("doc_id", "documents.doc_id"), ViewColumn("lang", "documents.lang"), ViewColumn("quality", "labels.quality")), "documents", (JoinSpec("labels", "documents.doc_id = labels.doc_id", "left"),)),
    View("richer_suppliers", (ViewColumn("r_name", "region.r_name"), ViewColumn("s_suppkey", "supplier.s_suppkey")), "region", (JoinSpec("supplier", "supplier.s_nationkey > region.r_regionkey && supplier.s_acctbal > 5000"),)),
    View("urgent_orders", (ViewColumn("o_orderkey", "orders.o_orderkey"), ViewColumn("o_totalprice", "orders.o_totalprice")), "orders", filter="orders.o_orderpriority {'1-URGENT', '2-HIGH'} && !(orders.o_orderstatus = 'P') && orders.o_orderdate ?"),
    View("segment_sales", (ViewColumn("c_mktsegment", "customer.c_mktsegment"), ViewColumn("o_orderstatus", "orders.o_orderstatus"), ViewColumn("revenue", "orders.o_totalprice", "sum"), ViewColumn("orders", "*", "count"), ViewColumn("avg_price", "orders.o_totalprice", "avg")), "orders", (JoinSpec("customer", "orders.o_custkey = customer.c_custkey"),), filter="orders.o_totalprice > 1000 && orders.o_orderstatus != 'X'", having="orders >= 2"),
    View("order_totals", (ViewColumn("n", "*", "count"), ViewColumn("least", "orders.o_totalprice", "min"), ViewColumn("most", "orders.o_totalprice", "max")), "orders"),
)


def space(spark: SparkSession, sf_dir: str) -> Space:
    """All tables and views of a folder."""
    made = Space(spark, sf_dir, key=bytes(range(32)))
    for m in MODELS:
        made.add(m)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    made.add(SALES, lambda: read("lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"))
    made.add(TURNS, lambda: read("conversations").select("conv_id", "turn", "role", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("previous")))
    place = F.array((F.col("c_custkey") * 7 % 360 - 180).cast("double"), (F.col("c_custkey") * 13 % 180 - 90).cast("double"))
    made.add(PLACES, lambda: read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 10 != 0, place).alias("point")))
    made.add(VERSIONED, lambda: read("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit("old").alias("note"), (F.col("o_orderkey") % 3).alias("version")))
    made.add(LABELLED, lambda: read("documents").join(read("labels"), "doc_id", "left").select("doc_id", "lang", "quality"))
    item = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"))
    noted = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.lit("a").alias("note"))
    made.add(ARRAYS, lambda: read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"), F.array_sort(F.collect_list(noted)).alias("merged"), F.array_sort(F.collect_set("l_returnflag")).alias("tags")))
    for v in VIEWS:
        made.add_view(v)
    return made
