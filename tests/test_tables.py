"""Reads and writes on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.facade import Facade
from tessera.model import Field, ForeignKey, Index, Model, Relation, View, ViewColumn
from tessera.operators import nested, sync
from tessera.operators.actions import Action, fetch, gate
from tessera.operators.patch import inc, insert, remove, upsert
from tessera.operators.writes import optimistic
from tessera.sources.space import Space

ORDERS = Model("orders", (Field("id", "int64", pk=True), Field("status", dimension=True), Field("currency", dimension=True), Field("amount", "double", measure=True, currency_ref="currency"), Field("quantity", "int64", measure=True)))
SEED = [(1, "active", "USD", 100.0, 2), (2, "active", "USD", 200.0, 3), (3, "active", "EUR", 150.0, 1), (4, "cancelled", "USD", 50.0, 1), (5, "cancelled", "EUR", 75.0, 2)]
AUTHORS = Model("authors", (Field("id", "int64", pk=True), Field("name")), relations=(Relation("posts", "from", "posts"), Relation("post", "from", "posts", many=False)))
POSTS = Model(
    "posts", (Field("id", "int64", pk=True), Field("title"), Field("author", "int64", optional=True)),
    fks=(ForeignKey(("author",), "authors", ("id",), on_delete="cascade"),), relations=(Relation("writer", "to", "authors"), Relation("tags", "via", "tags", junction="post_tags")),
)
TAGS = Model("tags", (Field("id", "int64", pk=True), Field("label")))
POST_TAGS = Model("post_tags", (Field("post", "int64", pk=True), Field("tag", "int64", pk=True)), fks=(ForeignKey(("post",), "posts", ("id",), on_delete="cascade"), ForeignKey(("tag",), "tags", ("id",), on_delete="restrict")))


@pytest.fixture
def space(spark):
    s = Space(spark)
    rows = lambda m, values: [dict(zip([f.name for f in m.fields], v)) for v in values]
    s.add_rows(ORDERS, rows(ORDERS, SEED), null_model="sql")
    s.add_rows(AUTHORS, rows(AUTHORS, [(1, "ann"), (2, "bob"), (3, "cy")]), null_model="sql")
    s.add_rows(POSTS, rows(POSTS, [(10, "a", 1), (11, "b", 1), (12, "c", 2), (13, "d", None)]), null_model="sql")
    s.add_rows(TAGS, rows(TAGS, [(1, "x"), (2, "y")]), null_model="sql")
    s.add_rows(POST_TAGS, rows(POST_TAGS, [(10, 1), (10, 2), (12, 2), (12, 9)]), null_model="sql")
    return s


def agg(fn, name, alias=None):
    return {"$fn": fn, "$field": name, **({"$as": alias} if alias else {})}


def test_hand_computed_aggregates(space):
    t = space.table("orders")
    q = {"controls": {"$groupBy": ["status", "currency"], "$select": ["status", agg("sum", "amount")]}}
    assert sorted((r["status"], r["sum_amount"]) for r in t.aggregate(q).collect()) == [("active", 150.0), ("active", 300.0), ("cancelled", 50.0), ("cancelled", 75.0)]
    q = {"controls": {"$groupBy": ["status"], "$select": ["status", agg("sum", "quantity", "q"), agg("count", "*", "n")], "$having": {"n": {"$gt": 2}}}}
    assert [tuple(r) for r in t.aggregate(q).collect()] == [("active", 6, 3)]
    assert t.aggregate({"controls": {"$groupBy": ["status", "currency"], "$count": True}}).first()["count"] == 4


@pytest.mark.parametrize("q", [
    {"$groupBy": ["status"], "$select": ["currency"]}, {"$groupBy": ["amount"]}, {"$groupBy": ["status"], "$select": [agg("sum", "amount")]},
    {"$groupBy": ["status"], "$select": [agg("sum", "status")]}, {"$groupBy": ["status"], "$select": [agg("median", "quantity")]}, {"$groupBy": ["status"], "$with": ["x"]},
])
def test_strict_aggregates(space, q):
    with pytest.raises(QueryError):
        space.table("orders").aggregate({"controls": q})


def test_relations(space):
    got = {r["id"]: r for r in space.table("authors").find_many({"controls": {"$with": ["posts", "post"]}}).collect()}
    assert [p["title"] for p in got[1]["posts"]] == ["a", "b"] and got[3]["posts"] == [] and got[3]["post"] is None and got[1]["post"]["id"] == 10
    got = {r["id"]: r for r in space.table("posts").find_many({"controls": {"$with": ["writer", "tags", "no.such"]}}).collect()}
    assert got[10]["writer"]["name"] == "ann" and got[13]["writer"] is None
    assert [t["label"] for t in got[10]["tags"]] == ["x", "y"] and [t["label"] for t in got[12]["tags"]] == ["y"] and got[11]["tags"] == []
    with pytest.raises(QueryError):
        space.table("posts").find_many({"controls": {"$with": ["nope"]}})


def test_relation_limit_is_per_parent(space):
    got = space.table("authors").find_many({"controls": {"$with": [{"name": "posts", "controls": {"$sort": {"id": -1}, "$limit": 1, "$select": ["title"]}}]}}).collect()
    assert {r["id"]: [p["title"] for p in r["posts"]] for r in got} == {1: ["b"], 2: ["c"], 3: []}


def test_select_and_hidden(spark):
    s = Space(spark)
    s.add_rows(Model("u", (Field("id", "int64", pk=True), Field("name"), Field("secret", write_only=True), Field("price", "double", currency_ref="cur"), Field("cur"))), [{"id": 1, "name": "n", "secret": "s", "price": 2.0, "cur": "EUR"}])
    t = s.table("u")
    assert t.find_many({}).columns == ["id", "name", "price", "cur"]
    assert t.find_many({"controls": {"$select": ["price"]}}).columns == ["price", "id", "cur"]
    assert t.find_many({"controls": {"$select": {"name": 0}}}).columns == ["id", "price", "cur"]


def test_ids_and_pages(space):
    t = space.table("orders")
    assert t.find_by_id("3").first()["amount"] == 150.0 and t.find_by_id("x").count() == 0
    page = t.pages({"controls": {"$sort": "id", "$page": 2, "$size": 2}})
    assert [r["id"] for r in page["data"].collect()] == [3, 4] and page["pages"] == 3 and page["count"] == 5


def test_writes(space):
    t = space.table("posts")
    assert t.insert([{"id": 14, "title": "e", "author": 2}]).count() == 5
    for bad, code in (({"id": 10, "title": "dup", "author": 1}, "CONFLICT"), ({"id": 15, "title": "x", "author": 99}, "FK_VIOLATION"), ({"id": 16}, "INVALID_QUERY")):
        with pytest.raises(QueryError) as e:
            t.insert([bad])
        assert e.value.code == code
    assert {r["id"]: r["title"] for r in t.update({"id": 11, "title": "z"}).collect()}[11] == "z"
    o = space.table("orders")
    assert {r["id"]: r["quantity"] for r in o.update_many({"status": "active"}, {"quantity": inc(5)}).collect()} == {1: 7, 2: 8, 3: 6, 4: 1, 5: 2}
    assert {r["id"] for r in o.delete_many({"amount": {"$gt": 90}}).collect()} == {4, 5}


def test_referential_actions(space):
    after = space.table("authors").delete({"id": 2})
    assert {r["id"] for r in after["authors"].collect()} == {1, 3} and {r["id"] for r in after["posts"].collect()} == {10, 11, 13}
    assert {(r["post"], r["tag"]) for r in after["post_tags"].collect()} == {(10, 1), (10, 2)}
    with pytest.raises(QueryError) as e:
        space.table("tags").delete({"id": 2})
    assert e.value.code == "FK_VIOLATION"


def test_array_patches(spark):
    s = Space(spark)
    m = Model("b", (Field("id", "int64", pk=True), Field("items", array=True, keys=("k",), fields=(Field("k"), Field("v", "int64", optional=True))), Field("tags", array=True, unique_items=True), Field("version", "int64", version=True)))
    s.add_rows(m, [{"id": 1, "items": [("a", 1), ("b", 2)], "tags": ["x"], "version": 0}])
    t = s.table("b")
    row = t.update({"id": 1, "items": {**remove([{"k": "a"}]), **upsert([{"k": "b", "v": 5}, {"k": "c", "v": 6}])}, "tags": insert(["x", "y"])}).first()
    assert [tuple(i) for i in row["items"]] == [("b", 5), ("c", 6)] and row["tags"] == ["x", "y"] and row["version"] == 1
    assert t.update({"id": 1, "tags": insert(["q"]), "$cas": 7}).first()["tags"] == ["x"]
    with pytest.raises(QueryError):
        t.update({"id": 1, "items": upsert([{"v": 1}])})
    with pytest.raises(QueryError):
        t.update({"id": 1, "version": 3})


def test_encryption_and_commit(spark, tmp_path):
    s = Space(spark, key=bytes(range(32)))
    m = Model("e", (Field("id", "int64", pk=True), Field("name", encrypted=True)))
    s.add_rows(m, [])
    t = s.table("e")
    t.source = lambda: spark.createDataFrame([], "id long, name string")
    t.commit(spark.createDataFrame([(1, "ann"), (2, None)], "id long, name string"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).where("name IS NOT NULL").first()["name"].startswith("tsr1:")
    assert {r["id"]: r["name"] for r in t.find_many({}).collect()} == {1: "ann", 2: None}
    with pytest.raises(QueryError) as e:
        t.find_many({"filter": {"name": "ann"}})
    assert e.value.code == "ENC_FIELD_FILTER"


def test_commit_never_touches_what_is_read(spark, space, tmp_path):
    t, path = space.table("tags"), str(tmp_path / "tags")
    t.commit(t.insert([{"id": 3, "label": "z"}]), path)
    for target in (path, str(tmp_path)):
        with pytest.raises(QueryError) as e:
            t.commit(t.delete_many({"id": 1}), target)
        assert e.value.code == "CONFLICT"
    assert sorted(r["id"] for r in t.frame().collect()) == [1, 2, 3]
    t.commit(t.delete_many({"id": 1}), path + "2")
    assert sorted(r["id"] for r in t.frame().collect()) == [2, 3]


def test_tables_are_committed_together(spark, space, tmp_path):
    root = str(tmp_path)
    space.commit(space.table("authors").delete({"id": 2}), root)
    assert {r["id"] for r in space.table("posts").frame().collect()} == {10, 11, 13}
    broken = space.table("posts").frame().withColumn("title", F.raise_error(F.lit("no")))
    with pytest.raises(Exception):
        space.commit({"authors": space.table("authors").delete_many({"id": 1}), "posts": broken}, root)
    assert {r["id"] for r in space.table("authors").frame().collect()} == {1, 3}
    again = Space(spark)
    for m in (AUTHORS, POSTS, POST_TAGS):
        again.add_rows(m, [])
    again.attach(root)
    assert {r["id"] for r in again.table("authors").frame().collect()} == {1, 3} and again.table("post_tags").frame().count() == 2


def test_hidden_fields_stay_hidden(spark):
    s = Space(spark)
    user = Model("u", (Field("id", "int64", pk=True), Field("name"), Field("secret", write_only=True)))
    note = Model("n", (Field("id", "int64", pk=True), Field("owner", "int64")), fks=(ForeignKey(("owner",), "u", ("id",)),), relations=(Relation("user", "to", "u"),))
    s.add_rows(user, [{"id": 1, "name": "n", "secret": "s"}, {"id": 2, "name": "m", "secret": "t"}])
    s.add_rows(note, [{"id": 1, "owner": 1}, {"id": 2, "owner": 2}])
    for spec in ("user", {"name": "user", "controls": {"$select": ["name", "secret"]}}, {"name": "user", "controls": {"$select": {"id": 0}}}):
        found = s.table("n").find_many({"controls": {"$with": [spec]}})
        assert "secret" not in found.schema["user"].dataType.names
    for select in (["secret"], ["name", {"$fn": "max", "$field": "secret"}]):
        with pytest.raises(QueryError):
            s.table("u").aggregate({"controls": {"$groupBy": [select[0]], "$select": select}})
    s.overlays["u"] = {"id": 1}
    assert {r["id"]: r["user"] is not None for r in s.table("n").find_many({"controls": {"$with": ["user"]}}).collect()} == {1: True, 2: False}
    assert Facade(s, "u").query("").count() == 1


def test_guards_hold_everywhere(spark):
    s = Space(spark, key=bytes(range(32)))
    user = Model("u", (Field("id", "int64", pk=True), Field("name", collate="nocase"), Field("pin", encrypted=True)))
    note = Model("n", (Field("id", "int64", pk=True), Field("owner", "int64")), fks=(ForeignKey(("owner",), "u", ("id",)),), relations=(Relation("user", "to", "u"),))
    s.add(user, lambda: spark.createDataFrame([(1, "Ann", None), (2, "bob", None)], "id long, name string, pin string"))
    s.add_rows(note, [{"id": 1, "owner": 1}])
    u, bad = s.table("u"), {"pin": "1"}
    for run in (lambda: u.aggregate({"filter": bad, "controls": {"$groupBy": ["name"]}}), lambda: u.update_many(bad, {"name": "x"}), lambda: u.delete_many(bad), lambda: s.table("n").find_many({"controls": {"$with": [{"name": "user", "filter": bad}]}})):
        with pytest.raises(QueryError) as e:
            run()
        assert e.value.code == "ENC_FIELD_FILTER"
    assert u.delete_many({"name": "ANN"}).count() == 1
    assert s.table("n").find_many({"controls": {"$with": [{"name": "user", "filter": {"name": "ANN"}}]}}).first()["user"]["id"] == 1


def test_sort_outlives_joins(spark, sf_dir):
    from tessera.tables import space as tables

    s, before = tables(spark, sf_dir), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for controls in ({"$limit": 50}, {}):
            prices = [r["o_totalprice"] for r in s.table("orders").find_many({"controls": {"$sort": "-o_totalprice", "$with": ["customer", "lines"], **controls}}).collect()]
            assert prices == sorted(prices, reverse=True) and len(prices) >= 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_writes_are_checked(space, spark):
    posts, tags = space.table("posts"), space.table("tags")
    for write, code in (
        (lambda: posts.replace([{"id": 10, "title": "x", "author": 99}]), "FK_VIOLATION"), (lambda: posts.update({"id": 10, "author": 99}), "FK_VIOLATION"),
        (lambda: posts.update_many({"id": 10}, {"author": 99}), "FK_VIOLATION"), (lambda: posts.replace([{"id": 10, "author": 1}]), "INVALID_QUERY"),
        (lambda: posts.update({"id": 10, "title": None}), "INVALID_QUERY"), (lambda: tags.replace([{"id": 1, "label": "a"}, {"id": 1, "label": "b"}]), "CONFLICT"),
        (lambda: tags.update(spark.createDataFrame([(1, "a"), (1, "b")], "id long, label string")), "CONFLICT"),
    ):
        with pytest.raises(QueryError) as e:
            write()
        assert e.value.code == code
    patch = spark.createDataFrame([(10, None, None)], "id long, title string, author long")
    assert {r["id"]: (r["title"], r["author"]) for r in posts.update(patch, nulls=("author",)).collect()}[10] == ("a", None)
    assert {r["id"]: r["author"] for r in posts.update({"id": 10, "author": None}).collect()}[10] is None


def test_text_against_integers(spark):
    s = Space(spark)
    s.add_rows(Model("k", (Field("id", "int64", pk=True),)), [{"id": 9007199254740992}, {"id": 9007199254740993}, {"id": 5}])
    t = s.table("k")
    assert t.find_many({"filter": {"id": "9007199254740993"}}).count() == 1
    assert t.find_many({"filter": {"id": {"$gt": "5.5"}}}).count() == 2 and t.find_many({"filter": {"id": {"$lt": "99999999999999999999"}}}).count() == 3


def test_search_counts_pages(spark, sf_dir):
    from tessera.tables import space as tables

    f = Facade(tables(spark, sf_dir), "documents")
    none = f.pages("$search=zzzznotthere")
    assert none["count"] == 0 and none["pages"] == 0 and none["data"].count() == 0 and f.query("$search=zzzznotthere&$count").first()["count"] == 0
    some = f.pages("$search=of&$size=7")
    assert 0 < some["count"] < 1000 and some["data"].count() == min(7, some["count"])


def test_array_operands(spark):
    s = Space(spark)
    inner = (Field("k"), Field("v", "int64", optional=True), Field("w", optional=True))
    m = Model("b", (Field("id", "int64", pk=True), Field("items", array=True, keys=("k",), merge=True, fields=inner), Field("plain", array=True), Field("once", array=True, unique_items=True)))
    s.add_rows(m, [{"id": 1, "items": [("a", 1, "x"), ("b", 2, "y")], "plain": ["p", "p"], "once": ["q", "q"]}])
    row = s.table("b").update({"id": 1, "items": upsert([{"k": "a", "v": None}, {"k": "c", "v": 1}, {"k": "c", "v": 2}]), "plain": upsert(["p", "r", "r"]), "once": insert(["q", "z"])}).first()
    assert [tuple(i) for i in row["items"]] == [("a", None, "x"), ("b", 2, "y"), ("c", 2, None)]
    assert row["plain"] == ["p", "p", "r"] and row["once"] == ["q", "q", "z"]


def test_excluding_a_join_key(space):
    for select in (["-author"], {"author": 0}):
        with pytest.raises(QueryError):
            space.table("posts").find_many({"controls": {"$select": select, "$with": ["writer"]}})


def test_nested_insert_order(space):
    plan = nested.plan_insert(space, "posts", [{"id": 20, "title": "n", "writer": {"id": 9, "name": "new"}, "tags": [{"id": 1}, {"id": 5, "label": "z"}]}])
    assert [(t, len(rows)) for t, rows in plan] == [("authors", 1), ("tags", 1), ("posts", 1), ("post_tags", 2)]
    assert plan[2][1][0]["author"] == 9 and plan[3][1][1] == {"post": 20, "tag": 5}
    with pytest.raises(QueryError) as e:
        nested.plan_insert(space, "authors", [{"id": 1, "posts": [{"id": 2, "tags": [{"id": 1}]}]}], max_depth=1)
    assert e.value.code == "DEPTH_EXCEEDED"


def test_actions(space):
    rows = fetch(space.table("orders").frame(), [3, 99, 1, 3], "id")
    assert [(r["id"], r["__found"]) for r in rows.collect()] == [(3, True), (None, False), (1, True)]
    closed = Action("pay", required=("status",), disabled=lambda c: c["status"] == "cancelled", mode="skip")
    assert gate(space.table("orders").frame(), closed).count() == 3
    with pytest.raises(QueryError):
        gate(rows, Action("pay", required=("status",), disabled=lambda c: c["status"] == "cancelled"))


def test_sync():
    old, new = sync.snapshot(ORDERS), sync.snapshot(Model("orders", (*ORDERS.fields[:-1], Field("qty", "int64"))))
    diff = sync.column_diff(old, new, {"qty": "quantity"})
    assert diff.renamed == [("quantity", "qty")] and not diff.added and not diff.removed
    assert sync.schema_hash(old) == sync.schema_hash(sync.snapshot(ORDERS)) != sync.schema_hash(new)
    assert [p["action"] for p in sync.plan([ORDERS], {})] == ["create"] and sync.plan([ORDERS], {"orders": old}) == []


def test_nested_replace_and_patch(space, spark):
    ann = space.table("authors").frame().where("id = 1")
    new = spark.createDataFrame([(10, "a2", 1), (15, "n", 1)], "id long, title string, author long")
    after = nested.replace_children(space, "authors", "posts", ann, new)["posts"]
    assert sorted((r["id"], r["title"]) for r in after.collect()) == [(10, "a2"), (12, "c"), (13, "d"), (15, "n")]
    post = space.table("posts").frame().where("id = 10")
    links = nested.replace_children(space, "posts", "tags", post, spark.createDataFrame([(10, 2)], "post long, tag long"))["post_tags"]
    assert sorted(map(tuple, links.collect())) == [(10, 2), (12, 2), (12, 9)]
    with pytest.raises(QueryError):
        nested.replace_children(space, "authors", "posts", ann, spark.createDataFrame([(16, "x", 2)], "id long, title string, author long"))
    rows = lambda v: spark.createDataFrame(v, "id long, title string, author long")
    after = nested.patch_children(space, "authors", "posts", {"$remove": rows([(11, None, None)]), "$update": rows([(12, "cc", None)]), "$upsert": rows([(13, "dd", 3), (17, "q", 3)]), "$insert": rows([(18, "r", 3)])})["posts"]
    assert sorted((r["id"], r["title"]) for r in after.collect()) == [(10, "a"), (12, "cc"), (13, "dd"), (17, "q"), (18, "r")]


def test_sync_run(spark, tmp_path):
    first = Model("t", (Field("id", "int64", pk=True), Field("name", optional=True)))
    run = sync.Sync(spark, str(tmp_path))
    assert [s["action"] for s in run.run([first])] == ["create"] and run.run([first]) == []
    spark.createDataFrame([(1, "a"), (2, None)], "id long, name string").write.mode("append").parquet(run.stored()[1]["t"])
    second = Model("u", (Field("id", "int64", pk=True), Field("title"), Field("n", "int32", default=7)), renamed_from="t")
    assert [p["action"] for p in run.plan([second], {"u": {"title": "name"}})] == ["alter"]
    run.run([second], {"u": {"title": "name"}})
    assert sorted(map(tuple, run.frame(second).select("id", "title", "n").collect())) == [(1, "a", 7), (2, "", 7)]
    (tmp_path / "_lock").write_text("")
    with pytest.raises(QueryError):
        run.run([Model("u", (Field("id", "int64", pk=True),))])


def test_views(space, tmp_path):
    view = View("spend", (ViewColumn("status", "orders.status"), ViewColumn("total", "orders.amount", "sum"), ViewColumn("n", "*", "count")), "orders", filter="orders.amount >= 75", having="n > 1")
    v = space.add_view(view)
    assert [tuple(r) for r in v.find_many({}).collect()] == [("active", 450.0, 3)]
    assert space.refresh("spend", str(tmp_path / "v")).count().first()["count"] == 1
    with pytest.raises(QueryError):
        space.add_view(View("missing_view"))


def test_geo_rules(spark):
    s = Space(spark)
    m = Model("g", (Field("id", "int64", pk=True), Field("at", "geopoint", optional=True)), indexes=(Index("i", "geo", ("at",)),))
    s.add_rows(m, [{"id": 1, "at": [0.0, 0.0]}, {"id": 2, "at": [0.0, 1.0]}, {"id": 3, "at": None}, {"id": 4, "at": [179.9, 0.0]}])
    t = s.table("g")
    got = t.geo_search([-179.9, 0.0], {"controls": {"$maxDistance": 50000}}).collect()
    assert [r["id"] for r in got] == [4] and abs(got[0]["$distance"] - 22239) < 1
    assert [r["id"] for r in t.geo_search([0, 0]).collect()] == [1, 2, 4]
    for controls in ({"$sort": {"id": 1}}, {"$maxDistance": -1}):
        with pytest.raises(QueryError):
            t.geo_search([0, 0], {"controls": controls})
    with pytest.raises(QueryError):
        t.geo_search([200, 0])


def test_optimistic():
    state, tries = {"v": 0}, []

    def write(new):
        tries.append(new)
        return len(tries) == 3

    assert optimistic(lambda: dict(state), lambda r: {**r, "v": r["v"] + 1}, write) == {"v": 1}
    with pytest.raises(QueryError):
        optimistic(lambda: {}, lambda r: r, lambda r: False)
