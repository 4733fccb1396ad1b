import pytest

from tessera.errors import QueryError
from tessera.plans.sorting import parse_sort
from tessera.plans.urlquery import coerce, parse_expression, parse_url


@pytest.mark.parametrize(
    "text, expected",
    [
        ("status=active", {"status": "active"}),
        ("a=1&b!=x", {"a": 1, "b": {"$ne": "x"}}),
        ("a>3&a<=9", {"$and": [{"a": {"$gt": 3}}, {"a": {"$lte": 9}}]}),
        ("role{Admin,Editor}", {"role": {"$in": ["Admin", "Editor"]}}),
        ("s!{Draft,null}", {"s": {"$nin": ["Draft", None]}}),
        ("s{}", {"s": {"$in": []}}),
        ("25<age<35", {"age": {"$gt": 25, "$lt": 35}}),
        ("25<=age<35", {"age": {"$gte": 25, "$lt": 35}}),
        ("name~=/^A&l/i", {"name": {"$regex": "/^A&l/i"}}),
        ("a=null", {"a": None}),
        ("a=1^b=2&c=3", {"$or": [{"a": 1}, {"b": 2, "c": 3}]}),
        ("(a=1^b=2)&c=true", {"$or": [{"a": 1}, {"b": 2}], "c": True}),
        ("!(a=1)", {"$not": {"a": 1}}),
        ("contact.email=x@y.z", {"contact.email": "x@y.z"}),
        ("$exists=a,b&$!exists=c", {"a": {"$exists": True}, "b": {"$exists": True}, "c": {"$exists": False}}),
        ("zip=007", {"zip": "007"}),
        ("name=%27a%20b%27", {"name": "a b"}),
    ],
)
def test_filters(text, expected):
    assert parse_url(text)["filter"] == expected


def test_controls():
    got = parse_url("$sort=-a,b&$limit=5&$skip=2&$select=a,sum(b):t,count(*)&$groupBy=a&$count&$center=1,-2.5")["controls"]
    assert got == {"$sort": {"a": -1, "b": 1}, "$limit": 5, "$skip": 2, "$select": ["a", {"$fn": "sum", "$field": "b", "$as": "t"}, {"$fn": "count", "$field": "*"}], "$groupBy": ["a"], "$count": True, "$center": [1.0, -2.5]}


def test_nested_with():
    got = parse_url("$with=comments(status=ok&$sort=-at&$limit=3&$with=author($select=name)),tags")["controls"]["$with"]
    assert got[0]["filter"] == {"status": "ok"} and got[0]["controls"]["$limit"] == 3
    assert got[0]["controls"]["$with"][0] == {"name": "author", "filter": {}, "controls": {"$select": ["name"]}}
    assert got[1] == {"name": "tags"}


@pytest.mark.parametrize("text", ["$nope=1", "(a=1", "$limit=x", "=3"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse_url(text)


def test_expressions():
    assert parse_expression("T.s != 'done' && T.p >= 3") == {"T.s": {"$ne": "done"}, "T.p": {"$gte": 3}}
    assert parse_expression("(T.s = 'a' || T.s = 'b') && T.x ?") == {"$or": [{"T.s": "a"}, {"T.s": "b"}], "T.x": {"$exists": True}}
    assert parse_expression("T.d !?") == {"T.d": {"$exists": False}}
    assert parse_expression("T.r !{guest, bot}") == {"T.r": {"$nin": ["guest", "bot"]}}
    assert parse_expression("T.n ~= '^Al'") == {"T.n": {"$regex": "^Al"}}


def test_coerce_and_sort():
    assert [coerce(x) for x in ("1", "-2.5", "true", "null", "'5'", "x")] == [1, -2.5, True, None, "5", "x"]
    assert parse_sort("-a,b:desc,c") == [("a", -1), ("b", -1), ("c", 1)]
    assert parse_sort([{"a": -1}, "b"]) == [("a", -1), ("b", 1)]


def test_no_limit():
    assert parse_url("a=1&$limit=none")["controls"] == {"$limit": None}
    with pytest.raises(QueryError):
        parse_url("$skip=none")
