"""The two text forms of a query: URLs, and the expressions of view declarations.

Both are read by recursive descent over one token stream.  In URLs ``&`` binds
tighter than ``^``; in expressions ``&&`` binds tighter than ``||``.
"""

from __future__ import annotations

import re
from typing import Any
from urllib.parse import unquote, unquote_plus

from ..errors import QueryError
from .sorting import parse_sort

_NUMBER = re.compile(r"-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z")
_AGG = re.compile(r"(\w+)\(([^()]*)\)(?::(.+))?\Z", re.S)
OPS = {"=": "$eq", "!=": "$ne", ">": "$gt", ">=": "$gte", "<": "$lt", "<=": "$lte", "~=": "$regex"}
_MIRROR = {"<": "$gt", "<=": "$gte"}


def coerce(text: str) -> Any:
    """null, true, false and numbers are themselves; quotes make text; all else is text."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[text]
    if _NUMBER.match(text) and not (len(text.lstrip("-")) > 1 and text.lstrip("-")[0] == "0" and text.lstrip("-")[1:2].isdigit()):
        return float(text) if re.search(r"[.eE]", text) else int(text)
    return text


def split_top(text: str, mark: str) -> list[str]:
    """Splits at a mark outside parentheses, braces, quotes and /patterns/."""
    parts, depth, start, i, quote = [], 0, 0, 0, ""
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\" and quote == "/":
                i += 1
            elif c == quote:
                quote = ""
        elif c == "/" and text[max(0, i - 2) : i] == "~=":
            quote = "/"
        elif c in "'\"":
            quote = c if text.find(c, i + 1) > 0 else ""
        elif c in "({":
            depth += 1
        elif c in ")}":
            depth -= 1
        elif not depth and text.startswith(mark, i):
            parts.append(text[start:i])
            i += len(mark)
            start = i
            continue
        i += 1
    if depth:
        raise QueryError("INVALID_QUERY", "unbalanced parentheses", text)
    return parts + [text[start:]]


def _condition(text: str, value=coerce) -> dict:
    text = text.strip()
    range_ = re.match(r"([^<>=!~{}()]+)(<=|<)([^<>=!~{}()]+)(<=|<)(.+)\Z", text, re.S)
    if range_:
        low, op1, name, op2, high = range_.groups()
        return {name.strip(): {_MIRROR[op1]: value(low), OPS[op2]: value(high)}}
    many = re.match(r"([^<>=!~{}()]+?)\s*(!?)\{(.*)\}\Z", text, re.S)
    if many:
        name, negated, items = many.groups()
        return {name.strip(): {"$nin" if negated else "$in": [value(x) for x in split_top(items, ",")] if items.strip() else []}}
    exists = re.match(r"([\w.]+)\s*(!?)\?\Z", text)
    if exists:
        return {exists[1]: {"$exists": not exists[2]}}
    plain = re.match(r"([^<>=!~{}()]+?)\s*(~=|!=|>=|<=|=|>|<)(.*)\Z", text, re.S)
    if not plain or not plain[1].strip():
        raise QueryError("INVALID_QUERY", "not a condition", text)
    name, op, rest = plain[1].strip(), plain[2], plain[3].strip()
    if op == "~=":
        return {name: {"$regex": rest[1:-1] if rest[:1] in "'\"" and rest[-1:] == rest[:1] else rest}}
    return {name: value(rest)} if op == "=" else {name: {OPS[op]: value(rest)}}


def _tree(text: str, either: str, both: str, leaf=_condition) -> dict:
    text = text.strip()
    parts = split_top(text, either)
    if len(parts) > 1:
        return {"$or": [_tree(p, either, both, leaf) for p in parts]}
    parts = [p for p in split_top(text, both) if p.strip()]
    if len(parts) > 1:
        return merged([_tree(p, either, both, leaf) for p in parts])
    if not parts:
        return {}
    text = parts[0].strip()
    if text.startswith("!(") and text.endswith(")"):
        return {"$not": _tree(text[2:-1], either, both, leaf)}
    if text.startswith("(") and text.endswith(")"):
        return _tree(text[1:-1], either, both, leaf)
    return leaf(text)


def merged(parts: list[dict]) -> dict:
    """One object if no field is named twice, else an ``$and``."""
    names = [k for p in parts for k in p]
    if len(names) == len(set(names)):
        return {k: v for p in parts for k, v in p.items()}
    return {"$and": parts}


def parse_expression(text: str) -> dict:
    """A view expression: fields are ``Table.field``, text values are quoted or bare."""
    return _tree(text, "||", "&&")


def _select(text: str) -> list:
    out: list = []
    for part in filter(None, (p.strip() for p in split_top(text, ","))):
        found = _AGG.match(part)
        if found:
            item = {"$fn": found[1], "$field": found[2].strip()}
            out.append(item | ({"$as": found[3]} if found[3] else {}))
        else:
            out.append(part)
    return out


def _with(text: str) -> list[dict]:
    out = []
    for part in filter(None, (p.strip() for p in split_top(text, ","))):
        name, bracket, rest = part.partition("(")
        spec: dict = {"name": name}
        if bracket:
            inner = parse_url(rest[:-1], decode=False)
            spec |= {"filter": inner["filter"], "controls": inner["controls"]}
        out.append(spec)
    return out


def parse_url(text: str, decode: bool = True) -> dict:
    """``{filter, controls}`` of a query string."""
    if decode:
        text = unquote(text.removeprefix("?"))
    controls: dict = {}
    filters: list[str] = []
    extra: list[dict] = []
    for part in split_top(text, "&"):
        if not part.startswith("$"):
            if part.strip():
                filters.append(part)
            continue
        name, _, value = part.partition("=")
        if name in ("$exists", "$!exists"):
            extra += [{f.strip(): {"$exists": name == "$exists"}} for f in value.split(",")]
        elif name == "$limit" and value == "none":
            controls[name] = None
        elif name in ("$skip", "$limit", "$page", "$size", "$fuzzy"):
            if not re.fullmatch(r"\d+", value):
                raise QueryError("INVALID_QUERY", "not a count", name)
            controls[name] = int(value)
        elif name in ("$threshold", "$maxDistance", "$minDistance"):
            controls[name] = float(value)
        elif name == "$center":
            controls[name] = [float(x) for x in value.split(",")]
        elif name == "$sort":
            controls[name] = dict(parse_sort(value))
        elif name == "$select":
            controls[name] = _select(value)
        elif name == "$groupBy":
            controls[name] = [x.strip() for x in value.split(",")]
        elif name == "$with":
            controls[name] = _with(value)
        elif name == "$having":
            controls[name] = _tree(value[1:-1] if value.startswith("(") else value, "^", "&")
        elif name in ("$count", "$actions"):
            controls[name] = value.lower() not in ("false", "0")
        elif name in ("$search", "$index", "$vector"):
            controls[name] = unquote_plus(value)
        else:
            raise QueryError("INVALID_QUERY", "unknown control", name)
    parts = [_tree(f, "^", "&") for f in ["&".join(filters)] if f] + extra
    return {"filter": merged(parts) if parts else {}, "controls": controls}
