"""Deeply nested records into related flat tables, by interval labels.

Every record is walked once, depth first. Each node gets the number at which the walk enters it (pre) and the number at
which it leaves it (post): a node lies below another if and only if its interval lies within the other's. Nodes are emitted as
rows with their type, so each type is a flat table, and a child finds its parent, at any distance, by containment of
intervals within the record.

A `Shape` says which lists of a record are tables: a path of field names below the parent's item, and the name of the item's
type. Where a list is expected, records may hold the list itself, a map whose keys are positions (taken by number), a
map that wraps the list, a lone value (a list of one), JSON text in place of its value, or nothing.

Defined cases: null, blank and broken JSON and empty maps have no items; null and blank items keep their position and
are emitted with `empty` set; nesting beyond the shapes is walked and numbered, but has no type of its own. Depth has no
limit: where the parser's recursion ends, a parser, a writer and a walk with stacks of their own go on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import blank_to_null


@dataclass(frozen=True)
class Shape:
    """A list that becomes a table: items of `kind`, found at `path` below the parent's item; `wrap`: keys that wrap it."""

    kind: str
    path: tuple[str, ...] = ()
    wrap: tuple[str, ...] = ()
    children: tuple["Shape", ...] = field(default=())


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")


def parsed(text: str) -> object:
    """json.loads without recursion: open lists and objects are held on a stack, so depth is bounded by the text alone."""
    top: list = []
    stack: list[tuple[list | dict, str | None]] = [(top, None)]  # container, key waiting for its value
    at, end = _SPACE.match(text, 0).end(), len(text)
    state = "value"

    def put(v: object) -> None:
        box, key = stack[-1]
        if isinstance(box, dict):
            box[key] = v
        else:
            box.append(v)

    while state != "end":
        if at >= end:
            raise ValueError("text ends within a value")
        ch = text[at]
        box = stack[-1][0]
        if state == "value" or (state == "first" and isinstance(box, list) and ch != "]"):
            if ch in "[{":
                inner: list | dict = [] if ch == "[" else {}
                put(inner)
                stack.append((inner, None))
                state, at = "first", at + 1
            elif ch == '"':
                v, at = scanstring(text, at + 1)
                put(v)
                state = "after"
            elif m := _SCALAR.match(text, at):
                put(json.loads(m[0]))
                state, at = "after", m.end()
            else:
                raise ValueError(f"no value at {at}")
        elif state in ("first", "after") and ch == ("]" if isinstance(box, list) else "}") and len(stack) > 1:
            stack.pop()
            state, at = "after", at + 1
        elif isinstance(box, dict) and (state == "first" or (state == "after" and ch == ",")):
            at = at if state == "first" else _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != '"':
                raise ValueError(f"no key at {at}")
            key, at = scanstring(text, at + 1)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            stack[-1] = (box, key)
            state, at = "value", at + 1
        elif state == "after" and ch == "," and len(stack) > 1:
            state, at = "value", at + 1
        else:
            raise ValueError(f"unexpected {ch!r} at {at}")
        at = _SPACE.match(text, at).end()
        if state == "after" and len(stack) == 1:
            if at < end:
                raise ValueError(f"text after the value at {at}")
            state = "end"
    return top[0]


def written(value: object) -> str:
    """json.dumps(value, ensure_ascii=False) without recursion."""
    out: list[str] = []
    todo: list[object] = [value]
    raw = type("Raw", (str,), {})  # pieces of syntax among the values still to be written
    while todo:
        v = todo.pop()
        if isinstance(v, raw):
            out.append(v)
        elif isinstance(v, dict):
            todo.append(raw("}"))
            for i, (k, x) in enumerate(reversed(v.items())):
                todo += [x, raw(("" if i == len(v) - 1 else ", ") + json.dumps(k, ensure_ascii=False) + ": ")]
            out.append("{")
        elif isinstance(v, list):
            todo.append(raw("]"))
            for i, x in enumerate(reversed(v)):
                todo += [x] if i == len(v) - 1 else [x, raw(", ")]
            out.append("[")
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def load(text: object) -> object:
    """The value of JSON text, through all layers of text within text; None for blank or broken text."""
    while isinstance(text, str):  # every layer is shorter than the text around it
        if not text.strip():
            return None
        try:
            text = json.loads(text)
        except RecursionError:
            try:
                text = parsed(text)
            except ValueError:
                return None
        except ValueError:
            return None
    return text


def as_list(v: object, wrap: tuple[str, ...] = ()) -> list:
    while isinstance(v, dict) and len(v) == 1 and (k := next(iter(v))) in wrap:
        v = v[k]
    if isinstance(v, dict):
        if not v:
            return []
        if all(k.strip().isdigit() for k in v):
            return [v[k] for k in sorted(v, key=int)]
        return [v]
    if isinstance(v, list):
        return v
    return [] if v is None else [v]


def is_empty(v: object) -> bool:
    if isinstance(v, dict) and set(v) & {"text", "value", "name"}:
        v = next(v[k] for k in ("text", "value", "name") if k in v)
    return v is None or (isinstance(v, str) and not v.strip())


def as_text(v: object) -> str | None:
    """An item as text: text as it is, anything else as JSON."""
    if isinstance(v, str) or v is None:
        return v
    try:
        return json.dumps(v, ensure_ascii=False)
    except RecursionError:
        return written(v)


def label(value: object, shape: Shape) -> list[tuple[int, int, int, str, int, bool, str | None]]:
    """(pre, post, depth, kind, position, empty, JSON text) of the items of all shapes; the walk numbers every node."""
    out: list = []
    clock = 0

    def walk(v: object) -> None:
        nonlocal clock
        todo = [iter((v,))]  # one iterator for each open level
        while todo:
            for x in todo[-1]:
                clock += 1
                todo.append(iter(x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()))
                break
            else:
                todo.pop()
                clock += 1 if todo else 0

    def items(values: list, s: Shape, depth: int) -> None:
        nonlocal clock
        for position, v in enumerate(values, 1):
            clock += 1
            pre, slot = clock, len(out)
            out.append(None)
            if isinstance(v, dict):
                inner(v, s.children, depth + 1)
            else:
                walk(v)
            clock += 1
            out[slot] = (pre, clock, depth, s.kind, position, is_empty(v), as_text(v))

    def inner(v: dict, shapes: tuple[Shape, ...], depth: int) -> None:
        nonlocal clock
        for key, x in v.items():
            mine = [s for s in shapes if s.path and s.path[0] == key]
            clock += 1
            deeper = tuple(Shape(s.kind, s.path[1:], s.wrap, s.children) for s in mine if len(s.path) > 1)
            for s in mine:
                if len(s.path) == 1:
                    items(as_list(x, s.wrap), s, depth + 1)
            if isinstance(x, dict) and deeper:
                inner(x, deeper, depth + 1)
            elif not mine:
                walk(x)
            clock += 1

    if shape.path:
        if isinstance(value, dict):
            inner(value, (shape,), 0)
    else:
        items(as_list(value, shape.wrap), shape, 0)
    return out


def nodes(df: DataFrame, key: str, text: str, shape: Shape) -> DataFrame:
    """(key, pre, post, depth, kind, position, empty, value): the labelled items of every record; one pass, no shuffle."""
    d = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = d.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string()]
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                one = label(load(t), shape)
                rows += [i] * len(one)
                found += one
            cols = zip(*found) if found else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(list(c), t) for c, t in zip(cols, types)]],
                ["k", "pre", "post", "depth", "kind", "position", "empty", "value"],
            )

    schema = f"k {kind}, pre bigint, post bigint, depth int, kind string, position int, empty boolean, value string"
    return d.mapInArrow(run, schema).withColumnRenamed("k", key)


def list_nodes(df: DataFrame, key: str, column: str, kind: str) -> DataFrame:
    """What `nodes` gives for records that hold nothing but one list of texts (below one name), as a JVM expression: no parsing."""
    each = df.select(F.col(key), F.posexplode(column).alias("i", "value"))
    return each.select(
        key, (4 * F.col("i") + 2).cast("bigint").alias("pre"), (4 * F.col("i") + 5).cast("bigint").alias("post"), F.lit(1).alias("depth"), F.lit(kind).alias("kind"),
        (F.col("i") + 1).alias("position"), blank_to_null(F.col("value")).isNull().alias("empty"), "value",
    )


def link(parents: DataFrame, children: DataFrame, key: str, parent_position: str = "parent_position") -> DataFrame:
    """The children with the position of the parent whose interval contains theirs, in the same record."""
    p = parents.select(key, F.col("pre").alias("p_pre"), F.col("post").alias("p_post"), F.col("position").alias(parent_position))
    return children.join(p, key).where("p_pre < pre and post < p_post").drop("p_pre", "p_post")
