"""Flat tables from deeply nested records, by shared inlining.

The schema graph of a record type has an edge for each element that may lie inside another. Elements that occur at
most once inside exactly one parent are inlined into it as columns; an element gets a table of its own if it may be
repeated, has several kinds of parent (shared) or can contain itself (recursive). Each row of such a table carries
the kind and id of its parent, so that every path of the record can be rebuilt by joins.

The records come in several shapes of the same thing: one object instead of an array of one, a bare id instead of an
object, bare arrays for rows and texts for cells (numbered by position from 0), numbers as strings, absent, null and
empty fields. :func:`elements` reads all of them alike.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edge:
    """``child`` lies under ``name`` of its parent; ``many`` if it may be repeated there."""

    name: str
    child: str
    many: bool


@dataclass(frozen=True)
class Element:
    """One element type: its own fields (``name`` or ``name:type``), the elements inside it, and the field that a bare
    value stands for."""

    name: str
    typed: tuple[str, ...] = ()
    edges: tuple[Edge, ...] = ()
    bare: str | None = None

    @property
    def fields(self) -> list[tuple[str, str]]:
        """Names and SQL types."""
        return [(name, kind or "string") for name, _, kind in (f.partition(":") for f in self.typed)]


@dataclass(frozen=True)
class SchemaGraph:
    root: str
    elements: dict[str, Element] = field(default_factory=dict)

    def parents(self, name: str) -> list[tuple[str, Edge]]:
        return [(e.name, edge) for e in self.elements.values() for edge in e.edges if edge.child == name]

    def reaches(self, start: str, goal: str) -> bool:
        seen, todo = set(), [start]
        while todo:
            for edge in self.elements[todo.pop()].edges:
                if edge.child == goal:
                    return True
                if edge.child not in seen:
                    seen.add(edge.child)
                    todo.append(edge.child)
        return False

    def tables(self) -> list[str]:
        """Element types that get a table: the root, and repeated, shared and recursive ones."""
        out = []
        for name in self.elements:
            parents = self.parents(name)
            alone = len({p for p, _ in parents}) == 1 and not any(edge.many for _, edge in parents)
            if name == self.root or not alone or self.reaches(name, name):
                out.append(name)
        return out

    def columns(self, name: str) -> list[tuple[tuple[str, ...], str, str]]:
        """Paths, names and types of the columns of a table: its own fields and those of the elements inlined into it."""
        own = set(self.tables())
        out = []

        def visit(at: str, path: tuple[str, ...]) -> None:
            out.extend(((*path, f), "_".join((*path, f)), kind) for f, kind in self.elements[at].fields)
            for edge in self.elements[at].edges:
                if edge.child not in own:
                    visit(edge.child, (*path, edge.name))

        visit(name, ())
        return out


#: The parsed-document record.
DOCUMENT = SchemaGraph(
    "document",
    {
        e.name: e
        for e in (
            Element("document", (), (Edge("metadata", "metadata", False), Edge("parser_metadata", "parser_metadata", False), Edge("pages", "page", True), Edge("sections", "section", True), Edge("tables", "table", True))),
            Element("metadata", ("document_id", "filename", "source_path", "file_type", "page_count:int", "title", "author", "created_at")),
            Element("parser_metadata", ("parser_name", "parser_version", "parse_status", "parse_strategy")),
            Element("page", ("page_number:int", "width:double", "height:double", "parse_status"), (Edge("blocks", "block", True), Edge("tables", "table", True)), bare="page_number"),
            Element("section", ("section_id", "title", "level:int", "page_start:int", "page_end:int"), (Edge("blocks", "block", True), Edge("tables", "table", True), Edge("child_sections", "section", True)), bare="section_id"),
            Element("block", ("block_id", "page_number:int", "text", "block_type", "reading_order_index:int"), (Edge("bounding_box", "bounding_box", False),), bare="block_id"),
            Element("bounding_box", ("page_number:int", "x0:double", "y0:double", "x1:double", "y1:double", "coordinate_origin")),
            Element("table", ("table_id", "page_number:int", "caption", "native_text", "reading_order_index:int"), (Edge("rows", "row", True),), bare="table_id"),
            Element("row", ("row_index:int",), (Edge("cells", "cell", True),)),
            Element("cell", ("cell_id", "row_index:int", "column_index:int", "text", "row_span:int", "column_span:int", "is_header:boolean"), bare="text"),
        )
    },
)


def elements(value: Any) -> list[tuple[int, Any]]:
    """The elements in a field, with their positions: an array's, or the one that stands for an array of one."""
    if value is None:
        return []
    return [(i, v) for i, v in enumerate(value) if v is not None] if isinstance(value, list) else [(0, value)]


def _whole(value: Any) -> int | None:
    """A whole number, also one written as a string or with a zero fraction."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        number = float(value) if isinstance(value, str) else value
        return int(value) if isinstance(value, str) and value.strip().lstrip("+-").isdigit() else int(number) if number == int(number) else None
    except (ValueError, TypeError, OverflowError):
        return None


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_LITERALS = {"null": None, "true": True, "false": False, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def parse(text: str) -> Any:
    """The value of a JSON text of any depth; ValueError if it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> Any:
    """Like json.loads, with a stack of its own in place of the interpreter's."""

    def space(at: int) -> int:
        return _SPACE.match(text, at).end()

    def key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(f"no key at {at}")
        name, at = scanstring(text, at + 1, True)
        at = space(at)
        if text[at : at + 1] != ":":
            raise ValueError(f"no colon at {at}")
        return name, space(at + 1)

    top: list[Any] = []
    open_: list[tuple[Any, str | None]] = [(top, None)]
    at = space(0)
    while True:
        sign, inner = text[at : at + 1], None
        if sign in ("{", "["):
            value = inner = {} if sign == "{" else []
            at = space(at + 1)
        elif sign == '"':
            value, at = scanstring(text, at + 1, True)
        elif number := _NUMBER.match(text, at):
            value, at = (float if number.group(1) or number.group(2) else int)(number.group()), number.end()
        else:
            name = next((name for name in _LITERALS if text.startswith(name, at)), None)
            if name is None:
                raise ValueError(f"no value at {at}")
            value, at = _LITERALS[name], at + len(name)
        holder, name = open_[-1]
        if name is None:
            holder.append(value)
        else:
            holder[name] = value
        if inner is not None and text[at : at + 1] != ("}" if sign == "{" else "]"):
            name = None
            if sign == "{":
                name, at = key(at)
            open_.append((inner, name))
            continue
        if inner is not None:
            at += 1
        while True:
            at = space(at)
            if len(open_) == 1:
                if at < len(text):
                    raise ValueError(f"more than one value at {at}")
                return top[0]
            holder, name = open_[-1]
            sign = text[at : at + 1]
            if sign == ",":
                at = space(at + 1)
                if name is not None:
                    name, at = key(at)
                    open_[-1] = (holder, name)
                break
            if sign != ("]" if name is None else "}"):
                raise ValueError(f"neither a comma nor an end at {at}")
            open_.pop()
            at += 1


def _written(value: Any) -> str:
    """An object or array as JSON text with sorted keys, of any depth."""
    out, todo = [], [value]
    while todo:
        at = todo.pop()
        if isinstance(at, _Sign):
            out.append(str(at))
        elif isinstance(at, dict):
            todo.append(_Sign("}"))
            for i, name in enumerate(sorted(at, reverse=True)):
                todo += [at[name], _Sign(f"{json.dumps(name, ensure_ascii=False)}: ")] + ([_Sign(", ")] if i < len(at) - 1 else [])
            out.append("{")
        elif isinstance(at, list):
            todo.append(_Sign("]"))
            for i, inner in enumerate(reversed(at)):
                todo += [inner] + ([_Sign(", ")] if i < len(at) - 1 else [])
            out.append("[")
        else:
            out.append(json.dumps(at, ensure_ascii=False))
    return "".join(out)


class _Sign(str):
    """A piece of the text that is already written."""


def _text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return _written(value) if isinstance(value, dict | list) else str(value)


def _typed(value: Any, kind: str) -> str | None:
    """The text of a value of a column of this type; None if it is not of the type."""
    if kind == "int":
        number = _whole(value)
        return str(number) if number is not None and -(1 << 31) <= number < 1 << 31 else None
    if kind == "double":
        try:
            number = None if isinstance(value, bool) else float(value)
        except (TypeError, ValueError, OverflowError):
            return None
        return repr(number) if number is not None and math.isfinite(number) else None
    if kind == "boolean":
        return {"true": "true", "1": "true", "yes": "true", "false": "false", "0": "false", "no": "false"}.get((_text(value) or "").strip().lower())
    return _text(value)


def _identity(kind: str, body: dict[str, Any], at: int, parent_id: str, row: int) -> tuple[str | None, int]:
    """Id of an element, and its row number if it is a row or a cell."""
    if kind == "page":
        number = _whole(body.get("page_number"))
        return (str(number) if number is not None else _text(body.get("page_number"))), row
    if kind == "row":
        number = _whole(body.get("row_index"))
        number = at if number is None else number
        return f"{parent_id}-r{number}", number
    if kind == "cell":
        column = _whole(body.get("column_index"))
        return _text(body.get("cell_id")) or f"{parent_id}-c{at if column is None else column}", row
    return _text(body.get(f"{kind}_id")), row


def shred(document_id: str | None, text: str | None, graph: SchemaGraph = DOCUMENT, only: str | None = None) -> Iterator[tuple]:
    """Rows (table, document_id, parent kind, parent id, id, position, values) of one record, of the table ``only`` if
    one is named; none if unreadable."""
    try:
        record = parse(text) if text is not None else None
    except ValueError:
        return
    if not isinstance(record, dict):
        return
    own, columns = set(graph.tables()), {name: graph.columns(name) for name in graph.tables()}
    inside = record.get("metadata")
    name = _text(inside.get("document_id")) if isinstance(inside, dict) else None
    name = name or document_id

    def values(kind: str, body: dict[str, Any]) -> dict[str, str]:
        out = {}
        for path, column, type_ in columns[kind]:
            at: Any = body
            for step in path:
                at = at.get(step) if isinstance(at, dict) else None
            if at is not None:
                out[column] = _typed(at, type_)
        return out

    todo: list[tuple[str, dict[str, Any], str | None, int]] = [(graph.root, record, name, 0)]
    if only in (None, graph.root):
        yield graph.root, name, None, None, name, 0, values(graph.root, record)
    while todo:
        kind, body, parent_id, row = todo.pop()
        for edge in graph.elements[kind].edges:
            if edge.child not in own:
                continue
            shape = graph.elements[edge.child]
            for at, value in elements(body.get(edge.name)):
                if isinstance(value, dict):
                    inner = value
                elif isinstance(value, list):
                    inner = {"cells": value} if edge.child == "row" else {}
                else:
                    inner = {shape.bare: value} if shape.bare else {"cells": [value]}
                child_id, child_row = _identity(edge.child, inner, at, parent_id or "", row)
                if child_id is None:
                    continue
                if only in (None, edge.child):
                    yield edge.child, name, kind, parent_id, child_id, at, values(edge.child, inner)
                if shape.edges:
                    todo.append((edge.child, inner, child_id, child_row))


def flatten_records(records: DataFrame, key: str = "document_id", text: str = "parsed_document_json", graph: SchemaGraph = DOCUMENT, only: str | None = None) -> DataFrame:
    """All rows of all tables, or of the table ``only``: table, document_id, parent_kind, parent_id, child_id, position,
    ``values`` (a map).

    Narrow. Null, unreadable and non-object records give no rows; records sent twice give their rows twice (see
    :func:`flat_table` and :func:`links`, which count them once).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["table", "document_id", "parent_kind", "parent_id", "child_id", "position", "values"]
        for frame in frames:
            for start in range(0, len(frame), 200):
                part = frame.iloc[start : start + 200]
                rows = [row for key_, json_ in zip(part["key"], part["json"], strict=True) for row in shred(key_, json_, graph, only)]
                yield pd.DataFrame(rows, columns=names)

    schema = "table string, document_id string, parent_kind string, parent_id string, child_id string, position int, values map<string,string>"
    return records.select(F.col(key).alias("key"), F.col(text).alias("json")).mapInPandas(run, schema)


def flat_table(rows: DataFrame, name: str, graph: SchemaGraph = DOCUMENT) -> DataFrame:
    """The table of one element type: document_id, parent_kind, parent_id, {name}_id, position and its typed columns.

    Values of another type than their column's are null.
    """
    columns = [F.col("values")[column].try_cast(kind).alias(column) for _, column, kind in graph.columns(name) if column not in {f"{name}_id", "document_id"}]
    keys = [] if name == graph.root else ["parent_kind", "parent_id", F.col("child_id").alias(f"{name}_id"), "position"]
    return rows.where(F.col("table") == name).select("document_id", *keys, *columns).distinct()


def links(records: DataFrame, graph: SchemaGraph = DOCUMENT) -> DataFrame:
    """Distinct parent-child links of all readable records."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["document_id", "parent_kind", "parent_id", "child_kind", "child_id"]
        for frame in frames:
            for start in range(0, len(frame), 200):
                part = frame.iloc[start : start + 200]
                rows = {(row[1], row[2], row[3], row[0], row[4]) for key, json_ in zip(part["document_id"], part["parsed_document_json"], strict=True) for row in shred(key, json_, graph) if row[2] is not None}
                yield pd.DataFrame(list(rows), columns=names)

    schema = "document_id string, parent_kind string, parent_id string, child_kind string, child_id string"
    return records.select("document_id", "parsed_document_json").mapInPandas(run, schema).distinct()
