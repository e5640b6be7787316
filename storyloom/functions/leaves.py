"""The strings of JSON documents, by Arrow batches: any number of documents, of any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.workers import shipped

_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},"])|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity))')
_COLON, _SPACE = re.compile(r"[ \t\n\r]*:"), re.compile(r"[ \t\n\r]*\Z")
#: Rows of leaves that are handed back at once.
ROWS = 10_000


def _deep(text: str) -> Any:
    """json.loads() of a document nested deeper than that can follow; other values than strings are None."""
    root: list[Any] = []
    open_: list[list[Any]] = [[root]]  # containers not closed yet, an object with the key whose value is to come
    state, at = "value", 0
    while not (len(open_) == 1 and state == "after"):
        token = _TOKEN.match(text, at)
        if not token:
            raise ValueError("no JSON")
        sign, at, inner = token[1], token.end(), open_[-1]
        value: Any = None
        if sign == '"' and state != "after":
            value, at = scanstring(text, at, True)
        elif sign in ("[", "{") and state in ("value", "first"):
            value = [] if sign == "[" else {}
        if state in ("value", "first") and (sign in ("[", "{", '"') or token[2]):
            if isinstance(inner[0], list):
                inner[0].append(value)
            else:
                inner[0][inner.pop()] = value
            if sign in ("[", "{"):
                open_.append([value])
            state = {"[": "first", "{": "first key"}.get(sign, "after")
        elif state in ("key", "first key") and sign == '"':
            colon = _COLON.match(text, at)
            if not colon:
                raise ValueError("no JSON")
            inner.append(value)
            state, at = "value", colon.end()
        elif state in ("after", "first", "first key") and sign == ("]" if isinstance(inner[0], list) else "}"):
            open_.pop()
            state = "after"
        elif state == "after" and sign == ",":
            state = "value" if isinstance(inner[0], list) else "key"
        else:
            raise ValueError("no JSON")
    if not _SPACE.match(text, at):
        raise ValueError("no JSON")
    return root[0]


def parsed(text: str) -> Any:
    """A JSON document of any depth; ValueError if it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def strings(value: Any) -> Iterator[tuple[str, str]]:
    """(location, string) of the strings in a JSON value, in order, keys left out; the value itself is at $."""
    stack = [("$", value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, str):
            yield at, v
        elif isinstance(v, (dict, list)):
            inner = v.items() if isinstance(v, dict) else enumerate(v)
            stack.extend((f"{at}.{k}", x) for k, x in reversed(list(inner)) if isinstance(x, (str, dict, list)))


def json_strings(df: DataFrame, entity: str, column: str) -> DataFrame:
    """(entity, location, value, is_json) of every string at any depth of a column of JSON documents.

    A text that is no JSON document is one row of itself, at `text`, with is_json false; null has none. JSON is what Python's
    reader takes: NaN is a number, and of a repeated key the last value counts. Halves of surrogate pairs become question marks.
    """
    shipped(df.sparkSession)
    clean = lambda s: s.encode("utf-8", "replace").decode() if not s.isascii() else s

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str | None, str, str, bool]] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["entity", "location", "value", "is_json"])

        for some in batches:
            for entity_, text in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                text = text.as_py()
                if text is None:
                    continue
                try:
                    found = strings(parsed(text))
                except ValueError:
                    rows.append((entity_, "text", text, False))
                    found = iter(())
                for at, value in found:
                    rows.append((entity_, clean(at), clean(value), True))
                    if len(rows) >= ROWS:
                        yield batch()
                if len(rows) >= ROWS:
                    yield batch()
        if rows:
            yield batch()

    texts = df.select(F.col(entity).cast("string").alias("entity"), F.col(column).alias("text")).where("text is not null")
    return texts.mapInArrow(walk, "entity string, location string, value string, is_json boolean")
