"""Edits of JSON text at paths such as ``a.b{2}.c`` (``{}``: every element), batch by batch in Arrow.

Text that is no JSON gives null. A path that leads nowhere changes nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = re.compile(r"([^.{}]+)|\{(\d*)\}")


def steps(path: str) -> list[str | int | None]:
    """Names, indices, and None for every element."""
    return [name if name else int(i) if i else None for name, i in STEP.findall(path)]


def places(node, path: list) -> Iterator[tuple]:
    """(parent, key) of each place the path leads to; the last step need not exist yet."""
    head, *rest = path
    if isinstance(head, str):
        keys = [head] if isinstance(node, dict) else []
    else:
        keys = ([head] if head is not None else range(len(node))) if isinstance(node, list) else []
    for k in keys:
        if not rest:
            yield node, k
        elif (isinstance(k, str) and k in node) or (isinstance(k, int) and k < len(node)):
            yield from places(node[k], rest)


def edited(column: Column, change: Callable) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                doc = json.loads(text)
            except (TypeError, ValueError):
                return None
            change(doc)
            return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)

        return texts.map(one)

    return run(column)


def json_set(column: Column, *pairs: tuple[str, object]) -> Column:
    """Set values at paths whose parent is an object."""

    def change(doc):
        for path, value in pairs:
            for node, k in list(places(doc, steps(path))):
                if isinstance(node, dict):
                    node[k] = value

    return edited(column, change)


def json_delete(column: Column, *paths: str) -> Column:
    def change(doc):
        for path in paths:
            for node, k in reversed(list(places(doc, steps(path)))):
                if (isinstance(node, dict) and k in node) or (isinstance(node, list) and k < len(node)):
                    del node[k]

    return edited(column, change)


def grown(column: Column, pairs: tuple, spread: bool) -> Column:
    def change(doc):
        for path, value in pairs:
            for node, k in list(places(doc, steps(path))):
                target = node.get(k) if isinstance(node, dict) else node[k] if k < len(node) else None
                if not isinstance(target, list):
                    continue
                more = [value]
                if spread and isinstance(value, str):
                    try:
                        parsed = json.loads(value)
                        more = parsed if isinstance(parsed, list) else more
                    except ValueError:
                        pass
                target.extend(more)

    return edited(column, change)


def json_append(column: Column, *pairs: tuple[str, object]) -> Column:
    """Add one element to the arrays at the paths."""
    return grown(column, pairs, spread=False)


def json_extend(column: Column, *pairs: tuple[str, object]) -> Column:
    """As append, but text that holds a JSON array adds its elements."""
    return grown(column, pairs, spread=True)


def json_extract_all(column: Column) -> Column:
    """Map from path to text of all that a JSON text holds; arrays are named ``a{}`` and keep several values as a list."""

    @F.pandas_udf("map<string,string>")
    def run(texts: pd.Series) -> pd.Series:
        def plain(x) -> str:
            return x if isinstance(x, str) else json.dumps(x, separators=(",", ":"), ensure_ascii=False)

        def walk(node, path: str, out: dict[str, list]) -> None:
            if isinstance(node, dict):
                for k, v in node.items():
                    walk(v, f"{path}.{k}" if path else k, out)
            elif isinstance(node, list):
                for v in node:
                    walk(v, f"{path}{{}}", out)
            else:
                out.setdefault(path, []).append(node)

        def one(text):
            try:
                doc = json.loads(text)
            except (TypeError, ValueError):
                return None
            out: dict[str, list] = {}
            walk(doc, "", out)
            return {k: None if v == [None] else plain(v[0]) if len(v) == 1 else "[" + ", ".join(map(plain, v)) + "]" for k, v in out.items()}

        return texts.map(one)

    return run(column)
