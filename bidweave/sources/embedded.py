"""JSON inside pages: the object after a marker, and objects by name at any depth of it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r'["{}\\]')


def balanced(text: str, start: int) -> str | None:
    """The object that opens at ``start``, or null if it never ends. Braces inside strings do not count."""
    depth, quoted, at = 0, False, start
    while (found := _STEP.search(text, at)) is not None:
        sign, at = found[0], found.end()
        if sign == "\\":
            at += quoted
        elif sign == '"':
            quoted = not quoted
        elif not quoted:
            depth += 1 if sign == "{" else -1
            if depth == 0:
                return text[start:at]
    return None


def object_after(text: str | None, marker: str) -> str | None:
    """The first object behind the first match of ``marker``."""
    found = re.search(marker, text or "", re.I)
    start = text.find("{", found.end()) if found else -1
    return None if start < 0 else balanced(text, start)


def embedded_object(body: Column, marker: str) -> Column:
    """The object that a page assigns behind ``marker``, as text; null where there is none or it is cut off."""

    @F.pandas_udf("string")
    def scan(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for page in pages:
            yield page.map(lambda text: object_after(text, marker))

    return scan(body)


def first_named(value: object, name: str) -> dict | None:
    """The first object, outer ones and earlier ones first, whose member "name" is ``name``."""
    waiting = [value]
    while waiting:
        here = waiting.pop()
        if isinstance(here, dict):
            if here.get("name") == name:
                return here
            waiting.extend(reversed(here.values()))
        elif isinstance(here, list):
            waiting.extend(reversed(here))
    return None


def named_object(document: Column, name: str) -> Column:
    """That object of a JSON text, at any depth and in the order of the text, as JSON; null where there is none."""

    def find(text: str | None) -> str | None:
        try:
            found = first_named(json.loads(text), name) if text else None
        except (ValueError, RecursionError):
            return None
        return None if found is None else json.dumps(found, ensure_ascii=False)

    @F.pandas_udf("string")
    def walk(documents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in documents:
            yield batch.map(find)

    return walk(document)
