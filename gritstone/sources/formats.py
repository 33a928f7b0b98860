"""JSON, JSON lines and XML: detection and layout."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_valid(text: Column) -> Column:
    """One JSON value and nothing else; the parser alone stops behind the first value.

    Within an array and within an object, whatever follows the value breaks one of the two.
    """
    array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce(array.isNotNull() & member.isNotNull() & F.try_variant_get(array, "$[1]", "variant").isNull() & (F.trim(text) != ""), F.lit(False))


def is_json(text: Column) -> Column:
    """Begins with a bracket or brace and is valid."""
    return F.coalesce(F.rlike(text, F.lit(r"^[{\[]")), F.lit(False)) & is_valid(text)


def is_json_lines(text: Column) -> Column:
    """The first line is a valid JSON value of any kind."""
    return is_valid(F.substring_index(text, "\n", 1))


def is_xml(text: Column) -> Column:
    return F.startswith(text, F.lit("<?xml "))


def kind(text: Column) -> Column:
    """json, jsonl or xml, tried in this order; null for other text."""
    return F.when(is_json(text), "json").when(is_json_lines(text), "jsonl").when(is_xml(text), "xml")


def _indent(text: str) -> str:
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return text


def _indent_xml(text: str) -> str:
    from xml.dom import minidom
    from xml.parsers.expat import ExpatError

    try:
        tree = minidom.parseString(text.encode())
    except ExpatError:
        return text
    # what stands between elements is layout and goes; text loses blanks at its ends
    todo = [tree]
    while todo:
        node = todo.pop()
        for child in list(node.childNodes):
            if child.nodeType == child.TEXT_NODE:
                child.data = child.data.strip()
                if not child.data:
                    node.removeChild(child)
        todo += node.childNodes
    return tree.toprettyxml(indent="  ").rstrip("\n")


@F.pandas_udf(T.StringType())
def _pretty(text: pd.Series, kind: pd.Series) -> pd.Series:
    def one(t, k):
        if t is None or k is None:
            return t
        if k == "jsonl":
            return "\n".join(_indent(x) for x in t.rstrip("\n").split("\n"))
        return _indent(t) if k == "json" else _indent_xml(t)

    return pd.Series([one(t, k) for t, k in zip(text, kind, strict=True)])


def pretty(text: Column) -> Column:
    """Indented by two blanks; invalid lines and other text stay as they are."""
    return _pretty(text, kind(text))
