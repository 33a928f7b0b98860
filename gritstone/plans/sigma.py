"""Sigma rules compiled to Columns, so that a rule is part of the plan and runs in generated code.

Supported: selections as maps (all must hold), lists of maps or of keywords (any may hold), lists of
values (any, or all with the modifier ``all``), wildcards ``*`` and ``?``, the modifiers contains,
startswith, endswith, re, cased, cidr, lt, lte, gt, gte, exists, and conditions with and, or, not,
brackets, ``1 of``, ``all of`` and ``them``. Field names are looked up without regard to case; a
missing field never matches, also under ``not``'s operand.
"""

from __future__ import annotations

import fnmatch
import ipaddress
import re
from collections.abc import Callable

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

# Event ids and priorities of the default rule for critical events.
CRITICAL_PRIORITIES = [0, 1, 2, 3]
CRITICAL_EVENT_IDS = [
    1102, 4624, 4625, 4648, 4663, 4664, 4670, 4672, 4673, 4674, 4688, 4690, 4692, 4696, 4697, 4715, 4717, 4718, 4719, 4720, 4726, 4732, 4733, 4738, 4739, 4740,
    4756, 4757, 4768, 4769, 4771, 4776, 4778, 4779, 4902, 4904, 4905, 5140, 5145, 5148, 5156, 5157, 5158, 6272, 6273, 7036, 7045,
]

CRITICAL = {"title": "Critical events", "detection": {"selection": [{"PRIORITY": CRITICAL_PRIORITIES}, {"EventID": CRITICAL_EVENT_IDS}], "condition": "selection"}}

Lookup = Callable[[str], Column]


def map_lookup(fields: str = "fields", columns: tuple[str, ...] = ("host", "user", "message", "sequence", "source", "category", "service")) -> Lookup:
    """Looks names up in a map column, then among the event's own columns."""

    def lookup(name: str) -> Column:
        same = F.filter(F.map_entries(F.col(fields)), lambda e: F.lower(e["key"]) == name.lower())
        found = F.get(same, F.lit(0))["value"]
        return F.coalesce(found, F.col(name.lower())) if name.lower() in columns else found

    return lookup


def _pattern(value: str, before: str = "", after: str = "") -> str | None:
    """The regular expression of a value with wildcards; None if it has none and must be equal."""
    out, plain, k = [], True, 0
    while k < len(value):
        c = value[k]
        if c == "\\" and k + 1 < len(value) and value[k + 1] in "*?\\":
            out.append(re.escape(value[k + 1]))
            k += 1
        elif c in "*?":
            plain = False
            out.append(".*" if c == "*" else ".")
        else:
            out.append(re.escape(c))
        k += 1
    return None if plain and not before and not after else f"^{before}{''.join(out)}{after}$"


def _cidr(value: Column, network: str) -> Column:
    net = ipaddress.ip_network(network, strict=False)
    if net.version != 4:
        raise ValueError("only IPv4 networks can be compared")
    parts = F.split(value, "\\.")
    number = sum((F.try_element_at(parts, F.lit(k + 1)).try_cast("long") * (256 ** (3 - k)) for k in range(4)), F.lit(0).cast("long"))
    low = int(net.network_address)
    return (F.size(parts) == 4) & number.between(low, low + net.num_addresses - 1)


def _test(value: Column, wanted, modifiers: list[str]) -> Column:
    """Whether a field's value is as wanted; null where the field is missing."""
    if "exists" in modifiers:
        return value.isNotNull() if wanted else value.isNull()
    if wanted is None:
        return value.isNull() | (value == "")
    for name, compare in (("lte", Column.__le__), ("gte", Column.__ge__), ("lt", Column.__lt__), ("gt", Column.__gt__)):
        if name in modifiers:
            return compare(value.try_cast("double"), F.lit(float(wanted)))
    text = str(wanted).lower() if isinstance(wanted, bool) else str(wanted)
    if "re" in modifiers:
        return F.rlike(value, F.lit(text))
    if "cidr" in modifiers:
        return _cidr(value, text)
    cased = "cased" in modifiers
    value, text = (value, text) if cased else (F.lower(value), text.lower())
    literal = not re.search(r"[*?\\]", text)
    if literal:
        for name, test in (("contains", F.contains), ("startswith", F.startswith), ("endswith", F.endswith)):
            if name in modifiers:
                return test(value, F.lit(text))
    pattern = _pattern(text, "" if "startswith" in modifiers or not {"contains", "endswith"} & {*modifiers} else ".*", "" if "endswith" in modifiers or not {"contains", "startswith"} & {*modifiers} else ".*")
    return value == F.lit(re.sub(r"\\([*?\\])", r"\1", text)) if pattern is None else F.rlike(value, F.lit("(?s)" + pattern))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for x in tests:
        out = out & x
    return out


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for x in tests:
        out = out | x
    return out


def _field(key: str, wanted, lookup: Lookup) -> Column:
    name, *modifiers = key.split("|")
    value = lookup(name)
    tests = [F.coalesce(_test(value, x, modifiers), F.lit(False)) for x in (wanted if isinstance(wanted, list) else [wanted])]
    return _all(tests) if "all" in modifiers else _any(tests)


def selection(body, lookup: Lookup, message: str = "message") -> Column:
    """The Column of one selection."""
    if isinstance(body, dict):
        return _all([_field(k, v, lookup) for k, v in body.items()])
    if isinstance(body, list):
        return _any([selection(x, lookup, message) for x in body])
    return F.coalesce(_test(F.col(message), body, ["contains"]), F.lit(False))


def compile_rule(rule: dict | str, lookup: Lookup | None = None) -> Column:
    """The Column of a rule given as YAML or as its parsed form; true or false, never null."""
    rule = yaml.safe_load(rule) if isinstance(rule, str) else rule
    detection = dict(rule["detection"])
    conditions = detection.pop("condition")
    detection.pop("timeframe", None)
    parts = {name: selection(body, lookup or map_lookup()) for name, body in detection.items()}
    return _any([_condition(x, parts) for x in (conditions if isinstance(conditions, list) else [conditions])])


def _condition(text: str, parts: dict[str, Column]) -> Column:
    """Recursive descent over: or, and, not, brackets, ``1 of x*``, ``all of them``, names."""
    tokens = re.findall(r"\(|\)|[^\s()]+", text)
    at = 0

    def peek() -> str:
        return tokens[at].lower() if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        if at > len(tokens):
            raise ValueError(f"condition ends early: {text!r}")
        return tokens[at - 1]

    def either() -> Column:
        out = both()
        while peek() == "or":
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = single()
        while peek() == "and":
            take()
            out = out & single()
        return out

    def single() -> Column:
        word = take()
        if word.lower() == "not":
            return ~single()
        if word == "(":
            out = either()
            if take() != ")":
                raise ValueError(f"bracket not closed: {text!r}")
            return out
        if peek() == "of":
            take()
            which = take()
            chosen = [c for name, c in parts.items() if which.lower() == "them" and not name.startswith("_") or fnmatch.fnmatchcase(name, which)]
            if word.lower() == "all":
                return _all(chosen)
            count = sum((c.cast("int") for c in chosen), F.lit(0))
            return count >= (1 if word.lower() == "any" else int(word))
        if word not in parts:
            raise ValueError(f"unknown selection {word!r}")
        return parts[word]

    out = either()
    if at < len(tokens):
        raise ValueError(f"unexpected {tokens[at]!r} in {text!r}")
    return out
