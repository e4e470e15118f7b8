"""Structured filters over documents, compiled to a Column (to run) and to parameterised SQL text (to show and test).

A key "$.path" reads the metadata JSON by path; the plain keys date and uuid are columns. JSON values keep their type:
numbers compare with numbers (true and false are 1 and 0), texts with texts, and every text is greater than every
number. A path that is absent gives NULL, so no comparison holds for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {
    "Equals": "=", "NotEquals": "!=", "GreaterThan": ">", "LessThan": "<", "GreaterThanOrEquals": ">=", "LessThanOrEquals": "<=",
    "Like": "LIKE", "NotLike": "NOT LIKE", "Exists": "IS NOT NULL",
}
PLAIN_KEYS = ("date", "uuid")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class FilterError(ValueError):
    """A filter that names an unknown column or lacks a part."""


@dataclass(frozen=True)
class Condition:
    key: str
    operator: str
    value: str | float | None = None


@dataclass(frozen=True)
class Group:
    logic: str | None
    statements: tuple | None


@dataclass(frozen=True)
class Empty:
    """No restriction."""


Filter = Condition | Group | Empty


def all_of(*parts: Filter) -> Group:
    return Group("And", parts)


def any_of(*parts: Filter) -> Group:
    return Group("Or", parts)


def from_dict(spec: dict | None) -> Filter:
    """A filter from the nested dictionary form {type, condition{key, operator, value}, logic, statements}."""
    if spec is None:
        return Empty()
    kind = str(spec.get("type", "")).lower()
    if kind == "empty":
        return Empty()
    if kind == "condition":
        inner = spec.get("condition")
        if inner is None:
            raise FilterError("Condition type requires a condition field")
        return Condition(inner["key"], inner["operator"], inner.get("value"))
    if kind == "group":
        parts = spec.get("statements")
        return Group(spec.get("logic"), None if parts is None else tuple(from_dict(p) for p in parts))
    raise FilterError(f"Unknown statement type: {spec.get('type')!r}")


def _checked(f: Filter) -> Filter:
    if isinstance(f, Condition):
        if f.operator not in OPERATORS:
            raise FilterError(f"Unknown operator: {f.operator}")
        if not f.key.startswith("$.") and f.key not in PLAIN_KEYS:
            raise FilterError(f"Invalid column name: {f.key}")
        if f.operator != "Exists" and f.value is None:
            raise FilterError(f"Condition with operator {OPERATORS[f.operator]} requires a value")
    if isinstance(f, Group) and (f.logic not in ("And", "Or") or f.statements is None):
        raise FilterError("Group type requires logic and statements fields")
    return f


def to_sql(f: Filter | None) -> tuple[str, list]:
    """(SQL text, parameters); an empty filter is the empty text."""
    f = _checked(f or Empty())
    if isinstance(f, Empty):
        return "", []
    if isinstance(f, Condition):
        on_json = f.key.startswith("$.")
        left, params = ("json_extract(metadata, ?)", [f.key]) if on_json else (f'"{f.key}"', [])
        if f.operator == "Exists":
            return f"{left} {OPERATORS[f.operator]}", params
        return f"{left} {OPERATORS[f.operator]} ?", [*params, f.value]
    texts, params = [], []
    for part in f.statements:
        text, more = to_sql(part)
        if text:
            texts.append(text)
            params += more
    joined = f" {f.logic.upper()} ".join(texts)
    return (f"({joined})" if len(texts) > 1 else joined), params


def _like(text: Column, pattern: str) -> Column:
    """LIKE that folds A-Z only and knows no escape character."""
    return F.translate(text, UPPER, LOWER).like(pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\"))


def _number_text(value: float) -> str:
    return repr(float(value))


def _compare(left: Column, operator: str, right) -> Column:
    return {
        "Equals": lambda: left == right, "NotEquals": lambda: left != right, "GreaterThan": lambda: left > right, "LessThan": lambda: left < right,
        "GreaterThanOrEquals": lambda: left >= right, "LessThanOrEquals": lambda: left <= right,
    }[operator]()


def _on_json(f: Condition, metadata: Column) -> Column:
    """The condition on a metadata path; the item is bound to a name, so it is parsed once however often it is used."""
    item = F.try_variant_get(F.try_parse_json(metadata), f.key, "variant")
    return F.transform(F.array(item), lambda v: _on_item(f, v))[0]


def _on_item(f: Condition, item: Column) -> Column:
    kind = F.schema_of_variant(item)
    there = item.isNotNull() & (kind != "VOID")
    if f.operator == "Exists":
        return F.coalesce(there, F.lit(False))
    plain = ~kind.isin("STRING", "VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")
    shown = F.when(there, F.try_variant_get(item, "$", "string"))
    if f.operator in ("Like", "NotLike"):
        found = _like(shown, f.value if isinstance(f.value, str) else _number_text(f.value))
        return ~found if f.operator == "NotLike" else found
    if isinstance(f.value, str):
        numbers_are_less = F.lit(f.operator in ("NotEquals", "LessThan", "LessThanOrEquals"))
        return F.when(plain, numbers_are_less).otherwise(_compare(shown, f.operator, F.lit(f.value)))
    texts_are_greater = F.lit(f.operator in ("NotEquals", "GreaterThan", "GreaterThanOrEquals"))
    number = F.try_variant_get(item, "$", "double")
    return F.when(plain, _compare(number, f.operator, F.lit(float(f.value)))).when(there, texts_are_greater)


def predicate(f: Filter | None, metadata: str = "metadata") -> Column:
    """The filter as a boolean Column with SQL's three values; an empty filter is true."""
    f = _checked(f or Empty())
    if isinstance(f, Empty):
        return F.lit(True)
    if isinstance(f, Condition):
        if f.key.startswith("$."):
            return _on_json(f, F.col(metadata))
        column = F.col(f.key)
        if f.operator == "Exists":
            return column.isNotNull()
        value = f.value if isinstance(f.value, str) else _number_text(f.value)
        if f.operator in ("Like", "NotLike"):
            return ~_like(column, value) if f.operator == "NotLike" else _like(column, value)
        return _compare(column, f.operator, F.lit(value))
    parts = [predicate(p, metadata) for p in f.statements if to_sql(p)[0]]
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if f.logic == "And" else (lambda a, b: a | b), parts)


def facets(session: str | None = None, branch: str | None = None, exclude: tuple[str, ...] = (), since: str | None = None, types: tuple[str, ...] = (), dm: bool | None = None, unread: bool = False) -> Filter:
    """The filter of a faceted search: all the facets that are given must hold. since: an ISO date, compared as text.

    session: a session or channel id, a channel's #name, or a thread (thr:ts).
    """
    parts: list[Filter] = []
    if session is not None:
        name = session.removeprefix("#")
        parts.append(any_of(
            Condition("$.session_id", "Equals", session), Condition("$.channel_id", "Equals", session),
            Condition("$.channel_name", "Equals", name), Condition("$.conv_key", "Like", f"%-{name.removeprefix('thr:')}"),
        ))
    if branch is not None:
        parts.append(Condition("$.branch", "Equals", branch))
    parts += [Condition("$.session_id", "NotEquals", x) for x in exclude]
    if since is not None:
        parts.append(Condition("date", "GreaterThanOrEquals", since))
    if types:
        parts.append(any_of(*[Condition("$.source", "Equals", t) for t in types]))
    if dm is not None:
        parts.append(Condition("$.is_dm", "Equals", 1.0 if dm else 0.0))
    if unread:
        parts.append(Condition("$.has_unread", "Equals", 1.0))
    return all_of(*parts) if parts else Empty()
