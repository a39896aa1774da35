"""Filter strings -> Columns: FHIR search parameters, and a subset of the Lucene query syntax.

Names are looked up in the resource's fields; an unknown one is an error. A negation keeps rows whose
value is missing, as search engines do.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote_plus

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import RequestError


@dataclass(frozen=True)
class Field:
    """A value of a resource: an SQL expression over its table and the lookups it needs; kind: string, number, date, boolean, text or list."""

    expr: str
    kind: str = "string"
    lookups: tuple[str, ...] = ()

    def column(self) -> Column:
        return F.expr(self.expr)


Find = Callable[[str], Field]

#: Parameters of a search that don't filter.
_NO_FILTER = {"_count", "_elements", "_sort", "_total", "_summary", "_format", "_include", "_getpages", "_getpagesoffset"}
_PREFIX = re.compile(r"^(eq|ne|gt|ge|lt|le)(?=[-+\d])")
_COMPARE = {"eq": "=", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}


def literal(value: str, kind: str) -> Column:
    if kind == "number":
        try:
            return F.lit(float(value))
        except ValueError:
            raise RequestError(f"{value!r} is no number") from None
    if kind == "date":
        return F.lit(value.replace("Z", "+00:00") if "T" in value else value).cast("timestamp")
    if kind == "boolean":
        if value.lower() not in ("true", "false"):
            raise RequestError(f"{value!r} is neither true nor false")
        return F.lit(value.lower() == "true")
    return F.lit(value)


def compare(column: Column, operator: str, value: Column) -> Column:
    return {"=": column == value, "!=": column != value, ">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value}[operator]


def _day(value: str) -> bool:
    return re.fullmatch(r"\d{4}-\d\d-\d\d", value) is not None


def _against(field: Field, operator: str, value: str) -> Column:
    column = field.column()
    if field.kind == "date" and _day(value):
        return compare(F.to_date(column), operator, F.lit(value).cast("date"))
    return compare(column, operator, literal(value, field.kind))


def matches(field: Field, value: str) -> Column:
    """Equality; a token's system is not looked at; a trailing * stands for any rest."""
    column = field.column()
    if field.kind in ("string", "list"):
        value = value.rpartition("|")[2]
    if field.kind == "list":
        return F.array_contains(column, value) if not value.endswith("*") else F.exists(column, lambda x: x.startswith(value[:-1]))
    if field.kind == "text":
        return F.lower(column).contains(value.lower())
    if value == "*":
        return column.isNotNull()
    if field.kind == "string" and ("*" in value or "?" in value):
        return column.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in value) + "$")
    return _against(field, "=", value)


def negated(found: Column) -> Column:
    return ~F.coalesce(found, F.lit(False))


def fhir(text: str, find: Find) -> Column:
    """name[:modifier]=a,b&...: all parameters hold, each for one of its values."""
    keep = F.lit(True)
    for part in filter(None, text.split("&")):
        name, _, raw = part.partition("=")
        name, _, modifier = unquote_plus(name).partition(":")
        if name in _NO_FILTER:
            continue
        field = find(name)
        values = [re.sub(r"\\(.)", r"\1", v) for v in re.split(r"(?<!\\),", unquote_plus(raw))]
        if modifier == "missing":
            found = field.column().isNull() if values[0].lower() == "true" else field.column().isNotNull()
        else:
            found = F.lit(False)
            for v in values:
                found = found | _parameter(field, v, modifier)
        keep = keep & (negated(found) if modifier == "not" else found)
    return keep


def _parameter(field: Field, value: str, modifier: str) -> Column:
    if modifier == "contains":
        return F.lower(field.column()).contains(value.lower())
    if modifier == "exact":
        return field.column() == literal(value, field.kind)
    if modifier not in ("", "not", "text"):
        raise RequestError(f"unknown modifier {modifier!r}")
    prefix = _PREFIX.match(value) if field.kind in ("number", "date") else None
    if prefix:
        return _against(field, _COMPARE[prefix[1]], value[2:])
    if field.kind == "text":
        found = F.lit(True)
        for word in value.split():
            found = found & matches(field, word)
        return found
    return matches(field, value)


_TOKEN = re.compile(r'\s*(?:(?P<mark>[()\[\]{}])|(?P<quoted>"(?:\\.|[^"\\])*")|(?P<sign>[-+!](?=\S))|(?P<colon>:)|(?P<word>(?:\\.|[^\s()\[\]{}":\\])+))')


class _Lucene:
    """expression: clauses joined by OR (also if nothing stands between them) or AND, which binds closer."""

    def __init__(self, text: str, find: Find):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise RequestError(f"cannot read {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.find = 0, find

    def peek(self, k: int = 0):
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else (None, None)

    def take(self, value: str | None = None):
        kind, got = self.peek()
        if kind is None or (value is not None and got != value):
            raise RequestError(f"expected {value or 'more'}, not {got!r}")
        self.at += 1
        return kind, got

    def whole(self) -> Column:
        if not self.tokens:
            return F.lit(True)
        found = self.either(None)
        if self.peek()[0] is not None:
            raise RequestError(f"cannot read {self.peek()[1]!r}")
        return found

    def either(self, field: str | None) -> Column:
        wanted, unwanted = [], []
        while self.peek()[0] is not None and self.peek()[1] not in (")", "]", "}"):
            if self.peek() == ("word", "OR"):
                self.take()
                continue
            negative, found = self.both(field)
            (unwanted if negative else wanted).append(found)
        out = F.lit(True)
        if wanted:
            out = wanted[0]
            for x in wanted[1:]:
                out = out | x
        for x in unwanted:
            out = out & negated(x)
        return out

    def both(self, field: str | None) -> tuple[bool, Column]:
        parts = [self.clause(field)]
        while self.peek() in (("word", "AND"), ("word", "&&")):
            self.take()
            parts.append(self.clause(field))
        if len(parts) == 1:
            return parts[0]
        out = F.lit(True)
        for negative, x in parts:
            out = out & (negated(x) if negative else x)
        return False, out

    def clause(self, field: str | None) -> tuple[bool, Column]:
        negative = False
        while self.peek()[0] == "sign" or self.peek() == ("word", "NOT"):
            negative ^= self.take()[1] in ("-", "!", "NOT")
        kind, value = self.peek()
        if kind == "word" and self.peek(1)[0] == "colon":
            name = self.take()[1]
            self.take()
            if name == "*":
                self.take("*")
                return negative, F.lit(True)
            return negative, self.value(re.sub(r"\\(.)", r"\1", name))
        if value == "(":
            self.take()
            found = self.either(field)
            self.take(")")
            return negative, found
        if field is None:
            raise RequestError(f"{value!r} has no field")
        return negative, self.value(field)

    def value(self, name: str) -> Column:
        kind, value = self.peek()
        if value == "(":
            self.take()
            found = self.either(name)
            self.take(")")
            return found
        field = self.find(name)
        if value in ("[", "{"):
            self.take()
            low = self._bound()
            self.take("TO")
            high = self._bound()
            close = self.take()[1]
            found = F.lit(True)
            if low != "*":
                found = found & _against(field, ">=" if value == "[" else ">", low)
            if high != "*":
                found = found & _against(field, "<=" if close == "]" else "<", high)
            return found & field.column().isNotNull()
        kind, value = self.take()
        value = value[1:-1] if kind == "quoted" else value
        return matches(field, re.sub(r"\\(.)", r"\1", value))

    def _bound(self) -> str:
        """A bound may hold colons (times)."""
        kind, out = self.take()
        out = out[1:-1] if kind == "quoted" else out
        while self.peek()[0] == "colon":
            self.take()
            out += ":" + self.take()[1]
        return out


def lucene(text: str, find: Find) -> Column:
    """One query, or several as fq=...&fq=..., which all hold."""
    parts = [p[3:] for p in re.split(r"&(?=fq=)", text)] if text.startswith("fq=") else [text]
    keep = F.lit(True)
    for p in parts:
        keep = keep & _Lucene(p, find).whole()
    return keep
