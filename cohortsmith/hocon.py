"""Objects written in HOCON, as far as requests need it: JSON with comments, root braces that may be left out, `=` or nothing
before an object in place of `:`, line ends in place of commas, keys with dots, unquoted strings, and objects that are merged
where a key comes again. Includes and substitutions are errors."""

from __future__ import annotations

import json
import re

_SPACE = re.compile(r"(?:[^\S\n]|(?://|#)[^\n]*)*")
_GAP = re.compile(r"(?:\s|(?://|#)[^\n]*)*")
_NEXT = re.compile(r"(?:[^\S\n]|(?://|#)[^\n]*)*[,\n](?:[\s,]|(?://|#)[^\n]*)*")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"')
_LONG = re.compile(r'"""(.*?)"""(?!")', re.DOTALL)
_KEY = re.compile(r"[^\s\"$#{}\[\]:=,+/]+")
_PLAIN = re.compile(r"(?:(?!//)[^\"$#{}\[\]:=,+\n])+")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")


def loads(text: str):
    """The value of a text; ValueError where it cannot be read."""
    at = _GAP.match(text, 0).end()
    value, at = _value(text, at) if text[at : at + 1] == "[" or text[at : at + 1] == "{" else _members(text, at, "")
    if (at := _GAP.match(text, at).end()) < len(text):
        raise _wrong(text, at)
    return value


def _wrong(text: str, at: int) -> ValueError:
    return ValueError(f"cannot read {text[at : at + 20]!r} at {at}")


def _value(text: str, at: int):
    if text[at : at + 1] == "{":
        return _members(text, at + 1, "}")
    if text[at : at + 1] == "[":
        return _items(text, at + 1)
    if m := _LONG.match(text, at):
        return m[1], m.end()
    if m := _STRING.match(text, at):
        return json.loads(m[0]), m.end()
    if not (m := _PLAIN.match(text, at)) or not (plain := m[0].strip()):
        raise _wrong(text, at)
    known = {"true": True, "false": False, "null": None}
    if plain in known:
        return known[plain], m.end()
    return (json.loads(plain) if _NUMBER.fullmatch(plain) else plain), m.end()


def _items(text: str, at: int) -> tuple[list, int]:
    out, at = [], _GAP.match(text, at).end()
    while text[at : at + 1] != "]":
        value, at = _value(text, at)
        out.append(value)
        at = _after(text, at, "]")
    return out, at + 1


def _members(text: str, at: int, end: str) -> tuple[dict, int]:
    out: dict = {}
    at = _GAP.match(text, at).end()
    while text[at : at + 1] != end:
        path, at = _path(text, at)
        at = _SPACE.match(text, at).end()
        if text[at : at + 1] in (":", "="):
            at = _GAP.match(text, at + 1).end()
        elif text[at : at + 1] != "{":
            raise _wrong(text, at)
        value, at = _value(text, at)
        for key in reversed(path):
            value = {key: value}
        _merge(out, value)
        at = _after(text, at, end)
    return out, at + len(end)


def _path(text: str, at: int) -> tuple[list[str], int]:
    if m := _STRING.match(text, at):
        return [json.loads(m[0])], m.end()
    if not (m := _KEY.match(text, at)):
        raise _wrong(text, at)
    return m[0].split("."), m.end()


def _after(text: str, at: int, end: str) -> int:
    """Behind a value: at the next one, or at the end."""
    if m := _NEXT.match(text, at):
        return m.end()
    at = _GAP.match(text, at).end()
    if text[at : at + 1] != end:
        raise _wrong(text, at)
    return at


def _merge(into: dict, more: dict) -> None:
    for k, v in more.items():
        if isinstance(v, dict) and isinstance(into.get(k), dict):
            _merge(into[k], v)
        else:
            into[k] = v
