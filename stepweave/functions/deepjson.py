"""JSON of any depth in plain Python: the interpreter's own reader and writer where they reach, else ones without recursion."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?", re.A)
_WORDS = {"true": True, "false": False, "null": None}
_CONSTANTS = ("NaN", "Infinity", "-Infinity")


def loads(text: str, parse_constant: Callable[[str], object] | None = None) -> object:
    """As ``json.loads``, but without a limit of depth."""
    try:
        return json.loads(text, parse_constant=parse_constant)
    except RecursionError:
        return _read(text, parse_constant or float)


def _scalar(text: str, at: int, constant: Callable[[str], object]) -> tuple[object, int]:
    if text.startswith('"', at):
        return scanstring(text, at + 1, True)
    for word, value in _WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    for word in _CONSTANTS:
        if text.startswith(word, at):
            return constant(word), at + len(word)
    m = _NUMBER.match(text, at)
    if not m:
        raise json.JSONDecodeError("Expecting value", text, at)
    return (float if m.group(1) or m.group(2) else int)(m.group()), m.end()


def _read(text: str, constant: Callable[[str], object]) -> object:
    open_: list[tuple[object, str | None]] = []  # containers that aren't closed, with the key under which each awaits its value
    at = _SPACE.match(text).end()
    while True:
        mark = text[at : at + 1]
        if mark in ("{", "["):
            value: object = {} if mark == "{" else []
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if mark == "{" else "]"):
                key = None
                if mark == "{":
                    key, at = _key(text, at)
                open_.append((value, key))
                continue
            at += 1
        else:
            value, at = _scalar(text, at, constant)
        while True:  # a value is whole: it goes into what holds it, which may then be whole too
            at = _SPACE.match(text, at).end()
            if not open_:
                if at != len(text):
                    raise json.JSONDecodeError("Extra data", text, at)
                return value
            holder, key = open_.pop()
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            mark = text[at : at + 1]
            if mark == ",":
                at = _SPACE.match(text, at + 1).end()
                if isinstance(holder, dict):
                    key, at = _key(text, at)
                open_.append((holder, key))
                break
            if mark != ("}" if isinstance(holder, dict) else "]"):
                raise json.JSONDecodeError("Expecting ',' delimiter", text, at)
            value, at = holder, at + 1


def _key(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise json.JSONDecodeError("Expecting property name", text, at)
    key, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise json.JSONDecodeError("Expecting ':' delimiter", text, at)
    return key, _SPACE.match(text, at + 1).end()


def dumps(value: object, sort_keys: bool = False) -> str:
    """As ``json.dumps`` without ASCII escapes, but without a limit of depth."""
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=sort_keys)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]
    while todo:
        ready, v = todo.pop()
        if ready:
            out.append(v)
        elif isinstance(v, dict):
            parts: list[tuple[bool, object]] = [(True, "{")]
            for i, k in enumerate(sorted(v) if sort_keys else v):
                parts += [(True, (", " if i else "") + json.dumps(k, ensure_ascii=False) + ": "), (False, v[k])]
            todo.extend(reversed([*parts, (True, "}")]))
        elif isinstance(v, list):
            parts = [(True, "[")]
            for i, x in enumerate(v):
                parts += [(True, ", ")] * bool(i) + [(False, x)]
            todo.extend(reversed([*parts, (True, "]")]))
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def map_strings(value: object, change: Callable[[str], str]) -> object:
    """The value with every string in it (not the keys) changed; dicts and lists are changed in place."""
    if isinstance(value, str):
        return change(value)
    todo = [value]
    while todo:
        v = todo.pop()
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            if isinstance(x, str):
                v[k] = change(x)
            elif isinstance(x, (dict, list)):
                todo.append(x)
    return value
