"""Strict reading of plain JSON values into frozen records, and their canonical writing.

A record class lists its ``SHAPE``: for each key a reader and, if it may be missing, a default.  Readers never coerce:
a boolean is no number, a number no string.  All faults of a value are gathered, each with its place.
"""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from typing import Any

MUST = object()
Reader = Callable[[Any, str], Any]


class ShapeError(ValueError):
    """Faults as (place, kind, message); a kind is ``unknown_tag`` or ``invalid``."""

    def __init__(self, faults: list[tuple[str, str, str]]):
        super().__init__("; ".join(f"{p or '.'}: {m}" for p, _, m in faults))
        self.faults = faults

    @property
    def kinds(self) -> set[str]:
        return {k for _, k, _ in self.faults}


def fault(place: str, message: str, kind: str = "invalid") -> ShapeError:
    return ShapeError([(place, kind, message)])


def text(least: int = 0) -> Reader:
    def read(v: Any, at: str) -> str:
        if not isinstance(v, str) or len(v) < least:
            raise fault(at, "a string is needed" if not isinstance(v, str) else "the string is too short")
        return v

    return read


def integer(low: int | None = None, high: int | None = None) -> Reader:
    def read(v: Any, at: str) -> int:
        if type(v) is not int or low is not None and v < low or high is not None and v > high:
            raise fault(at, f"an integer in [{low}, {high}] is needed")
        return v

    return read


def number(positive: bool = False) -> Reader:
    def read(v: Any, at: str) -> float:
        if type(v) not in (int, float) or v != v or positive and v <= 0:
            raise fault(at, "a positive number is needed" if positive else "a number is needed")
        return float(v)

    return read


def boolean(v: Any, at: str) -> bool:
    if type(v) is not bool:
        raise fault(at, "true or false is needed")
    return v


def exactly(value: Any) -> Reader:
    def read(v: Any, at: str) -> Any:
        if type(v) is not type(value) or v != value:
            raise fault(at, f"only {value!r} is supported")
        return v

    return read


def choice(*values: str) -> Reader:
    def read(v: Any, at: str) -> str:
        if v not in values:
            raise fault(at, f"one of {', '.join(values)} is needed")
        return v

    return read


def instant(v: Any, at: str) -> datetime:
    if isinstance(v, datetime):
        return v
    if not isinstance(v, str):
        raise fault(at, "an ISO-8601 time is needed")
    try:
        return datetime.fromisoformat(v.replace("Z", "+00:00"))
    except ValueError:
        raise fault(at, "an ISO-8601 time is needed") from None


def listing(of: Reader, least: int = 0, most: int | None = None) -> Reader:
    def read(v: Any, at: str) -> tuple:
        if not isinstance(v, list | tuple):
            raise fault(at, "a list is needed")
        if len(v) < least or most is not None and len(v) > most:
            raise fault(at, f"the list needs {least} to {most or 'any number of'} items")
        return tuple(gather((of, x, f"{at}[{i}]") for i, x in enumerate(v)))

    return read


def mapping(of: Reader) -> Reader:
    def read(v: Any, at: str) -> dict:
        if not isinstance(v, Mapping) or any(not isinstance(k, str) for k in v):
            raise fault(at, "an object is needed")
        return dict(zip(v, gather((of, x, f"{at}.{k}") for k, x in v.items()), strict=True))

    return read


def anything(v: Any, at: str) -> Any:
    return v


def maybe(of: Reader) -> Reader:
    return lambda v, at: None if v is None else of(v, at)


def gather(jobs) -> list:
    out, faults = [], []
    for read, v, at in jobs:
        try:
            out.append(read(v, at))
        except ShapeError as e:
            faults += e.faults
    if faults:
        raise ShapeError(faults)
    return out


def record(cls: type) -> Reader:
    def read(v: Any, at: str) -> Any:
        if isinstance(v, cls):
            return v
        if not isinstance(v, Mapping):
            raise fault(at, "an object is needed")
        faults = [(f"{at}.{k}", "invalid", "the key is not known") for k in v if k not in cls.SHAPE]
        values = {}
        for name, spec in cls.SHAPE.items():
            reader, default = spec if isinstance(spec, tuple) else (spec, MUST)
            if name in v:
                try:
                    values[name] = reader(v[name], f"{at}.{name}")
                except ShapeError as e:
                    faults += e.faults
            elif default is MUST:
                faults.append((f"{at}.{name}", "invalid", "the key is missing"))
            else:
                values[name] = default() if callable(default) else default
        if faults:
            raise ShapeError(faults)
        out = cls(**values)
        for message in getattr(cls, "faults", lambda self: ())(out):
            raise fault(at, message)
        return out

    return read


def tagged(key: str, classes: Mapping[str, type]) -> Reader:
    def read(v: Any, at: str) -> Any:
        if isinstance(v, tuple(classes.values())):
            return v
        if not isinstance(v, Mapping) or key not in v:
            raise fault(at, f"an object with {key} is needed")
        cls = classes.get(v[key]) if isinstance(v[key], str) else None
        if cls is None:
            raise fault(f"{at}.{key}", f"{v[key]!r} is not known", "unknown_tag")
        return record(cls)(v, at)

    return read


class Record:
    """Base of records: ``read`` from plain values, ``plain`` back."""

    SHAPE: dict[str, Any] = {}

    @classmethod
    def read(cls, raw: Any) -> Any:
        return record(cls)(raw, "")

    def plain(self) -> dict:
        return {name: plain(getattr(self, name)) for name in self.SHAPE}

    def with_(self, **changes: Any) -> Any:
        return dataclasses.replace(self, **changes)


def plain(v: Any) -> Any:
    if isinstance(v, Record):
        return v.plain()
    if isinstance(v, datetime):
        out = v.isoformat()
        return re.sub(r"\+00:00$", "Z", out)
    if isinstance(v, Mapping):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, tuple | list):
        return [plain(x) for x in v]
    if isinstance(v, frozenset | set):
        return sorted(plain(x) for x in v)
    return v


def canonical(v: Any) -> str:
    """Sorted compact JSON."""
    return json.dumps(plain(v), sort_keys=True, separators=(",", ":"), default=str)


def utc(v: datetime) -> datetime:
    return v.replace(tzinfo=timezone.utc) if v.tzinfo is None else v.astimezone(timezone.utc)
