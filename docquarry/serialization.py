"""Documents as JSON and back: records carry `_type`, bytes are {"_bytes": base64}."""

from __future__ import annotations

import base64
import dataclasses
import types
import typing
from typing import Any

from .formats import record

TYPE = "_type"
_CLASSES = {c.__name__: c for c in vars(record).values() if dataclasses.is_dataclass(c)}


def to_json(value: Any, binary: bool = True) -> Any:
    """What json.dumps takes; without binary, bytes are null."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {TYPE: type(value).__name__} | {f.name: to_json(getattr(value, f.name), binary) for f in dataclasses.fields(value)}
    match value:
        case bytes() | bytearray():
            return {"_bytes": base64.b64encode(value).decode()} if binary else None
        case dict():
            return {str(k): to_json(v, binary) for k, v in value.items()}
        case list() | tuple() | set():
            return [to_json(v, binary) for v in value]
    return value


def _typed(value: Any, kind: Any) -> Any:
    if value is None:
        return None
    if isinstance(value, dict) and "_bytes" in value:
        return base64.b64decode(value["_bytes"])
    if isinstance(value, dict) and TYPE in value:
        return from_json(value)
    if isinstance(kind, types.UnionType):
        kind = next((k for k in typing.get_args(kind) if k is not type(None)), Any)
    origin, inner = typing.get_origin(kind), typing.get_args(kind)
    if isinstance(value, list):
        return [_typed(v, inner[0] if origin is list and inner else Any) for v in value]
    if isinstance(value, dict):
        return {k: _typed(v, inner[1] if origin is dict and inner else Any) for k, v in value.items()}
    if kind is bytes and isinstance(value, str):
        return base64.b64decode(value)
    return value


def from_json(value: Any) -> Any:
    """The record that to_json made this of. Fields that are missing get their defaults; without
    a known `_type` it's a ValueError."""
    if not isinstance(value, dict) or value.get(TYPE) not in _CLASSES:
        raise ValueError("no record of a known type")
    cls = _CLASSES[value[TYPE]]
    hints = typing.get_type_hints(cls)
    return cls(**{f.name: _typed(value[f.name], hints[f.name]) for f in dataclasses.fields(cls) if f.name in value})
