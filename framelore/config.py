"""Settings from JSON over the defaults of a dataclass."""

from __future__ import annotations

import dataclasses
import json


def settings(cls: type, found: dict, where: str = ""):
    """An instance of the dataclass with the values in found; what is missing keeps its default, an unknown name or another kind of value is an error. Nested dataclasses are objects."""
    held = cls()
    known = {f.name: getattr(held, f.name) for f in dataclasses.fields(cls)}
    values = {}
    for name, v in found.items():
        if name not in known:
            raise ValueError(f"unknown setting: {where}{name}")
        old = known[name]
        if dataclasses.is_dataclass(old) and isinstance(v, dict):
            v = settings(type(old), v, f"{where}{name}.")
        elif isinstance(old, float) and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        elif old is not None and type(v) is not type(old):
            raise ValueError(f"{where}{name} is to be {type(old).__name__}")
        values[name] = v
    return dataclasses.replace(held, **values)


def read(cls: type, path: str):
    with open(path) as f:
        return settings(cls, json.load(f))
