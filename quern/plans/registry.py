"""Plug-ins by kind and name, factories named by file and function, and settings with dotted overrides."""

from __future__ import annotations

import dataclasses
import importlib.util
from collections.abc import Callable
from pathlib import Path

_known: dict[tuple[str, str], object] = {}


def register(kind: str, name: str) -> Callable:
    """A decorator that makes a class or function known under a kind ("dataset", "model", "policy", ...) and a name."""

    def keep(item):
        if (kind, name) in _known:
            raise ValueError(f"there is a {kind} {name} already")
        _known[kind, name] = item
        return item

    return keep


def find(kind: str, name: str):
    if (kind, name) not in _known:
        raise KeyError(f"no {kind} {name}; there are: {', '.join(sorted(n for k, n in _known if k == kind))}")
    return _known[kind, name]


def factory(spec: str) -> Callable:
    """The function that "file.py:function" names (without a function: "build")."""
    path, _, name = spec.partition(":")
    if not path.endswith(".py"):
        raise ValueError(f"{path} is no .py file")
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    found = importlib.util.spec_from_file_location(Path(path).stem, path)
    module = importlib.util.module_from_spec(found)
    found.loader.exec_module(module)
    if not callable(made := getattr(module, name or "build", None)):
        raise AttributeError(f"{path} has no function {name or 'build'}")
    return made


def override(config, settings: list[str]):
    """A copy of a (nested) dataclass with settings "a.b=value"; a leading "++" is allowed.  Values take the field's type."""
    for text in settings:
        name, sep, value = text.lstrip("+").partition("=")
        if not sep:
            raise ValueError(f"{text} sets nothing")
        config = _with(config, name.split("."), value)
    return config


def _with(config, path: list[str], value: str):
    fields = {f.name for f in dataclasses.fields(config)}
    if path[0] not in fields:
        raise KeyError(f"{type(config).__name__} has no {path[0]}")
    old = getattr(config, path[0])
    if len(path) > 1:
        return dataclasses.replace(config, **{path[0]: _with(old, path[1:], value)})
    if isinstance(old, bool):
        new = value.lower() in ("1", "true", "yes")
    elif isinstance(old, list | tuple):
        new = type(old)(x.strip() for x in value.strip("[]()").split(",") if x.strip())
    else:
        new = value if old is None else type(old)(value)
    return dataclasses.replace(config, **{path[0]: new})
