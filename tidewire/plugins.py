"""Queries of others' making, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .plans.stream import Stream


@dataclass(frozen=True)
class Plugin:
    """``solve`` answers a request from a stream; ``merge`` puts answers of several streams together, ``done`` finishes."""

    name: str
    solve: Callable[..., DataFrame]
    merge: Callable[[list[DataFrame]], DataFrame] | None = None
    done: Callable[[DataFrame], DataFrame] | None = None


_PLUGINS: dict[str, Plugin] = {}


def register_plugin(name: str, solve: Callable[..., DataFrame], merge=None, done=None) -> Plugin:
    if name in _PLUGINS:
        raise ValueError(f"there is a plugin {name} already")
    _PLUGINS[name] = Plugin(name, solve, merge, done)
    return _PLUGINS[name]


def ask(name: str, streams: Stream | list[Stream], **request) -> DataFrame:
    """The plugin's answer for one stream, or for several if it can merge."""
    p = _PLUGINS[name]
    many = streams if isinstance(streams, list) else [streams]
    if len(many) > 1 and p.merge is None:
        raise ValueError(f"{name} answers for one stream only")
    answers = [p.solve(s, **request) for s in many]
    out = answers[0] if len(answers) == 1 else p.merge(answers)
    return p.done(out) if p.done else out


def names() -> list[str]:
    return sorted(_PLUGINS)
