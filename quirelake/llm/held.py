"""Models that a Python worker builds once from a broadcast value and keeps for its later batches and tasks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_HELD: dict[str, tuple[Any, Any]] = {}


def held(kind: str, value: Any, build: Callable[[Any], Any]) -> Any:
    """The model of `value`, one for each kind; the value is kept beside it, so that another one can't be mistaken for it."""
    known = _HELD.get(kind)
    if known is None or known[0] is not value:
        known = _HELD[kind] = (value, build(value))
    return known[1]
