"""What a Python worker keeps from task to task."""

from __future__ import annotations

from collections.abc import Callable, Hashable

_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """The object that ``make`` once gave for ``key`` in this process.

    Only the last key's object is kept: workers outlive a stage, and what the stages before have built would add up in the next one.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]
