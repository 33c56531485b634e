"""Results kept by a worker between rows: the least recently used go first, and old ones expire."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable


class Kept:
    """At most ``most`` values, each for ``seconds`` (none: for ever)."""

    def __init__(self, most: int = 1000, seconds: float | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.seconds, self.clock = most, seconds, clock
        self.hits = self.misses = 0
        self._held: OrderedDict[Hashable, tuple[object, float]] = OrderedDict()

    def fetch(self, key: Hashable, make: Callable[[], object]) -> object:
        """The value kept for the key, or a new one."""
        found = self._held.get(key)
        if found is not None and (self.seconds is None or self.clock() - found[1] <= self.seconds):
            self.hits += 1
            self._held.move_to_end(key)
            return found[0]
        self.misses += 1
        value = make()
        self._held[key] = value, self.clock()
        self._held.move_to_end(key)
        while len(self._held) > self.most:
            self._held.popitem(last=False)
        return value

    def clear(self) -> None:
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)

    @property
    def rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0
