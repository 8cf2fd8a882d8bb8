"""A worker's bounded memory of words it has already worked out."""

from __future__ import annotations

import weakref
from collections.abc import Callable

#: Entries of one generation; two are held.
LIMIT = 500_000

_ALL: weakref.WeakSet = weakref.WeakSet()
_using = ""


class Recent:
    """Values by key in two generations: when the young one is full it becomes the old one, and what is used moves up.

    A Python worker serves one operator after the other, so only the `owner` that it works for keeps its memories.
    """

    def __init__(self, owner: str, limit: int = LIMIT):
        self.owner, self.limit, self.young, self.old = owner, limit, {}, {}
        _ALL.add(self)

    def __reduce__(self):
        return Recent, (self.owner, self.limit)

    def _take_over(self) -> None:
        global _using
        if _using != self.owner:
            for other in _ALL:
                if other.owner != self.owner:
                    other.young, other.old = {}, {}
            _using = self.owner

    def ensure(self, keys: set, make: Callable[[list], list]) -> dict:
        """A mapping that holds every one of `keys`; `make` gives the values of those not remembered."""
        self._take_over()
        wanted = keys.difference(self.young)
        if len(self.young) + len(wanted) > self.limit:
            self.young, self.old = {}, self.young
            wanted = keys
        fresh = []
        for k in wanted:
            known = self.old.get(k)
            if known is None:
                fresh.append(k)
            else:
                self.young[k] = known
        if fresh:
            self.young.update(zip(fresh, make(fresh)))
        return self.young
