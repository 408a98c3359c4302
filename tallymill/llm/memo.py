"""A bounded memory of what a pure function gave for short strings; each Python worker keeps its own across tasks."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice


class Memo(dict):
    """Maps a string to what ``fill`` gives for it.

    ``fill`` takes a list of different strings and returns their values in order. When there are too many entries the later half is
    dropped: common words come up early, so the earlier half is worth keeping. What was dropped is found again when asked for.
    """

    def __init__(self, fill: Callable[[list[str]], list[bytes]], most: int = 400_000):
        super().__init__()
        self.fill, self.most = fill, most

    def learn(self, keys: set[str]) -> None:
        """Makes these keys present, with one call for all that are new."""
        new = [k for k in keys if k not in self]
        if not new:
            return
        if len(self) + len(new) > self.most:
            early = list(islice(self.items(), self.most // 2))
            self.clear()
            self.update(early)
            new = [k for k in keys if k not in self]
        self.update(zip(new, self.fill(new), strict=True))

    def join(self, parts: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, parts))


class Recent(dict):
    """Maps a string to what ``find`` gives for it, found when it is first asked for.

    When there are ``most`` entries they become the older half, and what was older is dropped; what is asked for again moves to the newer half, so
    common strings stay.
    """

    def __init__(self, find: Callable[[str], bytes], most: int = 400_000):
        super().__init__()
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
