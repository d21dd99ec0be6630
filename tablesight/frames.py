"""Named frames that are built on first use."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class Frames(Mapping):
    """What a pack publishes: names, each with a function that builds its frame.

    Naming the frames runs nothing.  A frame is built when it is first asked for
    and kept; work that several of them need (``shared``) is done once, by the
    first.  Iterating over ``items()`` builds the frames one after the other.
    """

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]] | None = None):
        self._makers: dict[str, Callable[[], DataFrame]] = dict(makers or {})
        self._built: dict[str, DataFrame] = {}

    def __setitem__(self, name: str, maker: Callable[[], DataFrame]) -> None:
        if not callable(maker):
            raise TypeError(f"{name}: a function that builds the frame, not {type(maker).__name__}")
        self._makers[name] = maker
        self._built.pop(name, None)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._makers[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def adopt(self, other: Mapping[str, DataFrame], prefix: str = "") -> Frames:
        """Add the frames of another mapping, unbuilt, under prefixed names."""
        for name in other:
            self[prefix + name] = lambda name=name: other[name]
        return self


def shared(make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """``make`` with its result kept from the first call on."""
    held: list[DataFrame] = []

    def get() -> DataFrame:
        if not held:
            held.append(make())
        return held[0]

    return get
