"""Typed options with ranges, checked once on the driver before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Option:
    """A whole number from ``least`` to ``most``, or one of ``allowed``; ``resets`` names what a change makes stale."""

    default: int
    least: int = 0
    most: int = 1
    allowed: tuple[int, ...] = ()
    resets: frozenset[str] = frozenset()


@dataclass
class Options:
    """Values by name. A wrong name or value raises and changes nothing; ``stale`` gathers what to set up anew."""

    known: dict[str, Option]
    #: (low, high): low may not pass high; setting one moves the other along.
    paired: tuple[tuple[str, str], ...] = ()
    values: dict[str, int] = field(default_factory=dict)
    stale: set[str] = field(default_factory=set)

    def __getitem__(self, name: str) -> int:
        return self.values.get(name, self.known[name].default)

    def set(self, name: str, value: int) -> None:
        option = self.known.get(name)
        if option is None:
            raise KeyError(f"no option {name!r}")
        good = value in option.allowed if option.allowed else option.least <= value <= option.most
        if not isinstance(value, int) or not good:
            raise ValueError(f"{name} can't be {value!r}")
        if value == self[name]:
            return
        self.values[name] = value
        self.stale |= option.resets
        for low, high in self.paired:
            if name == low and self[high] < value:
                self.values[high] = value
            if name == high and self[low] > value:
                self.values[low] = value

    def resolved(self) -> dict[str, int]:
        """All values, and nothing stale any more."""
        self.stale.clear()
        return {name: self[name] for name in self.known}
