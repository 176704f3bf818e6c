"""Named providers, resolved on the driver before anything is planned."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Factories by name, ignoring case."""

    def __init__(self, what: str):
        self.what = what
        self._factories: dict[str, tuple[str, Callable]] = {}

    def register(self, name: str, factory: Callable) -> None:
        self._factories[name.casefold()] = (name, factory)

    def names(self) -> list[str]:
        return [name for name, _ in self._factories.values()]

    def resolve(self, name: str, *args, **kwargs):
        found = self._factories.get(name.casefold())
        if found is None:
            raise LookupError(f"unknown {self.what} {name!r}; known: {', '.join(self.names())}")
        return found[1](*args, **kwargs)
