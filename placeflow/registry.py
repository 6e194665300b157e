"""Implementations chosen by name: contact extractors, schema repairs and sources."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

#: What can be chosen.
CAPABILITIES = ("fetcher", "extractor", "repair")


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, dict[str, Callable[..., Any]]] = {c: {} for c in CAPABILITIES}

    def register(self, capability: str, name: str, factory: Callable[..., Any]) -> None:
        self._known[capability][name] = factory

    def get(self, capability: str, name: str, **options: Any) -> Any:
        """A new implementation; KeyError names what there is."""
        try:
            return self._known[capability][name](**options)
        except KeyError:
            raise KeyError(f"no {capability} {name!r}; there are {self.names(capability)}") from None

    def has(self, capability: str, name: str) -> bool:
        return name in self._known.get(capability, {})

    def names(self, capability: str) -> list[str]:
        return sorted(self._known.get(capability, {}))

    def resolve(self, chosen: Mapping[str, str]) -> dict[str, Any]:
        return {capability: self.get(capability, name) for capability, name in chosen.items()}


def default() -> Registry:
    """With the library's own implementations."""
    from placeflow.functions import contacts
    from placeflow.operators import quality
    from placeflow.sources.recorded import RecordedSearch

    registry = Registry()
    registry.register("fetcher", "recorded", lambda: RecordedSearch)
    registry.register("extractor", "patterns", lambda: contacts.emails)
    registry.register("repair", "labels", lambda: quality._by_labels)
    return registry
