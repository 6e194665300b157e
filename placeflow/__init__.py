"""Local-business and geographic discovery data on Spark."""

from __future__ import annotations

from typing import Any

from placeflow.errors import AuthError, ConfigurationError, DriftError, NetworkError, NotFoundError, ParseError, PlacesError, RateLimitError, RequestTimeoutError

__all__ = ["AuthError", "ConfigurationError", "DriftError", "NetworkError", "NotFoundError", "ParseError", "Places", "PlacesError", "RateLimitError", "RequestTimeoutError", "Settings"]


def __getattr__(name: str) -> Any:
    """`Places` and `Settings` when they are asked for: Python workers import this package too, and need neither."""
    if name == "Places":
        from placeflow.api import Places

        return Places
    if name == "Settings":
        from placeflow.operators.collect import Settings

        return Settings
    raise AttributeError(name)
