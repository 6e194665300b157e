"""What can go wrong, by kind. Each error has `details`, a dict of what is known about it."""

from __future__ import annotations

from typing import Any


class PlacesError(Exception):
    """Any error of this library."""

    def __init__(self, message: str = "", **details: Any):
        super().__init__(message)
        self.details = details


class AuthError(PlacesError):
    """A recorded answer asks for a sign-in or consent."""


class RateLimitError(PlacesError):
    """A recorded answer refuses for too many requests; `details` may have retry_after, in seconds."""


class ParseError(PlacesError):
    """An answer that can't be read as what it should be."""


class NetworkError(PlacesError):
    """A request that found no answer."""


class RequestTimeoutError(NetworkError):
    """A request that was given up waiting for."""


class ConfigurationError(PlacesError, ValueError):
    """Settings that can't be used together."""


class NotFoundError(PlacesError, ValueError):
    """No such place or area is recorded."""


class DriftError(PlacesError, RuntimeError):
    """A batch failed its health check: the layout of answers has probably changed."""


def of(name: str | None, message: str = "", **details: Any) -> PlacesError:
    """The error that a recorded error's name stands for; names are told apart like `metrics.error_class` does."""
    low = (name or "").lower()
    if "rate" in low or "429" in low:
        return RateLimitError(message, **details)
    if "parse" in low:
        return ParseError(message, **details)
    if "timeout" in low:
        return RequestTimeoutError(message, **details)
    if "network" in low or "connect" in low:
        return NetworkError(message, **details)
    if "auth" in low or "consent" in low or "sign" in low:
        return AuthError(message, **details)
    return PlacesError(message or (name or ""), **details)
