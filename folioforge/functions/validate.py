"""Checks of driver-side input: a clear error before a job starts."""

from __future__ import annotations

import re


class InvalidInput(ValueError):
    """Input that a caller can mend."""


def text(value: object, label: str, required: bool = False, most: int = 100_000) -> str:
    """A text, or an error that says what is wrong with it."""
    if value is None and not required:
        return ""
    if not isinstance(value, str):
        raise InvalidInput(f"{label}: a text is expected")
    if any(0xD800 <= ord(c) <= 0xDFFF for c in value):
        raise InvalidInput(f"{label}: not valid Unicode")
    if len(value) > most:
        raise InvalidInput(f"{label}: at most {most} characters")
    if required and not value.strip():
        raise InvalidInput(f"{label}: must not be empty")
    return value


def items(value: object, label: str, most: int) -> list:
    """F38, Z23."""
    if not isinstance(value, list):
        raise InvalidInput(f"{label}: a list is expected")
    if len(value) > most:
        raise InvalidInput(f"{label}: at most {most} entries")
    return value


def identifier(value: object, label: str) -> str:
    """F38."""
    if not isinstance(value, str) or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,199}", value):
        raise InvalidInput(f"{label}: letters, digits, dots, hyphens and underscores only")
    return value


def flag(value: object, label: str) -> bool:
    """F38."""
    if not isinstance(value, bool):
        raise InvalidInput(f"{label}: true or false is expected")
    return value


# Providers that need no key, and the one that is no model.
KEYLESS, OFFLINE = ("ollama", "custom"), "offline"


def usable_profile(profile: dict) -> bool:
    """Whether a model profile is on and says all that a call needs."""
    provider = profile.get("provider")
    needed = ("baseUrl", "model") if provider in KEYLESS else ("baseUrl", "model", "apiKey")
    return bool(profile.get("enabled")) and provider != OFFLINE and all(profile.get(k) for k in needed)


def page(limit: object, offset: object, most: int = 100_000) -> tuple[int, int]:
    """Limit and offset of a listing, from numbers or digits."""
    out = []
    for value, label, least in ((limit, "limit", 1), (offset, "offset", 0)):
        if isinstance(value, str) and re.fullmatch(r"\d{1,9}", value):
            value = int(value)
        if not isinstance(value, int) or isinstance(value, bool) or not least <= value <= most:
            raise InvalidInput(f"{label}: a whole number from {least} to {most}")
        out.append(value)
    return out[0], out[1]
