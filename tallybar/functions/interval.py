"""Bar intervals written as digits and a unit."""

from __future__ import annotations

import re

UNITS = {"m": 60_000, "min": 60_000, "h": 3_600_000, "hour": 3_600_000, "d": 86_400_000, "day": 86_400_000}


def parse_interval(text: str) -> int:
    """Milliseconds of "5m", "1h", "1d" (units m, min, h, hour, d, day). Zero is rejected: no window has that length."""
    found = re.fullmatch(r"(\d*)(.*)", text.strip(), re.S)
    digits, unit = found.groups()
    if not text.strip():
        raise ValueError("empty interval")
    if not digits:
        raise ValueError(f"interval without a number: {text!r}")
    if not unit:
        raise ValueError(f"interval without a unit: {text!r}")
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r} in {text!r}")
    if int(digits) == 0:
        raise ValueError("interval of length zero")
    return int(digits) * UNITS[unit]
