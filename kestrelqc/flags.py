"""Flags and errors."""

from __future__ import annotations

PASS, FAIL, WARN = "Pass", "Fail", "Warn"
INCONCLUSIVE, INVALID, DATA_MISSING, ISOLATED = "Inconclusive", "Invalid", "DataMissing", "Isolated"
#: Every flag that a check can give.
FLAGS = (PASS, FAIL, WARN, INCONCLUSIVE, INVALID, DATA_MISSING, ISOLATED)


class InvalidInputShape(ValueError):
    """An input has too few values, or columns that do not fit together."""

    def __init__(self, what: str):
        super().__init__(f"{what}: too few values for the context that is asked for")
        self.what = what


class InvalidArg(ValueError):
    """A parameter is out of its range."""

    def __init__(self, name: str, reason: str):
        super().__init__(f"{name}: {reason}")
        self.name, self.reason = name, reason


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores after it as long as a column has it: a result never replaces a column of the input."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
