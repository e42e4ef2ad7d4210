"""Names of derived columns, and what they tell: pure string functions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

DERIVED = ("_momentum", "_perc", "_cross", "_differenced")


def as_list(value: str | Iterable[str] | None) -> list[str]:
    """A name, or names, as a list; None gives an empty one."""
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def lag_suffix(lag: int) -> str:
    return f"_lag{lag}" if lag else ""


def group_part(group: str | None) -> str:
    return f"_{group}" if group else ""


def lagged(feature: str, lag: int) -> str:
    return f"{feature}_lag{lag}"


def differenced(feature: str, periods: int) -> str:
    return f"{feature}_differenced_{periods}"


def rolled(feature: str, aggregation: str, window: int, lag: int, group: str | None = None) -> str:
    return f"{feature}_{aggregation}{group_part(group)}_roll{window}{lag_suffix(lag)}"


def smoothed(feature: str, window: int, lag: int, group: str | None = None) -> str:
    return f"{feature}{group_part(group)}_ewma_roll{window}{lag_suffix(lag)}"


def crossed(feature: str, small: int, large: int, lag: int, group: str | None = None) -> str:
    return f"{smoothed(feature, small, lag, group)}_cross{large}"


def share_of_threshold(feature: str, operator: str, threshold: float, window: int, lag: int, group: str | None = None) -> str:
    shown = int(threshold) if float(threshold).is_integer() else threshold
    return f"{feature}{group_part(group)}_perc_{operator}{shown}_roll{window}{lag_suffix(lag)}"


def changed(feature: str, lag: int, group: str | None = None) -> str:
    return f"{feature}{group_part(group)}_pct_change_lag{lag}"


def number_after(name: str, mark: str) -> int | None:
    """The integer that follows the last `mark` of a name, if that is all that follows it."""
    tail = name.rpartition(mark)[2] if mark in name else ""
    return int(tail) if re.fullmatch(r"\d+", tail) else None


def containing(names: Iterable[str], parts: str | Iterable[str]) -> list[str]:
    """The names that hold any of the parts."""
    return [n for n in names if any(p in n for p in as_list(parts))]


def too_short_lags(columns: Iterable[str], min_lags: Mapping[str, int] | None, target: str | None = None) -> list[str]:
    """Columns that would leak: they start with a feature of min_lags, and what follows their last
    `_lag` is no integer of at least its threshold.  The target itself stays."""
    out = []
    for column in columns:
        for feature, least in (min_lags or {}).items():
            if column.startswith(feature) and column not in (target, feature):
                lag = number_after(column, "_lag")
                if lag is None or lag < least:
                    out.append(column)
                    break
    return out
