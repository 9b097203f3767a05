"""The window expressions of ``windows`` over whole entities as arrays.

A ``Values`` holds one number per (entity, place in the entity's day order), entities as rows, and
which of them are given.  Rows of unequal length are filled up behind their last day, where nothing that
looks backwards can see it.  Nulls follow SQL: arithmetic with one gives one, sums and deviations
pass over them.
"""

from __future__ import annotations

import numpy as np

Mask = np.ndarray | None


def both(a: Mask, b: Mask) -> Mask:
    return b if a is None else a if b is None else a & b


class Values:
    """``x`` with ``given``, False where null; ``given`` is None where there is no null."""

    __slots__ = ("x", "given")

    def __init__(self, x: np.ndarray, given: Mask = None):
        self.x, self.given = x, given

    def _with(self, other: "Values | float", f) -> "Values":
        if isinstance(other, Values):
            return Values(f(self.x, other.x), both(self.given, other.given))
        return Values(f(self.x, other), self.given)

    def __add__(self, other):
        return self._with(other, np.add)

    def __sub__(self, other):
        return self._with(other, np.subtract)

    def __mul__(self, other):
        return self._with(other, np.multiply)

    def __truediv__(self, other):
        return self._with(other, np.true_divide)

    def __abs__(self):
        return Values(np.abs(self.x), self.given)

    def floored(self, floor: float) -> "Values":
        return Values(np.maximum(self.x, floor), self.given)

    def clipped(self, low: float, high: float) -> "Values":
        """NaN is the greatest number."""
        return Values(np.fmin(np.maximum(self.x, low), high), self.given)

    def double(self) -> "Values":
        return Values(self.x.astype(np.float64), self.given)

    def filled(self) -> np.ndarray:
        """0 where null."""
        return self.x if self.given is None else np.where(self.given, self.x, self.x.dtype.type(0))


def _counts(v: Values) -> np.ndarray:
    """The given values so far."""
    if v.given is None:
        return np.broadcast_to(np.arange(1, v.x.shape[1] + 1), v.x.shape)
    return np.cumsum(v.given, axis=1)


def _before(x: np.ndarray, rows: int) -> np.ndarray:
    """What stood ``rows`` places earlier, 0 before the first."""
    out = np.zeros_like(x)
    out[:, rows:] = x[:, :-rows]
    return out


def running(v: Values) -> Values:
    """Running total of integers; null before the first given value."""
    x = v.filled()
    if x.size and np.abs(x.astype(np.float64)).sum(axis=1).max() > 9.2e18:
        raise OverflowError("an entity's total does not fit a long")
    return Values(np.cumsum(x, axis=1), None if v.given is None else np.logical_or.accumulate(v.given, axis=1))


def between(total: Values, rows: int) -> Values:
    """Sum over the last ``rows`` places from running totals."""
    return Values(total.x - _before(total.x, rows), total.given)


def trailing_sum(v: Values, rows: int) -> Values:
    """Sum over the last ``rows`` places, added from the oldest on; null where none is given."""
    x = v.filled()
    out = np.zeros_like(x)
    for back in range(min(rows, x.shape[1]) - 1, 0, -1):
        out[:, back:] += x[:, :-back]
    out += x
    if v.given is None:
        return Values(out)
    n = _counts(v)
    return Values(out, n > _before(n, rows))


def trailing_std(v: Values, rows: int) -> Values:
    """Sample deviation over the last ``rows`` places; 0 where fewer than two are given."""
    x, days = v.filled(), v.x.shape[1]
    n = _counts(v)
    n = n - _before(n, rows)
    mean = trailing_sum(Values(x), rows).x / np.maximum(n, 1)
    squares = np.zeros_like(x)
    for back in range(min(rows, days)):
        apart = x[:, : days - back] - mean[:, back:]
        apart *= apart
        squares[:, back:] += apart if v.given is None else np.where(v.given[:, : days - back], apart, 0.0)
    return Values(np.where(n > 1, np.sqrt(squares / np.maximum(n - 1, 1)), 0.0))


def expanding(v: Values) -> tuple[Values, Values]:
    """Mean and sample deviation so far; the deviation is 0 where fewer than two are given.

    Squared distances grow by the product of a value's distances from the mean before and after it.
    """
    x, n = v.filled(), _counts(v)
    mean = np.cumsum(x, axis=1) / np.maximum(n, 1)
    grown = (x - _before(mean, 1)) * (x - mean)
    grown[n < 2] = 0.0
    if v.given is not None:
        grown[~v.given] = 0.0
    # What was not finite stays so in every later mean.
    grown[(n < 2) & ~np.isfinite(mean)] = np.nan
    std = np.sqrt(np.maximum(np.cumsum(grown, axis=1), 0.0) / np.maximum(n - 1, 1))
    return Values(mean, None if v.given is None else n > 0), Values(np.where(n > 1, std, 0.0))


def days_since_last_positive(count: Values, day: Values, cap: int) -> Values:
    seen = (count.x > 0) if count.given is None else (count.x > 0) & count.given
    if day.given is not None:
        seen = seen & day.given
    last = np.maximum.accumulate(np.where(seen, np.arange(seen.shape[1]), -1), axis=1)
    known = last >= 0 if day.given is None else (last >= 0) & day.given
    since = day.x - np.take_along_axis(day.x, np.maximum(last, 0), axis=1)
    return Values(np.minimum(np.where(known, since, cap), cap).astype(np.float64))
