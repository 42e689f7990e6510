"""Filters: a time range and a conjunction of equalities, value lists and ranges."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..functions.values import INT_MAX, INT_MIN
from ..schema import NUMERIC, Field, Schema


EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Eq:
    """Equal to the value, or null where the value is None."""

    field: str
    value: Any


@dataclass(frozen=True)
class In:
    """Equal to one of the values; None among them matches null."""

    field: str
    values: tuple


@dataclass(frozen=True)
class Cmp:
    """op is gt, ge, lt or le; null never matches."""

    field: str
    op: str
    value: Any


Predicate = Eq | In | Cmp


def typed(field: Field, value: Any) -> Column:
    return F.lit(value).cast(field.spark)


def column(schema: Schema, p: Predicate) -> Column:
    """The predicate as a column. Comparisons are on the bare column, so that they reach the scan."""
    field = schema[p.field]
    c = F.col(f"`{field.name}`")
    if isinstance(p, Eq):
        return c.isNull() if p.value is None else c == typed(field, p.value)
    if isinstance(p, In):
        some = [v for v in p.values if v is not None]
        out = c.isin(*(typed(field, v) for v in some)) if some else F.lit(False)
        return out | c.isNull() if None in p.values else out
    if field.type not in NUMERIC:
        raise BadRequest(f"field {field.name!r} has no order")
    if p.value is None:
        raise BadRequest("a range needs a value")
    v = typed(field, p.value)
    return {"gt": c > v, "ge": c >= v, "lt": c < v, "le": c <= v}[p.op]


def contradictory(predicates: list[Predicate]) -> bool:
    """True if the ranges of one field exclude every value."""
    low: dict[str, tuple] = {}
    high: dict[str, tuple] = {}
    for p in predicates:
        if isinstance(p, Cmp):
            if p.op in ("gt", "ge"):
                low[p.field] = max(low.get(p.field, (p.value, False)), (p.value, p.op == "gt"))
            else:
                high[p.field] = min(high.get(p.field, (p.value, True)), (p.value, p.op == "le"))
    return any(f in high and (low[f][0] > high[f][0] or low[f][0] == high[f][0] and (low[f][1] or not high[f][1])) for f in low)


def condition(schema: Schema, start: int, end: int, predicates: list[Predicate] | tuple = ()) -> Column:
    """Time range, both ends included, and all predicates."""
    for n in (start, end):
        if not INT_MIN <= n <= INT_MAX:
            raise BadRequest("a time does not fit in 64 bits")
    if start > end or contradictory(list(predicates)):
        return F.lit(False)
    t = F.col(f"`{schema.time_field}`")
    return reduce(lambda a, b: a & b, [column(schema, p) for p in predicates], (t >= F.lit(start)) & (t <= F.lit(end)))


def timestamp_range(name: str, start: int, end: int) -> Column:
    """The same time range on a timestamp column without a zone, as bounds that a scan can use."""
    first, last = datetime(1, 1, 1), datetime(9999, 12, 31, 23, 59, 59, 999000)

    def bound(ms: int) -> Column:
        ms = min(max(ms, _millis(first)), _millis(last))
        return F.expr(f"timestamp_ntz'{(EPOCH + timedelta(milliseconds=ms)).isoformat(' ', 'milliseconds')}'")

    if start > end or start > _millis(last):
        return F.lit(False)
    return (F.col(name) >= bound(start)) & (F.col(name) < bound(end + 1))


def _millis(t: datetime) -> int:
    return (t - EPOCH) // timedelta(milliseconds=1)
