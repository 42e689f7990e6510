"""Requests: a path and its parameters, checked before anything is read."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from decimal import Context, Decimal
from typing import Any
from urllib.parse import unquote_to_bytes

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequest, StoreError
from ..functions.values import INT_MAX, INT_MIN, exact_ratio, float_text, format_decimal, json_value, literal, parse_quantile, row_json
from ..operators import terminals as T
from ..operators.predicates import Cmp, Eq, In, Predicate, condition
from ..schema import NUMERIC, Schema
from ..sources.store import EventStore

RANGES = ("gt", "ge", "lt", "le")
STATS = ("sum", "min", "max", "var", "stddev")
FILTERS = ("from", "to", "eq", "in", *RANGES)
MAX_RESPONSE_BYTES = 64 << 20

#: Parameters of each path; those that are named as wrong there; whether unknown ones are wrong, too.
ROUTES = {
    "/events": ({"limit", "offset", "select"}, {"by", "latest", "distinct", "topk", "quantile"}, False),
    "/events/count": (set(), {"by", "latest", "distinct", "topk", "limit", "offset", "select", "quantile"}, False),
    "/events/histogram": ({"bucket_ms"}, {"by", "latest", "distinct", "topk", "limit", "offset", "select", "quantile"}, False),
    "/events/stats": ({*STATS, "by"}, set(), True),
    "/events/quantile": ({"field", "p"}, set(), True),
    "/events/distinct": ({"field"}, set(), True),
    "/events/topk": ({"field", "k"}, set(), True),
    "/events/latest": ({"by", "select"}, set(), True),
}


def decode(text: str) -> str:
    """Percent signs and plus signs of a query string; must be UTF-8."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        raise BadRequest("a percent sign needs two hex digits")
    try:
        return unquote_to_bytes(text.replace("+", " ")).decode()
    except UnicodeDecodeError:
        raise BadRequest("a parameter is not UTF-8") from None


def parameters(query: str) -> list[tuple[str, str]]:
    out = []
    for pair in query.split("&") if query else []:
        if pair:
            name, eq, value = pair.partition("=")
            out.append((decode(name), decode(value) if eq else ""))
    return out


def whole(name: str, text: str, least: int) -> int:
    if not re.fullmatch(r"[0-9]+", text, re.A) or not least <= int(text) <= INT_MAX:
        raise BadRequest(f"{name} must be a whole number from {least}")
    return int(text)


@dataclass(frozen=True)
class EventQuery:
    """A time range, predicates and one question about the rows in it."""

    start: int
    end: int
    predicates: tuple[Predicate, ...] = ()
    what: str = "/events"
    select: tuple[str, ...] | None = None
    limit: int | None = None
    offset: int = 0
    field: str | None = None
    by: str | None = None
    k: int = 0
    p: Decimal | None = None
    bucket_ms: int = 0
    stats: tuple[T.StatRequest, ...] = ()

    def where(self, *predicates: Predicate) -> EventQuery:
        return replace(self, predicates=(*self.predicates, *predicates))

    @staticmethod
    def parse(schema: Schema, path: str, query: str) -> EventQuery:
        if path not in ROUTES:
            raise BadRequest(f"unknown path {path}")
        known, wrong, strict = ROUTES[path]
        given = parameters(query)
        names = {n for n, _ in given}
        strict = strict or "select" in names and "select" in known
        for n in sorted(names):
            if n in wrong or strict and n not in known and n not in FILTERS:
                raise BadRequest(f"{path} has no parameter {n!r}")

        def one(name: str, needed: bool = True) -> str | None:
            values = [v for n, v in given if n == name]
            if len(values) > 1:
                raise BadRequest(f"{name} is given twice")
            if not values or not values[0]:
                if needed or values:
                    raise BadRequest(f"{name} is required")
                return None
            return values[0]

        def bound(name: str) -> int:
            text = one(name)
            if not re.fullmatch(r"[+-]?[0-9]+", text, re.A) or not INT_MIN <= int(text) <= INT_MAX:
                raise BadRequest(f"{name} must be a 64-bit integer")
            return int(text)

        q = EventQuery(bound("from"), bound("to"), tuple(filters(schema, given)), path)
        selected = [v for n, v in given if n == "select"]
        if "select" in known and selected:
            q = replace(q, select=tuple(schema[v].name for v in selected))
        if "limit" in known:
            limit, offset = one("limit", False), one("offset", False)
            q = replace(q, limit=whole("limit", limit, 1) if limit else None, offset=whole("offset", offset, 0) if offset else 0)
        if "bucket_ms" in known:
            q = replace(q, bucket_ms=whole("bucket_ms", one("bucket_ms"), 1))
            if q.start <= q.end:
                T.bucket_starts(q.start, q.end, q.bucket_ms)
        if "field" in known:
            f = schema[one("field")]
            if f.type == "json" or path == "/events/quantile" and f.type not in NUMERIC:
                raise BadRequest(f"field {f.name!r} cannot be used here")
            q = replace(q, field=f.name)
        if "k" in known:
            k = whole("k", one("k"), 1)
            if k > T.MAX_K:
                raise BadRequest(f"k may be {T.MAX_K} at most")
            q = replace(q, k=k)
        if "p" in known:
            q = replace(q, p=parse_quantile(one("p")))
        if "by" in known:
            by = one("by", path == "/events/latest")
            if by:
                T.check_group(schema[by])
                q = replace(q, by=by)
        if path == "/events/stats":
            asked: dict[str, set[str]] = {}
            for n, v in given:
                if n in STATS:
                    f = schema[v]
                    if f.type not in NUMERIC:
                        raise BadRequest(f"field {v!r} is not numeric")
                    asked.setdefault(v, set()).add(n)
            if not asked:
                raise BadRequest("no statistic is asked for")
            q = replace(q, stats=tuple(T.StatRequest(f.name, **{s: s in asked[f.name] for s in STATS}) for f in schema.fields if f.name in asked))
        return q

    # as DataFrames

    def filtered(self, store: EventStore) -> DataFrame:
        return store.table(self.start, self.end).filter(condition(store.schema, self.start, self.end, self.predicates))

    def frame(self, store: EventStore, strict: bool = True) -> DataFrame:
        """The answer as a DataFrame."""
        schema = store.schema
        if self.what == "/events/count" and not self.predicates:
            return store.count_between(self.start, self.end)
        df = self.filtered(store)
        if self.what == "/events":
            return T.rows(df, schema, list(self.select) if self.select else None, self.offset, self.limit)
        if self.what == "/events/count":
            return T.count(df)
        if self.what == "/events/histogram":
            return T.histogram(df, T.named(schema.time_field), self.start, self.end, self.bucket_ms)
        if self.what == "/events/stats":
            out = T.stats(df, schema, list(self.stats), self.by, strict)
            return out.orderBy(F.col("key").asc_nulls_first()) if self.by else out
        if self.what == "/events/quantile":
            return T.quantile(df, schema[self.field], self.p)
        if self.what == "/events/distinct":
            T.check_distinct(df.filter(T.named(self.field).isNotNull()), schema[self.field])
            return T.distinct(df, schema[self.field])
        if self.what == "/events/topk":
            T.check_distinct(df, schema[self.field])
            return T.top_k(df, schema[self.field], self.k).orderBy("rank")
        return T.latest(df, schema, self.by, list(self.select) if self.select else None).orderBy(F.col("key").asc_nulls_first())

    # as JSON text

    def answer(self, store: EventStore) -> str:
        """The answer as JSON text; errors where it has too many groups, values or bytes."""
        schema, df = store.schema, self.frame(store)
        try:
            return self._answer(schema, df)
        except StoreError:
            raise
        except Exception as e:
            if "ARITHMETIC_OVERFLOW" in str(e) or "NUMERIC_VALUE_OUT_OF_RANGE" in str(e):
                raise BadRequest("a sum does not fit") from None
            raise

    def _answer(self, schema: Schema, df: DataFrame) -> str:
        if self.what in ("/events", "/events/latest"):
            if self.by:
                few(df, T.MAX_GROUPS, "groups")
            return "[" + ",".join(bounded(row_json(schema, r, list(self.select) if self.select else None) for r in df.toLocalIterator())) + "]"
        if self.what in ("/events/count", "/events/distinct"):
            return json.dumps({"count": df.first()[0]}, separators=(",", ":"))
        if self.what == "/events/histogram":
            rows = sorted(tuple(r) for r in df.collect())
            return json.dumps({"buckets": [{"start_ms": s, "count": c} for s, c in rows]}, separators=(",", ":"))
        if self.what == "/events/quantile":
            found = df.first()
            return json_value(schema[self.field], found[0] if found else None)
        if self.what == "/events/topk":
            f = schema[self.field]
            return '{"values":[' + ",".join(f'{{"value":{json_value(f, r["value"])},"count":{r["count"]}}}' for r in df.collect()) + "]}"
        if not self.by:
            return f'{{"columns":{columns(schema, self.stats, df.first())}}}'
        groups = few(df, T.MAX_GROUPS, "groups")
        return '{"groups":[' + ",".join(f'{{"key":{json_value(schema[self.by], r["key"])},"columns":{columns(schema, self.stats, r)}}}' for r in groups) + "]}"


def few(df: DataFrame, most: int, what: str) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise BadRequest(f"more than {most} {what}")
    return rows


def bounded(parts: Iterable[str]) -> Iterable[str]:
    size = 0
    for p in parts:
        size += len(p.encode())
        if size > MAX_RESPONSE_BYTES:
            raise BadRequest("the answer is too large")
        yield p


def filters(schema: Schema, given: list[tuple[str, str]]) -> list[Predicate]:
    out: list[Predicate] = []
    lists: dict[str, list[Any]] = {}
    for name, value in given:
        if name != "eq" and name != "in" and name not in RANGES:
            continue
        column, eq, text = value.partition("=")
        if not eq or not column:
            raise BadRequest(f"{name} must be field=value")
        f = schema[column]
        if name == "in":
            if not text:
                raise BadRequest("in needs a value")
            lists.setdefault(f.name, []).append(literal(f, text))
        elif name == "eq":
            if not text and f.type not in ("string", "text"):
                raise BadRequest("eq needs a value")
            out.append(Eq(f.name, literal(f, text)))
        else:
            if f.type not in NUMERIC or text == "null":
                raise BadRequest(f"{name} needs a numeric field and value")
            out.append(Cmp(f.name, name, literal(f, text)))
    return out + [In(f, tuple(v)) for f, v in lists.items()]


def columns(schema: Schema, requests: tuple[T.StatRequest, ...], row: Any) -> str:
    """The statistics of one group as JSON text."""
    out = []
    for r in requests:
        f = schema[r.field]
        get = row.asDict().get
        n, parts = get(f"{f.name}.n"), []
        if r.sum:
            total = get(f"{f.name}.sum")
            if f.type == "float":
                parts.append(f'"sum":{float_text(total) if n else "0"}')
            else:
                parts.append(f'"sum":"{format_decimal(total, f.scale) if f.type == "decimal" and n else int(total)}"')
        for what in ("min", "max"):
            if getattr(r, what):
                parts.append(f'"{what}":{json_value(f, get(f"{f.name}.{what}"))}')
        if r.var or r.stddev:
            text, value = variance(f, n, get(f"{f.name}.sum"), get(f"{f.name}.sum2"))
            if r.var:
                parts.append(f'"var":{"null" if value is None else float_text(value) if f.type == "float" else json.dumps(text)}')
            if r.stddev:
                if value is not None and value < 0:
                    raise BadRequest("the variance is negative")
                parts.append(f'"stddev":{"null" if value is None else float_text(value**0.5)}')
        out.append(f'{json.dumps(f.name, ensure_ascii=False)}:{{{",".join(parts)}}}')
    return "{" + ",".join(out) + "}"


def variance(f, n: int, total, squares) -> tuple[str | None, float | None]:
    """Population variance: exact text for whole numbers and decimals, and as a float."""
    if not n:
        return None, None
    if f.type == "float":
        return None, squares / n - (total / n) * (total / n)
    # a decimal keeps its digits when its point moves; the context allows more than a sum has
    unscaled = int(Decimal(total).scaleb(f.scale or 0, Context(prec=80)))
    top, bottom = n * int(squares) - unscaled**2, n * n * 100 ** (f.scale or 0)
    return exact_ratio(top, bottom), top / bottom
