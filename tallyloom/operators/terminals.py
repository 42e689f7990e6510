"""What a filtered table can answer. Each takes a DataFrame of the store's columns and returns one."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.window import Window

from ..errors import BadRequest
from ..schema import NUMERIC, SEQ, TEXTUAL, Field, Schema

MAX_GROUPS = 4096
MAX_BUCKETS = 4096
MAX_DISTINCT = 1_000_000
MAX_K = 4096
MAX_VALUE_BYTES = 64 << 20
INT_MIN = -(1 << 63)


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def dense(rows: DataFrame, within: str) -> tuple[DataFrame, int]:
    """Rows with parts ``part_``, ordered within them by a column: a dense number n_ from 0 instead, and how many there are. Only the parts' sizes come to the driver."""
    sizes = sorted(tuple(r) for r in rows.groupBy("part_").count().collect())
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    if not at:
        return rows, 0
    offsets = rows.sparkSession.createDataFrame(starts, ST.StructType([rows.schema["part_"], ST.StructField("start_", ST.LongType())]))
    place = F.row_number().over(Window.partitionBy("part_").orderBy(within)) - 1
    numbered = rows.withColumn("in_", place).join(F.broadcast(offsets), "part_")  # one row for each part
    return numbered.withColumn("n_", F.col("start_") + F.col("in_")).drop("part_", "in_", "start_", "pos_"), at


#: Places of one part: rows of a part are numbered in one task.
PART = 1 << 20
#: Pages that end beyond are found by the sizes of parts, not by keeping the best of each task. Both ways give the same rows.
DEEP = 100_000


def part_of(seq: str) -> Column:
    """The part of a place. It depends on the place alone, so every run deals rows out alike."""
    return F.floor(F.col(seq) / PART).cast("long")


def place_of(df: DataFrame, seq: str, sizes: list[tuple[int, int]], n: int) -> int | None:
    """The place of row number n, from 0, in ingest order; None if there are fewer rows."""
    for part, size in sizes:
        if n < size:
            return df.filter((F.col(seq) >= part * PART) & (F.col(seq) < (part + 1) * PART)).select(seq).orderBy(seq).offset(n).limit(1).first()[0]
        n -= size
    return None


def rows(df: DataFrame, schema: Schema, select: list[str] | None = None, offset: int = 0, limit: int | None = None, seq: str = SEQ) -> DataFrame:
    """Rows in ingest order; columns in schema order, whatever the order or number of their names. The place stays as a column."""
    if offset + (limit or 0) > DEEP:
        sizes = sorted(tuple(r) for r in df.groupBy(part_of(seq).alias("part")).count().collect())
        first = place_of(df, seq, sizes, offset)
        last = None if limit is None else place_of(df, seq, sizes, offset + limit - 1)
        out = df.limit(0) if first is None else df.filter(F.col(seq) >= first).orderBy(seq)
        out = out if last is None else out.filter(F.col(seq) <= last)
    else:
        out = df.orderBy(seq)
        out = out.offset(offset) if offset else out
        out = out if limit is None else out.limit(limit)
    return out.select(seq, *(named(f.name) for f in schema.fields if select is None or f.name in select))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def key_text(field: Field, name: str | None = None) -> Column:
    """What tells values apart: floats by their bits, so that 0.0 and -0.0 are two."""
    c = named(name or field.name)
    return c.cast("string") if field.type == "float" else c


def distinct(df: DataFrame, field: Field) -> DataFrame:
    """Number of distinct values that are not null."""
    if field.type == "json":
        raise BadRequest("json has no distinct values")
    return df.agg(F.countDistinct(key_text(field)).alias("count"))


def key_order(field: Field, value: str) -> list[Column]:
    """Null first, then by value; -0.0 before 0.0."""
    order = [F.col(value).asc_nulls_first()]
    return [*order, F.col(value).cast("string").startswith("-").desc()] if field.type == "float" else order


def top_k(df: DataFrame, field: Field, k: int) -> DataFrame:
    """The most frequent values, null among them: rank, value, count."""
    if field.type == "json":
        raise BadRequest("json has no most frequent values")
    if not 1 <= k <= MAX_K:
        raise BadRequest(f"k must be from 1 to {MAX_K}")
    by = df.groupBy(key_text(field).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    if field.type == "float":
        by = by.withColumn("value", F.col("value").cast("double"))
    return ranked(by, [F.desc("count"), *key_order(field, "value")], k)


def check_distinct(df: DataFrame, field: Field) -> int:
    """How many distinct values there are, null among them; an error if they are too many, or too long together."""
    values = df.groupBy(key_text(field).alias("value")).agg(F.lit(1).alias("one"))
    size = F.sum(F.octet_length("value")) if field.type in TEXTUAL else F.lit(0)
    n, size = values.agg(F.count(F.lit(1)), size).first()
    if n > MAX_DISTINCT:
        raise BadRequest(f"more than {MAX_DISTINCT} distinct values")
    if (size or 0) > MAX_VALUE_BYTES:
        raise BadRequest(f"distinct values of more than {MAX_VALUE_BYTES} bytes")
    return n


def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """At most limit rows in an order, numbered from 1: one pass keeps the best of each task, then numbers those few."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def bucket_starts(start: int, end: int, width: int) -> tuple[int, int]:
    """First and last bucket start of a range; an error if there are too many."""
    if width < 1:
        raise BadRequest("the bucket width must be positive")
    first, last = start // width * width, end // width * width
    if first < INT_MIN:
        raise BadRequest("the first bucket does not fit in 64 bits")
    if (last - first) // width + 1 > MAX_BUCKETS:
        raise BadRequest(f"more than {MAX_BUCKETS} buckets")
    return first, last


def histogram(df: DataFrame, time: Column, start: int, end: int, width: int) -> DataFrame:
    """start_ms and count of every bucket that meets the range, also of empty ones; buckets are aligned to the epoch."""
    spark = df.sparkSession
    if start > end:
        return spark.createDataFrame([], "start_ms long, count long")
    first, last = bucket_starts(start, end, width)
    got = df.groupBy((time - F.pmod(time, F.lit(width))).alias("start_ms")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(width))).alias("start_ms"))
    # at most MAX_BUCKETS rows on either side
    return every.join(F.broadcast(got), "start_ms", "left").select("start_ms", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


@dataclass(frozen=True)
class StatRequest:
    field: str
    sum: bool = False
    min: bool = False
    max: bool = False
    var: bool = False
    stddev: bool = False


def ordered_sum(value: Column, seq: str = SEQ) -> Column:
    """The float sum that adding in ingest order gives; it holds the group's column in one place, so use it for bounded groups."""
    listed = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(seq).alias("s"), value.alias("x")))))
    return F.aggregate(listed, F.lit(0.0), lambda a, e: a + e["x"])


def unscaled(c: Column, scale: int) -> Column:
    """A number of at most 19 digits without its point, as a whole number; one with more is an error, as its square has no room."""
    if not scale:
        return c.cast("decimal(19,0)")
    if scale <= 17:  # the product keeps all digits
        return (c.cast(f"decimal(19,{scale})") * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast("decimal(19,0)")
    return (c * F.lit(10**scale).cast("decimal(38,0)")).cast("decimal(19,0)")


def moments(schema: Schema, requests: list[StatRequest], strict: bool = True, seq: str = SEQ) -> list[Column]:
    """The aggregates that the requests need, named field.what: n, sum, sum2 (of numbers without their point), min, max."""
    out = []
    for r in requests:
        f = schema[r.field]
        c = named(f.name)
        if f.type not in NUMERIC:
            raise BadRequest(f"field {f.name!r} is not numeric")
        out.append(F.count(c).alias(f"{f.name}.n"))
        if f.type == "float":
            total = (lambda x: ordered_sum(x, seq)) if strict else (lambda x: F.coalesce(F.sum(x), F.lit(0.0)))
            x, square = c, c * c
        else:
            # whole numbers, and decimals in their own scale, so that sums are exact and have 38 digits; squares are of unscaled numbers
            x = c.cast(f"decimal(38,{f.scale or 0})")
            small = unscaled(c, f.scale or 0)
            square = (small * small).cast("decimal(38,0)")
            total = lambda x, scale=0: F.coalesce(F.sum(x), F.lit(0).cast(f"decimal(38,{scale})"))
        if r.sum or r.var or r.stddev:
            out.append((total(x, f.scale) if f.scale else total(x)).alias(f"{f.name}.sum"))
        if r.var or r.stddev:
            out.append(total(square).alias(f"{f.name}.sum2"))
        if r.min:
            out.append(F.min(c).alias(f"{f.name}.min"))
        if r.max:
            out.append(F.max(c).alias(f"{f.name}.max"))
    return out


def check_group(field: Field) -> None:
    if field.type in ("float", "json"):
        raise BadRequest(f"field {field.name!r} cannot group rows")


def stats(df: DataFrame, schema: Schema, requests: list[StatRequest], by: str | None = None, strict: bool = True, seq: str = SEQ) -> DataFrame:
    """All requested aggregates in one pass, for all rows or by the values of one field (null is one)."""
    if not requests:
        raise BadRequest("no statistic is asked for")
    aggs = moments(schema, requests, strict, seq)
    if by is None:
        return df.agg(*aggs)
    check_group(schema[by])
    return df.groupBy(named(by).alias("key")).agg(*aggs)


def quantile_index(p: Decimal, n: int) -> int:
    """Place of the level among n sorted values, from 0."""
    return n - 1 if p == 1 else int((p * n).to_integral_value(ROUND_FLOOR))


#: So many rows are ranked by counting their values and adding up in one task.
RANKED = 1_000_000


def quantile(df: DataFrame, field: Field, p: Decimal) -> DataFrame:
    """The value at the level's place among the sorted values; no row if there is none.

    Two approximate quantiles about the level are literal bounds; exact counts
    below and between them tell where the place lies. The range between is
    narrowed likewise until few rows, or values that are one as a float, are
    left. No row is shuffled before that, and the bounds decide nothing but cost.
    """
    if field.type not in NUMERIC:
        raise BadRequest(f"field {field.name!r} is not numeric")
    c = named(field.name)
    rows = df.filter(c.isNotNull())
    total = rows.count()
    if not total:
        return rows.select(c.alias("value")).limit(0)
    place, x, level = quantile_index(p, total), c.cast("double"), float(p)  # as floats, values keep their order or become equal
    while total > RANKED:
        near = [max(0.0, level - 0.002), min(1.0, level + 0.002)]
        lo, hi = rows.agg(F.percentile_approx(x, F.array(*map(F.lit, near)), F.lit(10_000))).first()[0]
        ranges = [x < lo, x == lo, (x > lo) & (x < hi), (x == hi) & (x > lo), x > hi]
        sizes = rows.agg(*map(F.count_if, ranges)).first()
        for k, total in enumerate(sizes):
            if place < total:
                break
            place -= total
        rows, level = rows.filter(ranges[k]), place / total
        if k in (1, 3):
            break
    order = key_order(field, "value")
    values = rows.groupBy(key_text(field).alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.col("k").cast(field.spark).alias("value"), "n")
    upto = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return values.withColumn("upto", upto).filter((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)).select("value")


def latest(df: DataFrame, schema: Schema, by: str, select: list[str] | None = None, seq: str = SEQ) -> DataFrame:
    """The row of greatest time for each value of a field (null is one); of equal times the later in ingest order."""
    check_group(schema[by])
    names = [f.name for f in schema.fields if select is None or f.name in select]
    row = F.struct(*(named(n) for n in names))
    last = F.max_by(row, F.struct(named(schema.time_field), F.col(seq))).alias("row")
    return df.groupBy(named(by).alias("key")).agg(last).select("key", *(F.col("row")[n].alias(n) for n in names))


def keep_blocks(df: DataFrame, schema: Schema, cutoff: int, block: str = "_block") -> DataFrame:
    """Rows of the blocks whose latest row is at or after the cutoff: old rows stay beside a newer one."""
    live = df.groupBy(block).agg(F.max(named(schema.time_field)).alias("latest_")).filter(F.col("latest_") >= cutoff).select(block)
    return df.join(live, block, "left_semi")
