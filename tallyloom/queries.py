"""The registered queries over the events table, with SQL for each that SQL can express."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import StoreError
from .functions.values import INT_MAX, INT_MIN, exact_ratio
from .operators import terminals as T
from .operators.predicates import Cmp, Eq, In, Predicate, condition, timestamp_range
from .plans.query import EventQuery, few
from .plans.service import handle
from .schema import Schema
from .sources.store import EventStore, Files, StoreOptions

EVENTS = Schema.parse(
    {
        "timestamp_field": "ts",
        "fields": [
            {"name": "ts", "type": "timestamp"},
            {"name": "event_id", "type": "int"},
            {"name": "user_id", "type": "int"},
            {"name": "event_type", "type": "string"},
            {"name": "kind", "type": "string"},
            {"name": "value", "type": "float"},
            {"name": "even", "type": "bool"},
            {"name": "amount", "type": "decimal", "scale": 2},
            {"name": "props", "type": "json"},
            {"name": "added", "type": "int"},
        ],
    }
)
FROM, TO = 1704412800000, 1705968000000  # 5 to 23 January 2024
HOUR = 3_600_000
CUTOFF = 1705276800000  # 15 January 2024


def events(spark: SparkSession, sf_dir: str, *predicates: Predicate, start: int = INT_MIN, end: int = INT_MAX) -> DataFrame:
    """The whole events table in the store's form. A time range is on the stored column, so it reaches the scan; kind has nulls, added is a field of no file."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    if (start, end) != (INT_MIN, INT_MAX):
        raw = raw.filter(timestamp_range("ts", start, end))
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    out = raw.select(
        F.col("event_id").alias("_seq"),
        F.expr("event_id div 2048").alias("_block"),
        ((micros - F.pmod(micros, F.lit(1000))) / 1000).cast("long").alias("ts"),
        "event_id",
        "user_id",
        "event_type",
        F.nullif("event_type", F.lit("error")).alias("kind"),
        "value",
        (F.col("user_id") % 2 == 0).alias("even"),
        F.col("value").cast("decimal(38,2)").alias("amount"),
        "props",
        F.lit(None).cast("long").alias("added"),
    )
    return out.filter(condition(EVENTS, start, end, predicates)) if predicates else out


VIEW = f"""WITH e AS (SELECT event_id AS seq, event_id // 2048 AS block, epoch_us(ts) // 1000 AS ts, event_id, user_id, event_type, nullif(event_type, 'error') AS kind, value,
user_id % 2 = 0 AS even, CAST(value AS DECIMAL(18,2)) AS amount, props, CAST(NULL AS BIGINT) AS added FROM events),
w AS (SELECT * FROM e) """

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = VIEW + sql
        return f

    return put


def text(c: str) -> Column:
    return F.col(c).cast("string")


# filters


def _counted(name: str, sql: str, *predicates: Predicate, **span: int) -> None:
    query(name, f"SELECT count(*) AS count FROM {sql}")(lambda s, d: T.count(events(s, d, *predicates, **span)))


_counted("f1_time_range", f"w WHERE ts BETWEEN {FROM} AND {TO}", start=FROM, end=TO)
_counted("f1_time_range_and_value", f"w WHERE ts BETWEEN {FROM} AND {TO} AND event_type = 'click'", Eq("event_type", "click"), start=FROM, end=TO)
_counted("f1_empty_range", "e WHERE false", start=TO, end=FROM)
_counted("f2_equality", "w WHERE event_type = 'click'", Eq("event_type", "click"))
_counted("f2_decimal_equality", "w WHERE amount = 12.50", Eq("amount", Decimal("12.50")))
_counted("f3_value_list", "w WHERE user_id IN (1, 5, 9, 11)", In("user_id", (1, 5, 9, 11)))
_counted("f3_value_list_with_null", "w WHERE kind IN ('click') OR kind IS NULL", In("kind", ("click", None)))
_counted("f4_null", "w WHERE kind IS NULL", Eq("kind", None))
_counted("f5_range", "w WHERE user_id >= 10 AND user_id < 50 AND value > 2.5", Cmp("user_id", "ge", 10), Cmp("user_id", "lt", 50), Cmp("value", "gt", 2.5))
_counted("f5_decimal_range", "w WHERE amount <= 99.99", Cmp("amount", "le", Decimal("99.99")))
_counted("f6_contradiction", "w WHERE false", Cmp("user_id", "gt", 5), Cmp("user_id", "le", 5))
_counted("f8_conjunction", "w WHERE event_type IN ('click', 'view') AND even AND value >= 10", In("event_type", ("click", "view")), Eq("even", True), Cmp("value", "ge", 10.0))
_counted("f9_float_equality", "w WHERE value = 0.0 OR value = 5.0", In("value", (-0.0, 5.0)))
_counted("f10_added_field_null", "w", Eq("added", None))
_counted("f10_added_field_range", "w WHERE false", Cmp("added", "ge", 0))


# rows


@query("s4_scan", "SELECT seq AS _seq, ts, event_id, user_id, event_type, kind, value, even, CAST(amount AS VARCHAR) AS amount, props FROM w")
def s4_scan(spark, sf_dir):
    return T.rows(events(spark, sf_dir), EVENTS).withColumn("amount", text("amount")).drop("added")


@query("p1_select", "SELECT seq AS _seq, user_id, kind FROM w WHERE even")
def p1_select(spark, sf_dir):
    """Schema order, whatever the order of the names; the filter's column is not among them."""
    return T.rows(events(spark, sf_dir, Eq("even", True)), EVENTS, ["kind", "user_id", "kind"])


@query("l2_limit", "SELECT seq AS _seq, event_id, ts FROM w ORDER BY seq LIMIT 100")
def l2_limit(spark, sf_dir):
    return T.rows(events(spark, sf_dir), EVENTS, ["ts", "event_id"], limit=100)


@query("l3_offset", "SELECT seq AS _seq, event_id, ts FROM w WHERE event_type = 'view' ORDER BY seq LIMIT 40 OFFSET 25")
def l3_offset(spark, sf_dir):
    return T.rows(events(spark, sf_dir, Eq("event_type", "view")), EVENTS, ["ts", "event_id"], offset=25, limit=40)


@query("l3_offset_past_end", "SELECT seq AS _seq, event_id FROM w WHERE false")
def l3_offset_past_end(spark, sf_dir):
    return T.rows(events(spark, sf_dir), EVENTS, ["event_id"], offset=1_000_000_000, limit=5)


# aggregates


@query("a1_count", "SELECT count(*) AS count FROM w WHERE event_type = 'purchase'")
def a1_count(spark, sf_dir):
    return T.count(events(spark, sf_dir, Eq("event_type", "purchase")))


def _stats(spark, sf_dir, *requests, by=None, strict=True, where=()):
    """Statistics with plain column names and exact numbers as text."""
    out = T.stats(events(spark, sf_dir, *where), EVENTS, list(requests), by, strict)

    def shown(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if name == "amount.sum":  # without its point
            c = F.replace(c.cast("string"), F.lit("."), F.lit("")).cast("decimal(38,0)")
        return (c.cast("string") if kind.startswith("decimal") else c).alias(name.replace(".", "_"))

    return out.select(*(shown(*x) for x in out.dtypes))


SUM2 = "CAST(sum(CAST({0} AS HUGEINT) * {0}) AS VARCHAR)"


@query("a2_exact_sum", "SELECT count(user_id) AS user_id_n, CAST(sum(user_id) AS VARCHAR) AS user_id_sum, count(ts) AS ts_n, CAST(sum(CAST(ts AS HUGEINT)) AS VARCHAR) AS ts_sum, count(amount) AS amount_n, CAST(CAST(sum(amount) * 100 AS HUGEINT) AS VARCHAR) AS amount_sum FROM w")
def a2_exact_sum(spark, sf_dir):
    return _stats(spark, sf_dir, T.StatRequest("user_id", sum=True), T.StatRequest("ts", sum=True), T.StatRequest("amount", sum=True))


@query("a2_empty_sum", "SELECT count(user_id) AS user_id_n, CAST(coalesce(sum(user_id), 0) AS VARCHAR) AS user_id_sum FROM w WHERE user_id < 0")
def a2_empty_sum(spark, sf_dir):
    return _stats(spark, sf_dir, T.StatRequest("user_id", sum=True), where=(Cmp("user_id", "lt", 0),))


@query("a3_float_sum", "SELECT count(value) AS value_n, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(value ORDER BY seq)), lambda a, x: a + x) AS value_sum FROM w")
def a3_float_sum(spark, sf_dir):
    return _stats(spark, sf_dir, T.StatRequest("value", sum=True))


@query("a3_float_sum_by_type", "SELECT event_type AS key, count(value) AS value_n, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(value ORDER BY seq)), lambda a, x: a + x) AS value_sum FROM w GROUP BY event_type")
def a3_float_sum_by_type(spark, sf_dir):
    return _stats(spark, sf_dir, T.StatRequest("value", sum=True), by="event_type")


@query("a4_min_max", "SELECT count(value) AS value_n, min(value) AS value_min, max(value) AS value_max, count(amount) AS amount_n, CAST(min(amount) AS VARCHAR) AS amount_min, CAST(max(amount) AS VARCHAR) AS amount_max, count(ts) AS ts_n, min(ts) AS ts_min, max(ts) AS ts_max FROM w")
def a4_min_max(spark, sf_dir):
    return _stats(spark, sf_dir, T.StatRequest("value", min=True, max=True), T.StatRequest("amount", min=True, max=True), T.StatRequest("ts", min=True, max=True))


@query("a5_variance", f"SELECT event_type AS key, count(user_id) AS user_id_n, CAST(sum(user_id) AS VARCHAR) AS user_id_sum, {SUM2.format('user_id')} AS user_id_sum2 FROM w GROUP BY event_type")
def a5_variance(spark, sf_dir):
    return _stats(spark, sf_dir, T.StatRequest("user_id", var=True), by="event_type")


# a fraction in lowest terms: digits after the point as far as they end, else numerator/denominator
VAR = """, s AS (SELECT event_type AS key, CAST(count(user_id) AS HUGEINT) AS n, sum(CAST(user_id AS HUGEINT)) AS s1, sum(CAST(user_id AS HUGEINT) * user_id) AS s2, CAST(count(a) AS HUGEINT) AS m, sum(a) AS a1, sum(a * a) AS a2 FROM (SELECT *, CAST(amount * 100 AS HUGEINT) AS a FROM w) GROUP BY event_type),
q AS (SELECT key, 'u' AS f, n * s2 - s1 * s1 AS top, n * n AS bottom FROM s UNION ALL SELECT key, 'a', m * a2 - a1 * a1, 10000 * m * m FROM s),
r AS (SELECT key, f, top // gcd(top, bottom) AS t, bottom // gcd(top, bottom) AS d FROM q),
p AS (SELECT k, CAST('1' || repeat('0', CAST(k AS INTEGER)) AS HUGEINT) AS ten FROM range(1, 28) x(k)),
v AS (SELECT key, f, CASE WHEN d = 1 THEN CAST(t AS VARCHAR) ELSE coalesce((SELECT min_by((t // d) || '.' || lpad(CAST((t % d) * ten // d AS VARCHAR), CAST(k AS INTEGER), '0'), k) FROM p WHERE ten % d = 0), t || '/' || d) END AS x FROM r)
SELECT key, max(x) FILTER (f = 'u') AS user_id_var, max(x) FILTER (f = 'a') AS amount_var FROM v GROUP BY key"""
FLOATS = "list_reduce(list_prepend(CAST(0 AS DOUBLE), list({0} ORDER BY seq)), lambda a, x: a + x)"
FLOAT_VAR = f"SELECT {{0}} value_n, value_sum2 / value_n - (value_sum / value_n) * (value_sum / value_n) AS value_var, sqrt(value_sum2 / value_n - (value_sum / value_n) * (value_sum / value_n)) AS value_stddev FROM (SELECT {{0}} count(value) AS value_n, {FLOATS.format('value')} AS value_sum, {FLOATS.format('value * value')} AS value_sum2 FROM w {{1}})"


def _float_variance(spark, sf_dir, by=None):
    """Population variance and its root, from sums in ingest order."""
    out = _stats(spark, sf_dir, T.StatRequest("value", var=True, stddev=True), by=by)
    mean = F.col("value_sum") / F.col("value_n")
    var = F.col("value_sum2") / F.col("value_n") - mean * mean
    return out.select(*(["key"] if by else []), "value_n", var.alias("value_var"), F.sqrt(var).alias("value_stddev"))


@query("a5_float_variance", FLOAT_VAR.format("", ""))
def a5_float_variance(spark, sf_dir):
    return _float_variance(spark, sf_dir)


@query("a5_float_variance_by_type", FLOAT_VAR.format("key,", "GROUP BY event_type").replace("SELECT key, count", "SELECT event_type AS key, count"))
def a5_float_variance_by_type(spark, sf_dir):
    return _float_variance(spark, sf_dir, "event_type")


@query("a5_variance_text", VAR)
def a5_variance_text(spark, sf_dir):
    """Exact population variances as text; more than 4096 groups are refused."""
    rows = few(_stats(spark, sf_dir, T.StatRequest("user_id", var=True), T.StatRequest("amount", var=True), by="event_type"), T.MAX_GROUPS, "groups")
    out = [(r.key, exact_ratio(r.user_id_n * int(r.user_id_sum2) - int(r.user_id_sum) ** 2, r.user_id_n**2), exact_ratio(r.amount_n * int(r.amount_sum2) - int(r.amount_sum) ** 2, 10_000 * r.amount_n**2)) for r in rows]
    return spark.createDataFrame(out, "key string, user_id_var string, amount_var string")


@query("a6_distinct", "SELECT count(DISTINCT user_id) AS count FROM w")
def a6_distinct(spark, sf_dir):
    return T.distinct(events(spark, sf_dir), EVENTS["user_id"])


@query("a6_distinct_nulls", "SELECT count(DISTINCT kind) AS count FROM w")
def a6_distinct_nulls(spark, sf_dir):
    return T.distinct(events(spark, sf_dir), EVENTS["kind"])


@query("a6_distinct_float", "SELECT count(DISTINCT CAST(value AS VARCHAR)) AS count FROM w")
def a6_distinct_float(spark, sf_dir):
    return T.distinct(events(spark, sf_dir), EVENTS["value"])


TOPK = "SELECT value, count, CAST(row_number() OVER (ORDER BY count DESC, value NULLS FIRST) AS INTEGER) AS rank FROM (SELECT {0} AS value, count(*) AS count FROM w GROUP BY 1) ORDER BY rank LIMIT {1}"


@query("a7_top_k", TOPK.format("user_id", 20))
def a7_top_k(spark, sf_dir):
    return T.top_k(events(spark, sf_dir), EVENTS["user_id"], 20)


@query("a7_top_k_nulls", TOPK.format("kind", 4))
def a7_top_k_nulls(spark, sf_dir):
    return T.top_k(events(spark, sf_dir), EVENTS["kind"], 4)


@query("a7_top_k_float", TOPK.format("value", 50))
def a7_top_k_float(spark, sf_dir):
    return T.top_k(events(spark, sf_dir), EVENTS["value"], 50)


RANK = "SELECT {0} AS value FROM (SELECT {0}, row_number() OVER (ORDER BY {0}) - 1 AS r, count(*) OVER () AS n FROM w WHERE {0} IS NOT NULL) WHERE r = {1}"


@query("a8_median", RANK.format("value", "n // 2"))
def a8_median(spark, sf_dir):
    return T.quantile(events(spark, sf_dir), EVENTS["value"], Decimal("0.5"))


@query("a8_quantile_95", RANK.format("user_id", "(95 * n) // 100"))
def a8_quantile_95(spark, sf_dir):
    return T.quantile(events(spark, sf_dir), EVENTS["user_id"], Decimal("0.95"))


@query("a8_quantile_1", RANK.format("ts", "n - 1"))
def a8_quantile_1(spark, sf_dir):
    return T.quantile(events(spark, sf_dir), EVENTS["ts"], Decimal(1))


# the range is that of the rows
HIST = "SELECT b AS start_ms, count(ts) AS count FROM (SELECT unnest(range((min(ts) // {0}) * {0}, max(ts) + 1, {0})) AS b FROM {1}) t LEFT JOIN (SELECT ts FROM {1}) x ON x.ts // {0} = b // {0} GROUP BY b"


def _histogram(spark, sf_dir, bucket: int, *predicates: Predicate) -> DataFrame:
    df = events(spark, sf_dir, *predicates)
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    return T.histogram(df, T.named("ts"), 0 if first is None else first, -1 if last is None else last, bucket)


@query("a9_histogram", HIST.format(6 * HOUR, "w"))
def a9_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir, 6 * HOUR)


@query("a9_histogram_filtered", HIST.format(7 * HOUR + 13, "w WHERE even"))
def a9_histogram_filtered(spark, sf_dir):
    return _histogram(spark, sf_dir, 7 * HOUR + 13, Eq("even", True))


@query("a10_grouped", "SELECT kind AS key, count(user_id) AS user_id_n, CAST(sum(user_id) AS VARCHAR) AS user_id_sum, min(user_id) AS user_id_min, max(user_id) AS user_id_max, count(amount) AS amount_n, CAST(CAST(sum(amount) * 100 AS HUGEINT) AS VARCHAR) AS amount_sum FROM w GROUP BY kind")
def a10_grouped(spark, sf_dir):
    return _stats(spark, sf_dir, T.StatRequest("user_id", sum=True, min=True, max=True), T.StatRequest("amount", sum=True), by="kind")


@query("a10_grouped_bool", "SELECT even AS key, count(value) AS value_n, min(value) AS value_min, max(value) AS value_max FROM w GROUP BY even")
def a10_grouped_bool(spark, sf_dir):
    return _stats(spark, sf_dir, T.StatRequest("value", min=True, max=True), by="even")


@query("a11_latest", "SELECT kind AS key, event_id, ts, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, seq DESC) AS r FROM w) WHERE r = 1")
def a11_latest(spark, sf_dir):
    return T.latest(events(spark, sf_dir), EVENTS, "kind", ["ts", "event_id", "user_id", "value"])


@query("a11_latest_by_user", "SELECT user_id AS key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS r FROM w) WHERE r = 1")
def a11_latest_by_user(spark, sf_dir):
    return T.latest(events(spark, sf_dir), EVENTS, "user_id", ["event_id"])


@query("a12_many_statistics", f"SELECT count(user_id) AS user_id_n, CAST(sum(user_id) AS VARCHAR) AS user_id_sum, {SUM2.format('user_id')} AS user_id_sum2, max(user_id) AS user_id_max, count(value) AS value_n, min(value) AS value_min FROM w WHERE event_type = 'click'")
def a12_many_statistics(spark, sf_dir):
    return _stats(spark, sf_dir, T.StatRequest("user_id", sum=True, var=True, max=True), T.StatRequest("value", min=True), where=(Eq("event_type", "click"),))


@query("v6_bucket_floor", "SELECT seq AS _seq, CASE WHEN t >= 0 THEN t // 1000 * 1000 ELSE -((-t + 999) // 1000) * 1000 END AS start_ms FROM (SELECT seq, ts - 1705000000000 AS t FROM w)")
def v6_bucket_floor(spark, sf_dir):
    t = F.col("ts") - 1705000000000
    return events(spark, sf_dir).select("_seq", (t - F.pmod(t, F.lit(1000))).alias("start_ms"))


@query("w6_drop_blocks", f"SELECT seq AS _seq, block AS _block, ts FROM (SELECT *, max(ts) OVER (PARTITION BY block) AS latest FROM e) WHERE latest >= {CUTOFF}")
def w6_drop_blocks(spark, sf_dir):
    return T.keep_blocks(events(spark, sf_dir), EVENTS, CUTOFF).select("_seq", "_block", "ts")


# the store itself: events as JSON lines, parsed, written, read and asked


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a number of partitions that is asked for is kept, so that parsing is spread
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = events(spark, sf_dir).repartitionByRange(parts, "_seq").sortWithinPartitions("_seq")
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    parts = [F.concat(F.lit(f'"{c}":'), F.coalesce(v, F.lit("null"))) for c, v in (("ts", text("ts")), ("event_id", text("event_id")), ("user_id", text("user_id")), ("event_type", quoted("event_type")), ("value", text("value")), ("even", text("even")), ("amount", F.concat(F.lit('"'), text("amount"), F.lit('"'))), ("props", F.col("props")))]
    kind = F.when(F.col("kind").isNotNull(), F.concat(F.lit(',"kind":'), quoted("kind"))).otherwise(F.lit(""))
    return e.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), kind, F.lit("}")).alias("value"))


def shared(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, removed when the driver ends; a temporary one where that is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise StoreError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.gettempdir()
    files = Files(spark, f"{folder.rstrip('/')}/tallyloom-{uuid.uuid4().hex}")

    def clean() -> None:
        try:
            files.remove("")
        except Exception:  # the session may be gone by then
            pass

    atexit.register(clean)
    return files.root


def loaded(spark: SparkSession, sf_dir: str, block_rows: int = 2048) -> EventStore:
    store = EventStore.open(spark, f"{shared(spark)}/events-{uuid.uuid4().hex}", EVENTS, StoreOptions(block_rows=block_rows))
    store.ingest(json_lines(spark, sf_dir))
    return store


STORED = "SELECT event_id AS _seq, event_id // 2048 AS _block, ts, event_id, user_id, event_type, kind, value, even, CAST(amount AS VARCHAR) AS amount, props FROM e"


@query("s1_json_ingest", STORED)
def s1_json_ingest(spark, sf_dir):
    return loaded(spark, sf_dir).table().withColumn("amount", text("amount")).drop("added")


@query("s7_rewrite", STORED)
def s7_rewrite(spark, sf_dir):
    store = loaded(spark, sf_dir)
    store.rewrite_directory(f"{store.path_}-copy")
    return EventStore.open(spark, f"{store.path_}-copy", EVENTS).table().withColumn("amount", text("amount")).drop("added")


@query("w6_store_drop", f"SELECT event_id AS _seq, block AS _block, ts FROM (SELECT *, max(ts) OVER (PARTITION BY block) AS latest FROM e) WHERE latest >= {CUTOFF}")
def w6_store_drop(spark, sf_dir):
    store = loaded(spark, sf_dir)
    store.drop_blocks_before(CUTOFF)
    return store.table().select("_seq", "_block", "ts")


@query("s9_store_stats", "SELECT (count(*) + 2047) // 2048 AS blocks, 1 AS segments, count(*) AS rows FROM e")
def s9_store_stats(spark, sf_dir):
    s = loaded(spark, sf_dir).stats()
    return spark.createDataFrame([(s.blocks, s.segments, s.rows)], "blocks long, segments int, rows long")


@query("s3_request", "SELECT event_type AS value, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS rank FROM w WHERE user_id >= 10 GROUP BY event_type ORDER BY rank LIMIT 3")
def s3_request(spark, sf_dir):
    """A request as text, answered by a store."""
    return EventQuery.parse(EVENTS, "/events/topk", f"from={INT_MIN}&to={INT_MAX}&field=event_type&k=3&ge=user_id=10").frame(loaded(spark, sf_dir))


@query("s3_posted_batches", "SELECT * FROM (VALUES (0, 201, 1), (1, 201, 3), (2, 400, 3), (3, 400, 3), (4, 400, 3), (5, 400, 3), (6, 201, 4)) t(step, status, stored)")
def s3_posted_batches(spark, sf_dir):
    """Bodies posted one after the other: a batch with a wrong event leaves the store as it was."""
    store = EventStore.open(spark, f"{shared(spark)}/posted-{uuid.uuid4().hex}", EVENTS)
    bodies = ['{"ts":1}', '[{"ts":2},{"ts":3,"event_type":"click"}]', '[{"ts":4},{"event_type":"click"}]', "[]", '[[{"ts":5}]]', '{"ts":6,"amount":1}', ' [ {"ts":7} ] ']
    out = [(k, handle(store, "POST", "/events", body.encode())[0], store.table().count()) for k, body in enumerate(bodies)]
    return spark.createDataFrame(out, "step int, status int, stored int")


#: Requests that are refused before anything is read, and some that are not.
REQUESTS = [
    ("/events?from=0&to=9&select=", True), ("/events?from=0&to=9&select=nothing", True), ("/events?from=0&to=9&select=ts&k=3", True), ("/events?from=0&to=9&select=ts&select=ts", False),
    ("/events?from=0", True), ("/events?from=x&to=9", True), ("/events?from=0&to=9&limit=0", True), ("/events?from=0&to=9&by=kind", True),
    ("/events/count?from=0&to=9&eq=user_id=1.5", True), ("/events/count?from=0&to=9&eq=amount=1.234", True), ("/events/count?from=0&to=9&eq=amount=.5", False), ("/events/count?from=0&to=9&eq=even=yes", True), ("/events/count?from=0&to=9&gt=event_type=a", True), ("/events/count?from=0&to=9&in=kind=", True),
    ("/events/quantile?from=0&to=9&field=value&p=1.1", True), ("/events/quantile?from=0&to=9&field=event_type&p=0.5", True), ("/events/topk?from=0&to=9&field=kind&k=4097", True), ("/events/stats?from=0&to=9", True), ("/events/stats?from=0&to=9&sum=user_id&by=value", True), ("/events/histogram?from=0&to=99999&bucket_ms=1", True),
]


@query("p2_refused_requests", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {str(x).lower()})" for r, x in REQUESTS) + ") t(request, refused)")
def p2_refused_requests(spark, sf_dir):
    store = EventStore.open(spark, f"{shared(spark)}/empty-{uuid.uuid4().hex}", EVENTS)
    return spark.createDataFrame([(r, handle(store, "GET", r)[0] == 400) for r, _ in REQUESTS], "request string, refused boolean")


DROPS = [('{"before_ms":2}', "application/json", False), ('{"before_ms":2.0}', "application/json", True), ('{"before_ms":"2"}', "application/json", True), ("[2]", "application/json", True), ("{}", "application/json", True), ('{"before_ms":2}', "text/plain", True), ('{"before_ms":9223372036854775808}', "application/json", True), ('{"before_ms":2}', "application/json; charset=utf-8", False)]


@query("w7_refused_drops", "SELECT * FROM (VALUES " + ", ".join(f"({k}, {str(x).lower()})" for k, (_, _, x) in enumerate(DROPS)) + ") t(step, refused)")
def w7_refused_drops(spark, sf_dir):
    store = EventStore.open(spark, f"{shared(spark)}/empty-{uuid.uuid4().hex}", EVENTS)
    return spark.createDataFrame([(k, handle(store, "POST", "/events/drop", b.encode(), t)[0] == 400) for k, (b, t, _) in enumerate(DROPS)], "step int, refused boolean")


@query("w5_schema_append", "SELECT count(*) AS rows, count(*) FILTER (event_id % 2 = 1) AS with_added, CAST(coalesce(sum(event_id) FILTER (event_id % 2 = 1), 0) AS BIGINT) AS added_sum FROM e")
def w5_schema_append(spark, sf_dir):
    """Half of the events under a schema without the last field, half under its successor: old files have nulls there."""
    folder = f"{shared(spark)}/grown-{uuid.uuid4().hex}"
    old = Schema.parse({"timestamp_field": "ts", "fields": [{"name": "ts", "type": "timestamp"}]})
    new = Schema.parse({"timestamp_field": "ts", "fields": [{"name": "ts", "type": "timestamp"}, {"name": "added", "type": "int"}]})
    e = events(spark, sf_dir)
    EventStore.open(spark, folder, old).ingest(e.filter("event_id % 2 = 0").select(F.format_string('{"ts":%d}', "ts").alias("value")))
    store = EventStore.open(spark, folder, new)
    store.ingest(e.filter("event_id % 2 = 1").select(F.format_string('{"ts":%d,"added":%d}', "ts", "event_id").alias("value")))
    return store.table().agg(F.count(F.lit(1)).alias("rows"), F.count("added").alias("with_added"), F.coalesce(F.sum("added"), F.lit(0)).alias("added_sum"))


@query("z1_counts_by_commit", f"SELECT count(*) FILTER (ts BETWEEN {FROM} AND {TO}) AS inside, count(*) AS every FROM e")
def z1_counts_by_commit(spark, sf_dir):
    """Events in commits by week: those that a range holds whole are counted from the manifest, those beyond it are not opened."""
    store = EventStore.open(spark, f"{shared(spark)}/weeks-{uuid.uuid4().hex}", Schema.parse({"timestamp_field": "ts", "fields": [{"name": "ts", "type": "timestamp"}]}))
    e = events(spark, sf_dir)
    week = F.floor((F.col("ts") - FROM) / (7 * 24 * HOUR))
    for (w,) in sorted(e.select(week).distinct().collect()):
        store.ingest(e.filter(week == w).select(F.format_string('{"ts":%d}', "ts").alias("value")))
    count = lambda span: EventQuery.parse(store.schema, "/events/count", span).frame(store)
    inside, every = count(f"from={FROM}&to={TO}"), count(f"from={INT_MIN}&to={INT_MAX}")
    return inside.withColumnRenamed("count", "inside").crossJoin(F.broadcast(every.withColumnRenamed("count", "every")))  # one row each


@query("windowed_counts", f"SELECT ts // {24 * HOUR} * {24 * HOUR} AS start_ms, event_type, count(*) AS count FROM e GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    """A stream's counts by day and type, as batches leave them in a complete-mode sink."""
    from .streaming.ingest import windowed

    own = f"{shared(spark)}/windows-{uuid.uuid4().hex}"
    timed = events(spark, sf_dir).select(F.timestamp_millis("ts").alias("at"), "event_type")
    timed.write.parquet(f"{own}/in")
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 4).parquet(f"{own}/in")
    counts = windowed(stream, "at", "1 day", "40 days", "event_type").select(F.unix_millis("window.start").alias("start_ms"), "event_type", "count")

    def latest(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{own}/out")

    counts.writeStream.outputMode("complete").foreachBatch(latest).option("checkpointLocation", f"{own}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{own}/out")


@query("stream_ingest", STORED)
def stream_ingest(spark, sf_dir):
    """The same events by Structured Streaming, one file a batch, and replayed."""
    from .streaming.ingest import into, text_stream

    own = shared(spark)
    json_lines(spark, sf_dir).coalesce(1).write.text(f"{own}/in")
    store = EventStore.open(spark, f"{own}/store", EVENTS)
    into(store, text_stream(spark, f"{own}/in"), "events", f"{own}/checkpoint").awaitTermination()
    into(store, text_stream(spark, f"{own}/in"), "events", f"{own}/replayed").awaitTermination()
    return store.table().withColumn("amount", text("amount")).drop("added")
