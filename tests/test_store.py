"""The store and its requests on small rows with known answers."""

import json

import pytest

from tallyloom.errors import BadRequest, StoreClosed
from tallyloom.plans.query import EventQuery
from tallyloom.schema import Schema
from tallyloom.sources.store import EventStore, StoreOptions
from tallyloom.streaming.ingest import into, text_stream

FULL = Schema.parse({"timestamp_field": "ts", "fields": [{"name": "ts", "type": "timestamp"}, {"name": "user_id", "type": "int"}, {"name": "score", "type": "float"}, {"name": "ok", "type": "bool"}, {"name": "action", "type": "string"}, {"name": "note", "type": "text"}, {"name": "amount", "type": "decimal", "scale": 2}, {"name": "props", "type": "json"}]})
WIDE = "from=0&to=9999999"


def store_of(spark, path, rows, block_rows=2048, schema=FULL):
    store = EventStore.open(spark, str(path), schema, StoreOptions(block_rows=block_rows))
    if rows:
        store.append_batch_durable([json.dumps(r) for r in rows])
    return store


def ask(store, path, query=WIDE):
    return json.loads(EventQuery.parse(store.schema, path, query).answer(store))


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    rows = [
        {"ts": 1000, "user_id": 1, "score": 0.5, "ok": True, "action": "click", "note": "a", "amount": "1.00"},
        {"ts": 2000, "user_id": 2, "score": 0.25, "ok": False, "action": "view", "note": "null", "amount": "2.25"},
        {"ts": 3000, "score": 1.0, "action": "click", "amount": "4.00", "props": {"k": [1, 2]}},
        {"ts": 5000, "user_id": 0, "score": 0.0, "ok": True, "note": "A"},
        {"ts": 4500, "user_id": 2, "score": -0.0, "action": "buy", "amount": "1.00"},
    ]
    return store_of(spark, tmp_path_factory.mktemp("s") / "mixed", rows, 2)


def test_rows_keep_ingest_order_and_paging(mixed):
    assert [r["ts"] for r in ask(mixed, "/events")] == [1000, 2000, 3000, 5000, 4500]
    assert [r["ts"] for r in ask(mixed, "/events", WIDE + "&limit=2&offset=1")] == [2000, 3000]
    assert ask(mixed, "/events", WIDE + "&offset=9") == []
    assert [r["ts"] for r in ask(mixed, "/events", "from=2000&to=3000")] == [2000, 3000]
    assert ask(mixed, "/events", "from=3000&to=2000") == []


def test_select(mixed):
    got = ask(mixed, "/events", WIDE + "&select=amount&select=user_id&select=amount&eq=action=click")
    assert got == [{"user_id": 1, "amount": "1.00"}, {"user_id": None, "amount": "4.00"}]
    assert list(got[0]) == ["user_id", "amount"]


@pytest.mark.parametrize(
    ("filters", "n"),
    [("", 5), ("&eq=action=click", 2), ("&in=action=click&in=action=buy", 3), ("&in=user_id=null&in=user_id=0", 2), ("&eq=user_id=null", 1), ("&eq=note=null", 1), ("&eq=score=0.0", 2), ("&in=amount=1.00&in=amount=4.00", 3), ("&ge=user_id=1", 3), ("&gt=amount=1.00&le=amount=2.25", 1), ("&gt=user_id=2&lt=user_id=1", 0), ("&gt=score=0.5&ge=score=0.1", 1), ("&eq=ok=true&ge=ts=2000", 1), ("&eq=props=null", 4), ("&eq=action=", 0), ("&eq=action=a%3Db", 0)],
)
def test_filters(mixed, filters, n):
    assert ask(mixed, "/events/count", WIDE + filters) == {"count": n}
    assert len(ask(mixed, "/events", WIDE + filters)) == n


def test_histogram(mixed):
    got = ask(mixed, "/events/histogram", "from=0&to=5999&bucket_ms=2000")["buckets"]
    assert got == [{"start_ms": 0, "count": 1}, {"start_ms": 2000, "count": 2}, {"start_ms": 4000, "count": 2}]
    assert ask(mixed, "/events/histogram", "from=9&to=8&bucket_ms=1")["buckets"] == []
    low = ask(mixed, "/events/histogram", "from=-1500&to=0&bucket_ms=1000")["buckets"]
    assert [b["start_ms"] for b in low] == [-2000, -1000, 0]


def test_statistics(mixed):
    got = ask(mixed, "/events/stats", WIDE + "&sum=user_id&min=user_id&max=user_id&sum=amount&var=user_id&stddev=amount&sum=score")["columns"]
    assert got["user_id"] == {"sum": "5", "min": 0, "max": 2, "var": "0.6875"}
    assert got["amount"]["sum"] == "8.25"
    assert got["score"] == {"sum": 1.75}
    none = ask(mixed, "/events/stats", WIDE + "&eq=action=x&sum=amount&min=amount&var=amount&sum=score")["columns"]
    assert none == {"score": {"sum": 0}, "amount": {"sum": "0", "min": None, "var": None}}
    by = ask(mixed, "/events/stats", WIDE + "&sum=amount&by=action")["groups"]
    assert [(g["key"], g["columns"]["amount"]["sum"]) for g in by] == [(None, "0"), ("buy", "1.00"), ("click", "5.00"), ("view", "2.25")]


def test_distinct_and_top(mixed):
    assert ask(mixed, "/events/distinct", WIDE + "&field=user_id") == {"count": 3}
    assert ask(mixed, "/events/distinct", WIDE + "&field=score") == {"count": 5}
    assert ask(mixed, "/events/distinct", WIDE + "&field=note") == {"count": 3}
    assert ask(mixed, "/events/topk", WIDE + "&field=action&k=3")["values"] == [{"value": "click", "count": 2}, {"value": None, "count": 1}, {"value": "buy", "count": 1}]
    zero = EventQuery.parse(mixed.schema, "/events/topk", WIDE + "&field=score&k=2").answer(mixed)
    assert zero == '{"values":[{"value":-0.0,"count":1},{"value":0.0,"count":1}]}'


def test_quantile(mixed):
    assert [ask(mixed, "/events/quantile", WIDE + f"&field=user_id&p={p}") for p in ("0", "0.5", "0.75", "1")] == [0, 2, 2, 2]
    assert ask(mixed, "/events/quantile", WIDE + "&field=amount&p=1&lt=amount=3.00") == "2.25"
    assert ask(mixed, "/events/quantile", WIDE + "&field=user_id&p=0.5&eq=user_id=null") is None


def test_latest(spark, tmp_path):
    rows = [{"ts": 5000, "user_id": 1, "action": "click"}, {"ts": 5000, "user_id": 2, "action": "click"}, {"ts": 1500, "user_id": 3, "action": "view"}, {"ts": 2000, "user_id": 4}, {"ts": 100, "user_id": 5, "action": "click"}]
    store = store_of(spark, tmp_path / "s", rows)
    assert [(r["action"], r["ts"], r["user_id"]) for r in ask(store, "/events/latest", WIDE + "&by=action")] == [(None, 2000, 4), ("click", 5000, 2), ("view", 1500, 3)]


BAD = {
    "/events": ["", "from=1", "from=x&to=2", "from=1&to=2&limit=0", "from=1&to=2&limit=-1", "from=1&to=2&offset=x", "from=1&to=2&eq=nope=1", "from=1&to=2&eq=user_id=x", "from=1&to=2&eq=user_id=", "from=1&to=2&in=action=", "from=1&to=2&ge=action=x", "from=1&to=2&ge=user_id=null", "from=1&to=2&eq=props=1", "from=1&to=2&select=nope", "from=1&to=2&select=ts&k=1", "from=1&to=2&by=ts", "from=1&to=2&eq=%zz=1", "from=1&to=2&limit=1&limit=2", "from=9223372036854775808&to=2"],
    "/events/count": ["from=1&to=2&limit=1", "from=1&to=2&select=ts", "from=1&to=2&offset=0"],
    "/events/histogram": ["from=1&to=2", "from=1&to=2&bucket_ms=0", "from=1&to=2&bucket_ms=-1", "from=1&to=2&bucket_ms=1.5", "from=0&to=4096&bucket_ms=1", "from=-9223372036854775808&to=-9223372036854775807&bucket_ms=1000"],
    "/events/stats": ["from=1&to=2", "from=1&to=2&sum=action", "from=1&to=2&sum=nope", "from=1&to=2&sum=user_id&by=score", "from=1&to=2&sum=user_id&by=props", "from=1&to=2&sum=user_id&x=1", "from=1&to=2&sum=user_id&by=ts&by=ts"],
    "/events/quantile": ["from=1&to=2&field=action&p=0.5", "from=1&to=2&field=user_id&p=1.1", "from=1&to=2&field=user_id&p=1e-1", "from=1&to=2&field=user_id", "from=1&to=2&p=1", "from=1&to=2&field=user_id&p=1&limit=2"],
    "/events/distinct": ["from=1&to=2", "from=1&to=2&field=props", "from=1&to=2&field=user_id&k=1"],
    "/events/topk": ["from=1&to=2&field=user_id", "from=1&to=2&field=user_id&k=0", "from=1&to=2&field=user_id&k=4097", "from=1&to=2&field=props&k=1"],
    "/events/latest": ["from=1&to=2", "from=1&to=2&by=score", "from=1&to=2&by=user_id&limit=1"],
    "/nothing": ["from=1&to=2"],
}


@pytest.mark.parametrize(("path", "query"), [(p, q) for p, qs in BAD.items() for q in qs])
def test_wrong_requests_read_nothing(path, query):
    with pytest.raises(BadRequest):
        EventQuery.parse(FULL, path, query)


def test_unknown_parameters_are_ignored_where_they_are(mixed):
    assert len(ask(mixed, "/events", WIDE + "&colour=red")) == 5


def test_batches_are_all_or_nothing(spark, tmp_path):
    store = store_of(spark, tmp_path / "s", [{"ts": 1}])
    for bad in ([], ['{"ts":2}', '{"user_id":1}'], ["[1]"], ['{"ts":3,"amount":1}']):
        with pytest.raises(BadRequest):
            store.append_batch_durable(bad)
    assert store.table().count() == 1
    store.append('{"ts":2}')
    assert ask(store, "/events/count") == {"count": 2}
    assert store.post('{"ts":3,"props":{ "a":1}}') == 1 and store.post(b' [{"ts":4},{"ts":5}]') == 2
    with pytest.raises(BadRequest):
        store.post("[]")
    assert ask(store, "/events/count") == {"count": 5}
    store.close()
    with pytest.raises(StoreClosed):
        store.append('{"ts":2}')


def test_drop_keeps_whole_blocks(spark, tmp_path):
    one = store_of(spark, tmp_path / "one", [{"ts": t} for t in (1000, 2000, 3000)], 1)
    assert one.drop_blocks_before(1000) == 0
    assert one.drop_blocks_before(1001) == 1
    assert [r["ts"] for r in ask(one, "/events")] == [2000, 3000]
    two = store_of(spark, tmp_path / "two", [{"ts": t} for t in (1000, 3000, 1500)], 2)
    assert two.drop_blocks_before(2000) == 1
    assert [r["ts"] for r in ask(two, "/events")] == [1000, 3000]
    two.append_durable('{"ts":7}')
    assert [(r._seq, r._block) for r in two.table().orderBy("_seq").collect()] == [(0, 0), (1, 0), (3, 2)]
    for bad in (True, 1.5, "1", 2**63):
        with pytest.raises(BadRequest):
            two.drop_blocks_before(bad)
    assert two.drop_blocks_before(10**6) == 2 and two.table().count() == 0 and two.stats().rows == 0


def test_added_fields_are_null_before(spark, tmp_path):
    small = Schema.parse({"timestamp_field": "ts", "fields": [{"name": "ts", "type": "timestamp"}]})
    store_of(spark, tmp_path / "s", [{"ts": 1}], schema=small).close()
    wide = Schema.parse({"timestamp_field": "ts", "fields": [{"name": "ts", "type": "timestamp"}, {"name": "region", "type": "string"}]})
    store = store_of(spark, tmp_path / "s", [{"ts": 2, "region": "x"}], schema=wide)
    assert ask(store, "/events") == [{"ts": 1, "region": None}, {"ts": 2, "region": "x"}]
    assert ask(store, "/events/count", WIDE + "&eq=region=x") == {"count": 1}
    with pytest.raises(BadRequest):
        EventStore.open(spark, str(tmp_path / "s"), small)


def test_uncommitted_files_are_ignored(spark, tmp_path):
    store = store_of(spark, tmp_path / "s", [{"ts": 1}])
    (tmp_path / "s/data/lost").mkdir()
    (tmp_path / "s/data/lost/part-0.parquet").write_bytes(b"torn")
    (tmp_path / "s/manifest/_torn").write_text("{")
    assert EventStore.open(spark, str(tmp_path / "s"), FULL).table().count() == 1
    assert store.stats().segments == 1


def test_text_files_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, n in enumerate((3, 50, 1)):
        (tmp_path / f"in/{k}.json").write_text("".join(f'{{"ts":{100 * k + i}}}\n' for i in range(n)) + "\n")
    store = EventStore.open(spark, str(tmp_path / "s"), FULL, StoreOptions(block_rows=10))
    assert store.ingest_text(str(tmp_path / "in")) == 54
    assert [r["ts"] for r in ask(store, "/events")] == [*range(3), *range(100, 150), 200]
    report = store.rewrite_directory(str(tmp_path / "copy"))
    assert report.source.rows == report.destination.rows == 54 and report.destination.blocks == 6
    assert "ts" in store.column_sizes()


def test_stream_replay_adds_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"ts":1}\n{"ts":"x"}\n{"ts":2}\n')
    store = EventStore.open(spark, str(tmp_path / "s"), FULL)
    for k in range(2):
        into(store, text_stream(spark, str(tmp_path / "in")), "a", str(tmp_path / f"c{k}"), rejects=str(tmp_path / "bad")).awaitTermination()
    assert [r["ts"] for r in ask(store, "/events")] == [1, 2]
    assert [r.value for r in spark.read.json(str(tmp_path / "bad/*")).collect()] == ['{"ts":"x"}']


def test_sums_that_do_not_fit(spark, tmp_path):
    store = store_of(spark, tmp_path / "s", [{"ts": 1, "score": 1e308}, {"ts": 2, "score": 1e308}])
    with pytest.raises(BadRequest):
        ask(store, "/events/stats", WIDE + "&sum=score")


def test_too_many_groups(spark, tmp_path):
    store = store_of(spark, tmp_path / "s", [{"ts": 1, "user_id": k} for k in range(4097)])
    for path, q in (("/events/stats", "&sum=user_id&by=user_id"), ("/events/latest", "&by=user_id")):
        with pytest.raises(BadRequest):
            ask(store, path, WIDE + q)
        assert ask(store, path, WIDE + q + "&lt=user_id=4096")


def test_stock_counts(spark, tmp_path):
    """100,000 periodic events with known counts."""
    actions = ("click", "view", "buy", "scroll")
    lines = spark.range(100_000, numPartitions=4).selectExpr(f"""concat('{{"ts":', 1700000000000 + 10 * id, ',"user_id":', id % 1000, ',"ok":', if(id % 2 = 0, 'true', 'false'), ',"action":"', element_at(array({", ".join(f"'{a}'" for a in actions)}), cast(id % 4 + 1 as int)), '"}}') as value""")
    store = EventStore.open(spark, str(tmp_path / "s"), FULL)
    assert store.ingest(lines) == 100_000
    wide = "from=0&to=9999999999999"
    assert [ask(store, "/events/count", wide + f)["count"] for f in ("&in=action=click&in=action=buy", "&in=action=click&eq=ok=true", "&in=action=missing", "&in=user_id=0&in=user_id=1")] == [50_000, 25_000, 0, 200]
    assert store.stats().blocks == 49


def test_filters_reach_the_scan(spark, tmp_path):
    store = store_of(spark, tmp_path / "s", [{"ts": 1, "user_id": 5}])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = EventQuery.parse(FULL, "/events/count", "from=0&to=9&ge=user_id=3").filtered(store).select("action")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,0)" in plan and "GreaterThanOrEqual(user_id,3)" in plan
    assert "ReadSchema: struct<ts:bigint,user_id:bigint,action:string>" in plan


TIMED = Schema.parse({"timestamp_field": "ts", "fields": [{"name": "ts", "type": "timestamp"}, {"name": "v", "type": "float"}, {"name": "n", "type": "int"}]})


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Three million rows in several files; v and n are permutations of 0 to 2,999,999 and a third of n is one value."""
    path = str(tmp_path_factory.mktemp("many") / "t")
    rows = spark.range(3_000_000).selectExpr("id AS _seq", "id AS ts", "cast((id * 1234577) % 3000000 as double) AS v", "if(id % 3 = 0, -5, (id * 7) % 3000000) AS n")
    rows.repartition(7, "v").write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield spark.read.parquet(path)
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("p", ["0", "0.37", "0.5", "0.9", "1"])
def test_quantiles_of_many_rows(many, p):
    from decimal import Decimal

    from tallyloom.operators import terminals as T

    place = T.quantile_index(Decimal(p), 3_000_000)
    assert T.quantile(many, TIMED["v"], Decimal(p)).first()[0] == place
    n = sorted(-5 if i % 3 == 0 else i * 7 % 3_000_000 for i in range(3_000_000))
    assert T.quantile(many, TIMED["n"], Decimal(p)).first()[0] == n[place]


def test_pages_of_many_rows(many):
    from tallyloom.operators import terminals as T

    assert [r._seq for r in T.rows(many, TIMED, offset=1_500_000, limit=3).collect()] == [1_500_000, 1_500_001, 1_500_002]
    odd = many.filter("_seq % 2 = 1")
    assert [r._seq for r in T.rows(odd, TIMED, offset=1_400_000, limit=2).collect()] == [2_800_001, 2_800_003]
    assert T.rows(many, TIMED, offset=2_999_998).count() == 2 and T.rows(many, TIMED, offset=3_000_000).count() == 0
    assert [r._seq for r in T.rows(many, TIMED, offset=2_999_999, limit=500).collect()] == [2_999_999]


def test_renumbering_many_rows(many):
    from tallyloom.sources.store import renumbered

    numbered, total = renumbered(many.filter("_seq % 2 = 1"))
    assert total == 1_500_000
    assert numbered.filter("n_ <> (_seq - 1) / 2").count() == 0 and numbered.count() == total


def test_sums_of_wide_decimals(spark, tmp_path):
    schema = Schema.parse({"timestamp_field": "ts", "fields": [{"name": "ts", "type": "timestamp"}, {"name": "d", "type": "decimal", "scale": 8}]})
    store = store_of(spark, tmp_path / "s", [{"ts": 1, "d": "1000000000000000000000000000"}, {"ts": 2, "d": "1000000000000000000000000000"}, {"ts": 3, "d": "-0.00000001"}], schema=schema)
    assert ask(store, "/events/stats", WIDE + "&sum=d")["columns"]["d"]["sum"] == "1999999999999999999999999999.99999999"
    assert ask(store, "/events/stats", "from=3&to=3&var=d&sum=d")["columns"]["d"] == {"sum": "-0.00000001", "var": "0"}
    with pytest.raises(BadRequest):
        ask(store, "/events/stats", WIDE + "&var=d")


def test_too_many_or_too_long_values(spark, tmp_path, monkeypatch):
    from tallyloom.operators import terminals as T

    store = store_of(spark, tmp_path / "s", [{"ts": 1, "user_id": k, "action": "x" * k} for k in range(9)] + [{"ts": 2}])
    monkeypatch.setattr(T, "MAX_DISTINCT", 9)
    assert ask(store, "/events/distinct", WIDE + "&field=user_id") == {"count": 9}
    with pytest.raises(BadRequest):  # null is a value here
        ask(store, "/events/topk", WIDE + "&field=user_id&k=1")
    monkeypatch.setattr(T, "MAX_DISTINCT", 8)
    with pytest.raises(BadRequest):
        ask(store, "/events/distinct", WIDE + "&field=user_id")
    monkeypatch.setattr(T, "MAX_DISTINCT", 100)
    monkeypatch.setattr(T, "MAX_VALUE_BYTES", 35)
    for path, more in (("/events/distinct", ""), ("/events/topk", "&k=1")):
        assert ask(store, path, "from=0&to=9&field=user_id" + more)
        with pytest.raises(BadRequest):
            ask(store, path, "from=0&to=9&field=action" + more)


def test_a_range_opens_only_its_commits(spark, tmp_path):
    store = store_of(spark, tmp_path / "s", [{"ts": t} for t in (100, 150)])
    store.append_batch_durable(['{"ts":200}', '{"ts":300}'])
    store.append_durable('{"ts":400}')
    assert [len(store.table(*span).inputFiles()) for span in ((), (0, 99), (250, 260), (150, 200), (0, 1000))] == [3, 0, 1, 2, 3]
    assert [ask(store, "/events/count", f"from={a}&to={b}")["count"] for a, b in ((0, 999), (120, 250), (150, 400), (401, 900), (9, 0), (300, 300))] == [5, 2, 4, 0, 0, 1]


def test_two_writers_of_one_version(spark, tmp_path):
    store = store_of(spark, tmp_path / "s", [{"ts": 1}])
    old = store._manifest()
    store.append_durable('{"ts":2}')
    assert not store._publish(old, next_seq=99) and store.table().count() == 2
    # a writer that stopped half-way: its version is passed over, and never made again
    torn = tmp_path / f"s/manifest/{old.version + 2:012d}.json"
    torn.write_text('{"version"')
    import os

    os.utime(torn, (1, 1))
    store.append_durable('{"ts":3}')
    assert store.table().count() == 3 and store._manifest().version == old.version + 3


def test_readers_keep_what_a_drop_removes(spark, tmp_path):
    store = store_of(spark, tmp_path / "s", [{"ts": 1}])
    store.append_durable('{"ts":5}')
    before = store.table()
    assert store.drop_blocks_before(3) == 1 and before.count() == 2 and store.table().count() == 1
    assert store.vacuum() == 1 and store.vacuum() == 0 and store.table().count() == 1


def test_requests_over_http(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from tallyloom.plans.service import handle, server

    store = store_of(spark, tmp_path / "s", [{"ts": 1}])
    at = server(store)
    threading.Thread(target=at.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{at.server_port}"
    read = lambda x: json.loads(urllib.request.urlopen(x).read())
    assert read(f"{url}/health") == {"status": "ok"}
    assert read(urllib.request.Request(f"{url}/events", b'[{"ts":2},{"ts":3}]')) == {"ok": True, "count": 2}
    assert read(f"{url}/events/count?from=2&to=9") == {"count": 2}
    assert read(urllib.request.Request(f"{url}/events/drop", b'{"before_ms":2}', {"Content-Type": "application/json"})) == {"ok": True}
    assert read(f"{url}/events?from=0&to=9&select=ts") == [{"ts": 2}, {"ts": 3}]
    with pytest.raises(urllib.error.HTTPError):
        read(f"{url}/events/count?from=2")
    at.shutdown()
    assert handle(store, "GET", "/nowhere")[0] == 404 and handle(store, "POST", "/health")[0] == 405
    store.close()
    assert handle(store, "GET", "/events/count?from=0&to=9")[0] == 503
