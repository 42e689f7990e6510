"""The event store: Parquet commits listed in a manifest.

A directory holds ``schema.lock``, ``data/<commit>/`` folders of Parquet files
and ``manifest/<version>.json`` files. The newest manifest names the commits that
exist; whatever else lies in the directory was never committed and is ignored.
A manifest is made under its final name by a call that fails if the name exists,
so two writers cannot both make the same version; one that a stopped writer left
unfinished is passed over after ``UNFINISHED_S`` seconds. Rows carry their place
in ingest order, dense from 0, and their block. Each commit's span of time is in
the manifest, so a time range opens only the commits that meet it, and rows of
commits that lie in it whole are counted without reading them.
All file access goes through Spark's file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadRequest, Corrupt, StoreClosed, StoreError
from ..functions.values import parse_event, split_batch
from ..operators.terminals import dense, keep_blocks, named, part_of
from ..schema import BLOCK, SEQ, Schema


#: A manifest without its end is one of a stopped writer after so many seconds.
UNFINISHED_S = 60.0


@dataclass(frozen=True)
class StoreOptions:
    """block_rows: rows of a block, which is dropped or kept as a whole. segment_rows: rows of a file. codec, bloom_fields: how Parquet is written."""

    block_rows: int = 2048
    segment_rows: int = 1_000_000
    codec: str = "zstd"
    bloom_fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Commit:
    name: str
    rows: int
    blocks: int
    min_ts: int
    max_ts: int


@dataclass(frozen=True)
class Manifest:
    """What exists, the next row's place and block (never used twice), the last batch of each stream, and folders that no longer count but may still be read by who began before."""

    version: int = 0
    commits: tuple[Commit, ...] = ()
    next_seq: int = 0
    next_block: int = 0
    streams: tuple[tuple[str, int], ...] = ()
    retired: tuple[str, ...] = ()


@dataclass(frozen=True)
class StoreStats:
    data_bytes: int
    index_bytes: int
    blocks: int
    segments: int
    rows: int


@dataclass(frozen=True)
class RewriteReport:
    source: StoreStats
    destination: StoreStats

    @property
    def data_reduction(self) -> float:
        return 1 - self.destination.data_bytes / self.source.data_bytes if self.source.data_bytes else 0.0

    @property
    def total_reduction(self) -> float:
        a, b = (s.data_bytes + s.index_bytes for s in (self.source, self.destination))
        return 1 - b / a if a else 0.0


def finished(manifest: str) -> bool:
    """Whether a manifest was written to its end."""
    try:
        return manifest.endswith("\n") or isinstance(json.loads(manifest), dict)
    except ValueError:
        return False


class Files:
    """A folder in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.exists(folder) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """False if the name exists already: of several writers one makes the file."""
        at = self.path(name)
        self.fs.mkdirs(at.getParent())
        if self.fs.getScheme() == "file":  # Hadoop's local file system looks first and then makes
            try:
                with open(at.toUri().getPath(), "xb") as f:
                    f.write(text.encode())
                return True
            except FileExistsError:
                return False
        try:
            stream = self.fs.create(at, False)
        except Py4JJavaError as e:
            if self.fs.exists(at):
                return False
            raise StoreError(str(e)) from None
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def age(self, name: str) -> float:
        """Seconds since the file was changed."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def parsed(lines: DataFrame, schema: Schema, column: str = "value") -> DataFrame:
    """Events as text to the schema's columns, with ``error`` (null where an event is right). Other columns stay."""
    keep = [f for f in lines.schema.fields if f.name != column]
    fields = [f for f in schema.spark().fields if f.name not in (SEQ, BLOCK)]
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    arrow = [kinds.get(f.dataType.simpleString()) or pa.decimal128(38, f.dataType.scale) for f in fields]

    def run(batches):
        for b in batches:
            rows, errors = [], []
            for text in b.column(b.schema.names.index(column)).to_pylist():
                try:
                    rows.append(parse_event(schema, text if text is not None else b""))
                    errors.append(None)
                except BadRequest as e:
                    rows.append([None] * len(fields))
                    errors.append(str(e))
            cols = [pa.array([r[k] for r in rows], a) for k, a in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(errors, pa.string()), *cols], [*(f.name for f in keep), "error_", *(f.name for f in fields)])

    out = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "error_ string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)]
    return lines.mapInArrow(run, ", ".join(out))


class EventStore:
    """One table of typed events in one directory."""

    def __init__(self, spark: SparkSession, path: str, schema: Schema, options: StoreOptions):
        self.spark, self.path_, self.schema, self.options = spark, path, schema, options
        self.files = Files(spark, path)
        self.buffer: list[bytes] = []
        self.closed = False

    @staticmethod
    def open(spark: SparkSession, path: str, schema: Schema | str | dict, options: StoreOptions | None = None) -> EventStore:
        """Open or make a store. A schema may add fields to the one that is stored; rows from before have nulls there."""
        schema = schema if isinstance(schema, Schema) else Schema.parse(schema)
        store = EventStore(spark, path, schema, options or StoreOptions())
        if store.options.block_rows < 1:
            raise BadRequest("a block needs a row")
        locks = sorted(n for n in store.files.names("schema") if n.endswith(".lock"))
        old = Schema.parse(store.files.read(f"schema/{locks[-1]}")) if locks else None
        if old:
            old.check_successor(schema)
        if not old or old.canonical() != schema.canonical():
            if not store.files.write_new(f"schema/{len(locks):06d}.lock", schema.canonical()):
                raise BadRequest("another writer changed the schema")
        return store

    # manifest

    def _manifest(self) -> Manifest:
        while True:
            names = sorted(n for n in self.files.names("manifest") if n.endswith(".json"))
            if not names:
                return Manifest()
            name, behind = f"manifest/{names[-1]}", 0
            text = self.files.read(name)
            while not finished(text) and self.files.age(name) > UNFINISHED_S:  # its writer stopped
                behind += 1
                if behind == len(names):
                    return Manifest(int(names[-1].split(".")[0]))
                name = f"manifest/{names[-1 - behind]}"
                text = self.files.read(name)
            if finished(text):
                break
            time.sleep(0.05)  # its writer is about to finish it
        try:
            m = json.loads(text)
            version = int(names[-1].split(".")[0])
            return Manifest(version, tuple(Commit(**c) for c in m["commits"]), m["next_seq"], m["next_block"], tuple(map(tuple, m["streams"])), tuple(m.get("retired", ())))
        except (ValueError, KeyError, TypeError) as e:
            raise Corrupt(f"{name}: {e}") from None

    def _publish(self, old: Manifest, **changes) -> bool:
        """False if another writer made this version first, or took this one for stopped."""
        new = replace(old, version=old.version + 1, **changes)
        begun = time.time()
        made = self.files.write_new(f"manifest/{new.version:012d}.json", json.dumps(asdict(new)) + "\n")
        return made and (time.time() - begun < UNFINISHED_S or not self.files.exists(f"manifest/{new.version + 1:012d}.json"))

    def _check_open(self) -> None:
        if self.closed:
            raise StoreClosed("the store is closed")

    # reading

    def table(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """All committed rows, with their place and block. Later fields are null in older files. With a time range, only the commits that meet it are opened."""
        self._check_open()
        self.flush()
        commits = [c for c in self._manifest().commits if (end is None or c.min_ts <= end) and (start is None or c.max_ts >= start)]
        return self._read(commits)

    def count_between(self, start: int, end: int) -> DataFrame:
        """How many rows lie in a time range; commits that lie in it whole are not read."""
        self._check_open()
        self.flush()
        commits = self._manifest().commits if start <= end else ()
        inside = [c for c in commits if start <= c.min_ts and c.max_ts <= end]
        part = [c for c in commits if c not in inside and c.min_ts <= end and c.max_ts >= start]
        n = F.lit(sum(c.rows for c in inside)).cast("long")
        if not part:
            return self.spark.range(1).select(n.alias("count"))
        t = named(self.schema.time_field)
        return self._read(part).filter((t >= start) & (t <= end)).agg((F.count(F.lit(1)) + n).alias("count"))

    def _read(self, commits: Iterable[Commit]) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], self.schema.spark())
        return self.spark.read.schema(self.schema.spark()).parquet(*(f"{self.path_}/data/{c.name}" for c in commits))

    def stats(self) -> StoreStats:
        self._check_open()
        self.flush()
        commits = self._manifest().commits
        data = sum(self.files.size(f"data/{c.name}") for c in commits)
        return StoreStats(data, self.files.size("manifest") + self.files.size("schema"), sum(c.blocks for c in commits), len(commits), sum(c.rows for c in commits))

    def column_sizes(self) -> dict[str, int]:
        """Compressed bytes of each column, from the files' footers."""
        import pyarrow.parquet as pq

        from pyarrow import fs

        out: dict[str, int] = {}
        for c in self._manifest().commits:
            where, at = fs.FileSystem.from_uri(self.path_) if "://" in self.path_ else (fs.LocalFileSystem(), self.path_)
            for f in where.get_file_info(fs.FileSelector(f"{at}/data/{c.name}")):
                if f.base_name.startswith("part-"):
                    meta = pq.read_metadata(where.open_input_file(f.path))
                    for g in range(meta.num_row_groups):
                        for k in range(meta.num_columns):
                            col = meta.row_group(g).column(k)
                            out[col.path_in_schema] = out.get(col.path_in_schema, 0) + col.total_compressed_size
        return out

    # writing

    def append(self, event: bytes | str) -> None:
        """Check and queue one event; it is visible after a flush, which every read does first."""
        self._check_open()
        parse_event(self.schema, event)
        self.buffer.append(event.encode() if isinstance(event, str) else event)
        if len(self.buffer) >= self.options.block_rows:
            self.flush()

    def append_durable(self, event: bytes | str) -> None:
        self.append(event)
        self.flush()

    def append_batch_durable(self, events: Iterable[bytes | str]) -> int:
        """All events or, if one of them is wrong, none."""
        self._check_open()
        events = [e.encode() if isinstance(e, str) else e for e in events]
        if not events:
            raise BadRequest("a batch needs an event")
        for e in events:
            parse_event(self.schema, e)
        self.buffer += events
        self.flush()
        return len(events)

    def post(self, body: bytes | str) -> int:
        """One event, or a JSON array of events as one batch; returns how many."""
        text = body if isinstance(body, str) else body.decode("utf-8", "replace")
        if text.lstrip(" \t\r\n").startswith("["):
            return self.append_batch_durable(split_batch(body))
        self.append_durable(body)
        return 1

    def flush(self) -> None:
        self._check_open()
        if self.buffer:
            events, self.buffer = self.buffer, []
            self._ingest(self.spark.createDataFrame([("", k, e.decode()) for k, e in enumerate(events)], "part_ string, pos_ long, value string"))

    def close(self) -> None:
        if not self.closed:
            self.flush()
            self.closed = True

    def ingest_text(self, path: str | list[str]) -> int:
        """Lines of text files, one event each, in the order of the files' names: all of them or, if one is wrong, none."""
        self._check_open()
        self.flush()
        lines = self.spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
        part = F.concat_ws("\n", "file_path", F.lpad(F.col("file_block_start").cast("string"), 20, "0"))
        return self._ingest(lines.select("value", part.alias("part_"), F.monotonically_increasing_id().alias("pos_")))

    def ingest(self, lines: DataFrame, stream: str | None = None, batch: int = 0) -> int:
        """Events in column ``value``, in the order of the DataFrame's partitions. A stream's batch that was committed before is left out."""
        self._check_open()
        if stream is not None and dict(self._manifest().streams).get(stream, -1) >= batch:
            return 0
        rows = lines.select("value").withColumn("pos_", F.monotonically_increasing_id())
        return self._ingest(rows.withColumn("part_", F.lpad(F.shiftright("pos_", 33).cast("string"), 12, "0")), stream, batch)

    def _ingest(self, lines: DataFrame, stream: str | None = None, batch: int = 0) -> int:
        """Parse once into a staging folder; then number the rows, part after part, from the parts' sizes."""
        name = f"data/_{uuid.uuid4().hex}"
        rows = parsed(lines.filter(F.col("value") != ""), self.schema)
        try:
            rows.write.option("compression", self.options.codec).parquet(f"{self.path_}/{name}")
            staged = self.spark.read.schema(rows.schema).parquet(f"{self.path_}/{name}")
            bad = staged.filter("error_ IS NOT NULL").orderBy("part_", "pos_").select("error_").first()
            if bad:
                raise BadRequest(bad[0])
            numbered, total = dense(staged, "pos_")
            return self._commit(numbered.drop("error_"), total, stream, batch) if total else 0
        finally:
            self.files.remove(name)

    def _commit(self, numbered: DataFrame, total: int, stream: str | None = None, batch: int = 0) -> int:
        """Rows with a dense number n_ from 0 become the next rows of the store."""
        size = self.options.block_rows
        while True:
            now = self._manifest()
            streams = dict(now.streams)
            if stream is not None:
                if streams.get(stream, -1) >= batch:
                    return 0
                streams[stream] = batch
            name = f"{now.version + 1:012d}-{uuid.uuid4().hex[:8]}"
            place, block = (F.col("n_") + now.next_seq).alias(SEQ), (F.floor(F.col("n_") / size) + now.next_block).cast("long").alias(BLOCK)
            span = self._write(numbered.select(place, block, *(named(f.name) for f in self.schema.fields)), name, total)
            blocks = -(-total // size)
            commits = (*now.commits, Commit(name, total, blocks, *span))
            if self._publish(now, commits=commits, next_seq=now.next_seq + total, next_block=now.next_block + blocks, streams=tuple(streams.items())):
                return total
            self.files.remove(f"data/{name}")  # another writer was faster: number the rows anew

    def _write(self, rows: DataFrame, name: str, total: int) -> tuple[int, int]:
        # several tasks write a commit of several files, and what comes before is never one task's
        parts = max(1, -(-total // self.options.segment_rows))
        ordered = (rows.repartitionByRange(parts, SEQ) if parts > 1 else rows.repartition(1)).sortWithinPartitions(SEQ)
        writer = ordered.write.option("compression", self.options.codec)
        for f in self.options.bloom_fields:
            writer = writer.option(f"parquet.bloom.filter.enabled#{f}", "true")
        writer.parquet(f"{self.path_}/data/{name}")
        t = named(self.schema.time_field)
        return tuple(self.spark.read.schema(self.schema.spark()).parquet(f"{self.path_}/data/{name}").agg(F.min(t), F.max(t)).first())

    # maintenance

    def drop_blocks_before(self, cutoff_ms: int) -> int:
        """Remove the blocks whose latest row is before the cutoff; returns how many. A block is kept or dropped whole. Files go with the next call that drops, or by vacuum(): who began to read may end."""
        if isinstance(cutoff_ms, bool) or not isinstance(cutoff_ms, int) or not -(1 << 63) <= cutoff_ms < 1 << 63:
            raise BadRequest("the cutoff must be a 64-bit integer")
        self._check_open()
        self.flush()
        now = self._manifest()
        kept, old, dropped = [], [], 0
        for c in now.commits:
            if c.max_ts < cutoff_ms:
                old.append(c)
                dropped += c.blocks
                continue
            live = None
            if c.min_ts < cutoff_ms:
                rows = self.spark.read.schema(self.schema.spark()).parquet(f"{self.path_}/data/{c.name}")
                live = keep_blocks(rows, self.schema, cutoff_ms, BLOCK)
                n, blocks = live.agg(F.count(F.lit(1)), F.countDistinct(BLOCK)).first()
            if live is None or n == c.rows:
                kept.append(c)
                continue
            name = f"{now.version + 1:012d}-{uuid.uuid4().hex[:8]}"
            kept.append(Commit(name, n, blocks, *self._write(live, name, n)))
            old.append(c)
            dropped += c.blocks - blocks
        if not old:
            return 0
        if not self._publish(now, commits=tuple(kept), retired=tuple(c.name for c in old)):
            raise StoreError("another writer changed the store; nothing was dropped")
        for name in now.retired:
            self.files.remove(f"data/{name}")
        return dropped

    def vacuum(self) -> int:
        """Remove the files of dropped blocks; returns of how many commits."""
        self._check_open()
        now = self._manifest()
        if now.retired and not self._publish(now, retired=()):
            raise StoreError("another writer changed the store; nothing was removed")
        for name in now.retired:
            self.files.remove(f"data/{name}")
        return len(now.retired)

    def rewrite_directory(self, destination: str, options: StoreOptions | None = None) -> RewriteReport:
        """All rows in ingest order into a new store; this one stays as it is."""
        self._check_open()
        self.flush()
        target = EventStore.open(self.spark, destination, self.schema, options or self.options)
        if target._manifest().version:
            raise BadRequest("the destination is a store already")
        numbered, total = renumbered(self.table())
        if total:
            target._commit(numbered, total)
        return RewriteReport(self.stats(), target.stats())


def renumbered(table: DataFrame) -> tuple[DataFrame, int]:
    """A table in ingest order, in parts that no task holds together."""
    return dense(table.withColumn("part_", part_of(SEQ)), SEQ)
