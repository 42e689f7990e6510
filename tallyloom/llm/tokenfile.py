"""Token ids as files of equal-length sequences.

Documents are put in ascending order of id, split by ranges; each task encodes
its range and writes two Arrow IPC files to the shared folder. ``*.tokens.arrow``
holds batches of fixed-size lists: ``ids`` (uint16 where the vocabulary allows,
else uint32) and ``mask`` (bool, false on the padding that fills a file's last
sequence). ``*.docs.arrow`` holds each document's id, its start among the file's
ids and its count. A batch of fixed-size lists is one flat buffer, so a mapped
file gives any sequence without a copy. Files are written under a name of the
attempt's own and renamed when whole, so a task that runs again just replaces
what it wrote.

Each document ends with ``end_id``; null and empty texts have only that. Rows
that repeat are each written; ties of the id are ordered by text hash; a null id
comes first. Without rows there are files without sequences.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import documents, new_folder

#: White space, printable ASCII, Latin letters and common marks: what case folding, NFC and the
#: library's splitting treat character by character, in every version of Unicode.
PLAIN = r"[\t\n\r\x20-\x7e¡-įı-ɏ‐-‧‰-⁞€]*"
MEMO = 250_000


class WordTokenizer:
    """A lower-casing BPE with word ends, word by word with a bounded memo.

    Its library splits at white space before all else, so the ids of a text are
    those of its words. A text with characters outside PLAIN, or with a special
    token's brackets, is given to the library whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and pre == ["Split", "ByteLevel"]
        if self.by_word:
            self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.plain = regex.compile(PLAIN)
        self.special = [x["content"] for x in spec["added_tokens"]]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        # ids by word and by part of a word; the older half is dropped when the newer one is full
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        out = self.old_parts.get(part)
        if out is None:
            tokens = self.library.model.tokenize("".join(map(self.shown.__getitem__, part.encode())))
            out = array(self.dtype.char, [t.id for t in tokens]).tobytes()
        if len(self.parts) > MEMO:
            self.old_parts, self.parts = self.parts, {}
        self.parts[part] = out
        return out

    def _word(self, word: str) -> bytes:
        out = self.old_words.get(word)
        if out is None:
            low = word.lower()
            stem = low.rstrip(".,;:!?")
            # letters, then marks: two parts at most, without the splitting pattern
            parts = [stem, low[len(stem) :]] if stem.isalpha() else self.split.findall(low)
            out = b"".join([self.parts.get(p) or self._part(p) for p in parts if p])
        if len(self.words) > MEMO:
            self.old_words, self.words = self.words, {}
        self.words[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian integers of ``dtype``."""
        if self.by_word and self.plain.fullmatch(text) and not any(s in text for s in self.special):
            words = text.split()
            ids = list(map(self.words.get, words))
            if None in ids:
                ids = [x if x is not None else self._word(w) for w, x in zip(words, ids)]
            return b"".join(ids)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def _place(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Sequences:
    """Writes ids as batches of equal-length sequences."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch: int = 1024):
        self.length, self.batch, self.dtype = length, batch, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.rest: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.rest.append(ids)
        self.size += len(ids)
        full = self.length * self.batch * self.dtype.itemsize
        if self.size >= full:
            data = b"".join(self.rest)
            for k in range(0, len(data) - full + 1, full):
                self._put(np.frombuffer(data, dtype=self.dtype, count=self.length * self.batch, offset=k))
            self.rest = [data[len(data) // full * full :]]
            self.size = len(self.rest[0])

    def _put(self, flat: np.ndarray) -> None:
        n = -(-len(flat) // self.length)
        ids = np.zeros(n * self.length, dtype=self.dtype)
        ids[: len(flat)] = flat
        mask = np.arange(n * self.length) < len(flat)
        parts = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(parts, schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._put(np.frombuffer(b"".join(self.rest), dtype=self.dtype))
        self.file.close()


def _write(path: str, folder: str, length: int, end_id: int, kind: pa.DataType):
    def run(batches):
        from pyspark import TaskContext

        fs, at = _place(folder)
        fs.create_dir(at, recursive=True)
        tok = tokenizer(path)
        part = TaskContext.get().partitionId()
        name, own = f"{at}/part-{part:06d}", f"{at}/_{uuid.uuid4().hex}"
        end = np.array([end_id], dtype=tok.dtype).tobytes()
        docs = pa.schema([("doc_id", kind), ("start", pa.int64()), ("n_tokens", pa.int64())])
        start = rows = 0
        with fs.open_output_stream(f"{own}.tokens") as a, fs.open_output_stream(f"{own}.docs") as b, pa.ipc.new_file(b, docs) as index:
            out = Sequences(a, tok.dtype, length)
            for batch in batches:
                begins, sizes = [], []
                for text in batch.column("text").to_pylist():
                    ids = tok.encode(text or "") + end
                    out.add(ids)
                    begins.append(start)
                    sizes.append(len(ids) // tok.dtype.itemsize)
                    start += sizes[-1]
                rows += len(sizes)
                index.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id").cast(kind), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64())], schema=docs))
            out.close()
        for x in ("tokens", "docs"):
            fs.move(f"{own}.{x}", f"{name}.{x}.arrow")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [rows], "n_ids": [start]}, schema=pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write(df: DataFrame, path: str, folder: str, end_id: int, length: int = 2048, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts; returns one row for each file: part, n_docs, n_ids and base, the ids in the files before it."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = documents(df, id_col, text_col)
    field = d.schema["doc_id"].dataType
    kind = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[field.simpleString()]
    tie = F.xxhash64("text")
    run = _write(path, folder, length, end_id, kind)
    files = d.repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie).mapInArrow(run, "part int, n_docs long, n_ids long")
    rows = sorted(files.collect())  # one row for each file
    base, out = 0, []
    for part, docs, ids in rows:
        out.append((part, docs, ids, base))
        base += ids
    return spark.createDataFrame(out, "part int, n_docs long, n_ids long, base long")


class TokenFile:
    """Random access to the sequences of one file, without a copy where the folder is a local one."""

    def __init__(self, folder: str, part: int):
        fs, at = _place(folder)
        name = f"{at}/part-{part:06d}"
        source = pa.memory_map(f"{name}.tokens.arrow") if fs.type_name == "local" else fs.open_input_file(f"{name}.tokens.arrow")
        self.file = pa.ipc.open_file(source)
        with fs.open_input_file(f"{name}.docs.arrow") as f:
            self.docs = pa.ipc.open_file(f).read_all()
        self.length = self.file.schema.field("ids").type.list_size
        counts = [self.file.get_batch(k).num_rows for k in range(self.file.num_record_batches)]
        self.ends = np.cumsum(counts)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence k."""
        b = int(np.searchsorted(self.ends, k, side="right"))
        at = (k - (int(self.ends[b - 1]) if b else 0)) * self.length
        ids, mask = self.file.get_batch(b).columns
        return ids.values.slice(at, self.length).to_numpy(), mask.values.slice(at, self.length).to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the start-th on."""
        out = [np.empty(0, np.uint32)]
        first, last = start // self.length, (start + n - 1) // self.length
        k = first
        while k <= last and n:
            b = int(np.searchsorted(self.ends, k, side="right"))
            before = int(self.ends[b - 1]) if b else 0
            flat = self.file.get_batch(b).column(0).values
            lo = max(start - before * self.length, 0)
            hi = min(start + n - before * self.length, len(flat))
            out.append(flat.slice(lo, hi - lo).to_numpy())
            k = int(self.ends[b])
        return np.concatenate(out)


def _read(folder: str):
    def run(batches):
        for b in batches:
            for part, base in zip(b.column("part").to_pylist(), b.column("base").to_pylist()):
                f = TokenFile(folder, part)
                start, size = (f.docs.column(c).to_numpy() for c in ("start", "n_tokens"))
                step = 4096
                for k in range(0, len(start), step):
                    s, n = start[k : k + step], size[k : k + step]
                    flat = f.ids(int(s[0]), int(n.sum())).astype("<u4").tobytes()
                    view, o = memoryview(flat), (4 * (s - s[0])).tolist()
                    crc = [zlib.crc32(view[a : a + 4 * m]) for a, m in zip(o, n.tolist())]
                    ids = f.docs.column("doc_id").slice(k, step).combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids, pa.array(s + base), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_index(spark: SparkSession, folder: str, files: DataFrame, kind: str = "bigint") -> DataFrame:
    """For each document in the files: doc_id, start among all ids, n_tokens and ids_crc32 of its ids as little-endian 32-bit integers."""
    n = max(1, files.count())
    return files.select("part", "base").repartition(n, "part").mapInArrow(_read(folder), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, path: str, end_id: int, length: int = 2048) -> DataFrame:
    """Write to a new folder and read back."""
    spark = df.sparkSession
    folder = new_folder(spark)
    files = write(df, path, folder, end_id, length)
    return read_index(spark, folder, files, df.schema["doc_id"].dataType.simpleString())
