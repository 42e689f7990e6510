"""Byte-level BPE encoding and decoding over whole texts.

A text of at most ``chunk_chars`` characters is one chunk. A longer one is dealt
out as chunks that overlap: each chunk is split into pre-tokens on its own, and
neighbours are stitched at the first position of their overlap at which both
have a pre-token boundary after a character that is no white space. From a common
boundary on, both splits go on alike, as the pattern never looks back. It looks
ahead only past white space (a run of it leaves its last character to the word
that follows), so a piece that ends in other characters splits as it does in the
whole text. The pieces are encoded in parallel and their ids joined in order.
Where an overlap has no such boundary (one endless word, or nothing but white
space), the two chunks are one piece.

Null and empty texts have no ids; rows that repeat are each returned; a null id
is kept; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import documents

#: A match that ends this close to a chunk's end may end elsewhere in the whole text.
GUARD = 8
ID_CELLS = 1 << 20


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    import tiktoken

    name = hashlib.sha256(f"{path}\n{pattern}".encode()).hexdigest()
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def boundaries(chunk: str, pattern: str, last: bool) -> list[int]:
    """Starts of the pre-tokens of a chunk; only those sure to hold in the whole text, unless it is the last chunk."""
    import regex

    out, sure = [], len(chunk) if last else len(chunk) - GUARD
    for m in regex.compile(pattern).finditer(chunk):
        if m.start() > sure:
            break
        out.append(m.start())
        if m.end() > sure:
            break
    return out


def cut_points(head: list[int], tail: list[int]) -> int | None:
    """The first boundary that the end of one chunk and the start of the next share, after the start."""
    common = set(tail) & set(head) - {0}
    return min(common) if common else None


def after_white_space(chunk: str, at: int) -> bool:
    return at > 0 and chunk[at - 1].isspace()


def _encode(path: str, pattern: str):
    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            ids = [enc.encode_to_numpy(t, disallowed_special=()) if t else np.empty(0, np.uint32) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32))
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.ListArray.from_arrays(pa.array(ends), flat)], [*keep, "ids"])

    return run


def _chunks(chunk: int, overlap: int):
    """Long texts to overlapping chunks."""

    def run(batches):
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                row = b.slice(i, 1)
                at = list(range(0, max(1, len(text) - overlap), chunk))
                for k in range(0, len(at), 64):
                    part = at[k : k + 64]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.concat_arrays([row.column("doc_id")] * n),
                            pa.concat_arrays([row.column("tk")] * n),
                            pa.concat_arrays([row.column("copies")] * n),
                            pa.array(part, pa.int64()),
                            pa.array([s == at[-1] for s in part]),
                            pa.array([text[s:] if s == at[-1] else text[s : s + chunk + overlap] for s in part], pa.string()),
                        ],
                        ["doc_id", "tk", "copies", "at", "last", "text"],
                    )

    return run


def _edges(pattern: str, chunk: int, overlap: int):
    """Adds the boundaries within the two overlaps of each chunk, counted from the overlap's start."""

    def run(batches):
        for b in batches:
            heads, tails = [], []
            for text, last in zip(b.column("text").to_pylist(), b.column("last").to_pylist()):
                found = boundaries(text, pattern, last)
                found = [p for p in found if not after_white_space(text, p)]
                heads.append([p for p in found if p <= overlap])
                tails.append([p - chunk for p in found if p >= chunk])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], [*b.schema.names, "head", "tail"]
            )

    return run


def _stitch(chunk: int):
    """The chunks of one text to pieces that start at true pre-token boundaries."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("at")
        pieces, open_ = [], ""
        rows = list(zip(pdf["text"], pdf["head"], pdf["tail"]))
        begin = 0  # where the open piece's part of this chunk begins
        for k, (text, _, tail) in enumerate(rows):
            point = cut_points(list(rows[k + 1][1]), list(tail)) if k + 1 < len(rows) else None
            if k + 1 == len(rows):
                pieces.append(open_ + text[begin:])
            elif point is None:
                open_, begin = open_ + text[begin:chunk], 0
            else:
                pieces.append(open_ + text[begin : chunk + point])
                open_, begin = "", point
        return pd.DataFrame(
            {"doc_id": pdf["doc_id"].iloc[0], "tk": pdf["tk"].iloc[0], "copies": pdf["copies"].iloc[0], "piece": range(len(pieces)), "text": pieces}
        )

    return run


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32768, overlap: int = 1024) -> DataFrame:
    """doc_id and ids of every text; the ids are those of the rank file's library for the whole text."""
    d = documents(df, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    short = F.coalesce(F.length("text"), F.lit(0)) <= chunk_chars + overlap
    run = _encode(ranks_path, pattern)
    whole = d.filter(short).mapInArrow(run, f"doc_id {kind}, ids array<int>")
    long = d.filter(~short).groupBy("doc_id", F.xxhash64("text").alias("tk"), "text").agg(F.count(F.lit(1)).alias("copies")).select("doc_id", "tk", "copies", "text")
    chunks = long.mapInArrow(_chunks(chunk_chars, overlap), f"doc_id {kind}, tk long, copies long, at long, last boolean, text string").repartition("doc_id", "tk", "at")
    edges = chunks.mapInArrow(_edges(pattern, chunk_chars, overlap), f"doc_id {kind}, tk long, copies long, at long, last boolean, text string, head array<int>, tail array<int>")
    pieces = edges.groupBy("doc_id", "tk").applyInPandas(_stitch(chunk_chars), f"doc_id {kind}, tk long, copies long, piece long, text string").repartition("doc_id", "tk", "piece")
    coded = pieces.mapInArrow(run, f"doc_id {kind}, tk long, copies long, piece long, ids array<int>")
    joined = coded.groupBy("doc_id", "tk", "copies").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda p: p["ids"])).alias("ids"))
    return whole.unionByName(joined.select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy"))


@lru_cache(maxsize=4)
def _bytes_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for word, i in table.items():
        out[i] = word
    length = np.array([len(x) for x in out], dtype=np.int64)
    return np.frombuffer(b"".join(out), dtype=np.uint8), np.cumsum(length) - length, length


def decode_ids(ids: np.ndarray, path: str) -> np.ndarray:
    """The bytes of all ids, joined."""
    raw, start, length = _bytes_table(path)
    n = length[ids]
    return raw[np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``data``, the raw bytes of the ids; null ids have empty bytes. An id outside the vocabulary is an error."""

    def run(batches):
        for b in batches:
            col = b.column(b.schema.names.index(ids_col))
            if col.null_count:
                col = col.fill_null([])
            ends = col.offsets.to_numpy() - col.offsets[0].as_py()
            ids = col.flatten().to_numpy()
            parts, sizes = [np.empty(0, np.uint8)], []
            _, _, length = _bytes_table(ranks_path)
            for k in range(0, len(ids), ID_CELLS):
                parts.append(decode_ids(ids[k : k + ID_CELLS], ranks_path))
            sizes = np.concatenate([[0], np.cumsum(length[ids])])[ends].astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(sizes), pa.py_buffer(np.concatenate(parts))])
            yield pa.RecordBatch.from_arrays([*b.columns, data], [*b.schema.names, "data"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, data binary")


def digests(decoded: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256 of decoded rows; with ids, these as well."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
        *(["ids"] if ids else []),
    )
