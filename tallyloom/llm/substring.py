"""Substring deduplication by super-k-mers of words.

A window is ``window`` consecutive words of one document. Its minimiser is the
smallest hash among its ``m``-word parts, so neighbouring windows mostly share
it; a maximal run of such windows travels as one packed string (the words of all
its windows) to the bucket of the minimiser. All occurrences of a window meet in
one bucket, where its windows are sorted and told apart by their full words, and
those that also start in a document of smaller id are reported. Only what was
found travels back to the documents.

A task holds one bucket's strings compressed, and opens them in passes by the
minimisers' second hash.

Before the shuffle each task does the same within a slice of its documents: a
window that a smaller id has in the same slice is reported at once and does not
travel. A passage that a third of all documents share thus costs its bucket one
packed string a slice, not one a document.

Null and empty texts have no words. A null id is later than any other id. Rows
that share an id are not earlier copies of each other; each is returned. An id of
another type is a TypeError. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import cut, documents, sent
from ._words import Words, mix, text_slices, white_space_table, window_hashes

TABLE = white_space_table(False)
LAST = np.iinfo(np.int64).max
HEAD = np.dtype([("doc", "<i8"), ("tk", "<i8"), ("start", "<i4"), ("size", "<i4"), ("sub", "u1")])
#: Text in a bucket, about, and packed strings that are open at a time: a bucket is settled in passes over parts of its minimisers.
BUCKET_BYTES, PASS_BYTES = 16 << 20, 8 << 20


def sliding_min(v: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    width = 1
    while 2 * width <= n:
        v = np.minimum(v[: len(v) - width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (n - width)], v[n - width :]) if n > width else v


def later_copies(w: Words, at: np.ndarray, h: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Of windows that start at words ``at``, with hashes and documents: which ones a smaller document has, too."""
    later = np.zeros(len(at), dtype=bool)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    first = np.ones(len(hs), dtype=bool)
    first[1:] = hs[1:] != hs[:-1]
    begins = np.flatnonzero(first)
    if len(begins) == len(hs):
        return later
    ds = doc[order]
    least = np.minimum.reduceat(ds, begins)
    group = np.cumsum(first) - 1
    mins = np.flatnonzero(ds == least[group])
    pick = np.zeros(len(begins), dtype=np.int64)
    pick[group[mins][::-1]] = mins[::-1]
    late = np.flatnonzero(ds > least[group])
    # a window equals the one picked if all its words do: compare the bytes
    a, b = at[order[late]], at[order[pick[group[late]]]]
    end = w.start + w.length
    lo_a, hi_a, lo_b, hi_b = w.start[a], end[a + window - 1], w.start[b], end[b + window - 1]
    text = w.text.tobytes()
    same = np.fromiter((text[p:q] == text[r:s] for p, q, r, s in zip(lo_a.tolist(), hi_a.tolist(), lo_b.tolist(), hi_b.tolist())), dtype=bool, count=len(a))
    later[order[late[same]]] = True
    if not same.all():  # different windows share a hash: settle those groups by their words
        for g in np.unique(group[late[~same]]):
            rows = order[begins[g] : begins[g + 1] if g + 1 < len(begins) else len(order)]
            by: dict[bytes, int] = {}
            words = [w.bytes_of(int(at[r]), int(at[r]) + window) for r in rows]
            for r, x in zip(rows, words):
                by[x] = min(by.get(x, LAST), int(doc[r]))
            for r, x in zip(rows, words):
                later[r] = doc[r] > by[x]
    return later


def runs_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of consecutive numbers in ascending ``at``."""
    if not len(at):
        return at, at
    first = np.ones(len(at), dtype=bool)
    first[1:] = at[1:] != at[:-1] + 1
    k = np.flatnonzero(first)
    return at[k], np.diff([*k, len(at)])


def _batch(bucket, doc, tk, start, count, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(doc, pa.int64()), pa.array(tk, pa.int64()), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(data, pa.binary())],
        ["bucket", "doc", "tk", "start", "count", "data"],
    )


SCHEMA = "bucket int, doc long, tk long, start int, count int, data binary"


def _found(doc, tk, start, count, spread: int) -> pa.RecordBatch:
    """Reported windows on their way to their documents; they pass the shuffle beside the packed strings."""
    bucket = -1 - (mix(np.asarray(doc).astype(np.uint64)) % np.uint64(spread)).astype(np.int64)
    return _batch(bucket, doc, tk, start, count, pa.nulls(len(doc), pa.binary()))


def _pack(window: int, m: int, buckets: int):
    def run(batches):
        import zstandard

        np.seterr(over="ignore")
        squeeze = zstandard.ZstdCompressor(level=5)
        for b in batches:
            ids = b.column("doc").to_numpy(zero_copy_only=False)
            keys = b.column("tk").to_numpy(zero_copy_only=False)
            for i, j, raw, off in text_slices(b.column("text")):
                w = Words(raw, off, TABLE)
                if w.n < window:
                    continue
                own = w.owner()
                inside = own[: w.n - window + 1] == own[window - 1 :]
                word = w.hashes()
                at = np.flatnonzero(inside)
                doc = ids[i:j][own[at]]
                late = later_copies(w, at, window_hashes(word, window)[at], doc, window)
                if late.any():
                    start, count = runs_of(at[late])
                    # windows inside a text only, so a run of them is of one text
                    yield _found(ids[i:j][own[start]], keys[i:j][own[start]], start - w.first[own[start]], count, buckets)
                go = at[~late]
                if not len(go):
                    continue
                least = sliding_min(window_hashes(word, m), window - m + 1)[go]
                new = np.ones(len(go), dtype=bool)
                new[1:] = (go[1:] != go[:-1] + 1) | (least[1:] != least[:-1]) | (own[go[1:]] != own[go[:-1]])
                k = np.flatnonzero(new)
                start, size = go[k], np.diff([*k, len(go)])
                spread = mix(least[k])
                bucket, sub = (spread % np.uint64(buckets)).astype(np.int32), (mix(spread) >> np.uint64(56)).astype(np.uint8)
                order = np.lexsort((sub, bucket))
                start, size, bucket, sub = start[order], size[order], bucket[order], sub[order]
                lo = w.start[start]
                length = (w.start + w.length)[start + size + window - 2] - lo + 1
                ends = np.cumsum(length)
                text = w.text[np.repeat(lo - (ends - length), length) + np.arange(int(ends[-1]))].tobytes()
                head = np.empty(len(start), dtype=HEAD)
                head["doc"], head["tk"] = ids[i:j][own[start]], keys[i:j][own[start]]
                head["start"], head["size"], head["sub"] = start - w.first[own[start]], length, sub
                cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
                data = []
                for a, z in zip(cuts[:-1], cuts[1:]):
                    body = b"".join(np.ascontiguousarray(head[f][a:z]).tobytes() for f in HEAD.names) + text[(ends[a] - length[a]) : ends[z - 1]]
                    data.append((z - a).to_bytes(4, "little") + squeeze.compress(body))
                n = len(data)
                yield _batch(bucket[cuts[:-1]], np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32), data)

    return run


def _opened(blobs: list[bytes], lo: int, hi: int) -> tuple[np.ndarray, bytes]:
    """Heads and text of the packed strings with sub-buckets from lo to hi, hi excluded; they are sorted by it."""
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    heads, texts = [], []
    for x in blobs:
        n = int.from_bytes(x[:4], "little")
        body = open_.decompress(x[4:])
        head, at = np.empty(n, dtype=HEAD), 0
        for f in HEAD.names:  # column by column
            head[f] = np.frombuffer(body, dtype=HEAD[f], count=n, offset=at)
            at += n * HEAD[f].itemsize
        a, z = np.searchsorted(head["sub"], [lo, hi])
        before = int(head["size"][:a].sum())
        heads.append(head[a:z])
        texts.append(body[at + before : at + before + int(head["size"][a:z].sum())])
    return np.concatenate(heads), b"".join(texts)


def _settle(blobs: list[bytes], window: int, spread: int):
    """All packed strings of one bucket: the windows that a smaller document has, too. Equal windows share a minimiser, and so a pass."""
    import zstandard

    passes = min(256, sum(zstandard.frame_content_size(x[4:]) for x in blobs) // PASS_BYTES + 1)
    for k in range(passes):
        head, text = _opened(blobs, 256 * k // passes, 256 * (k + 1) // passes)
        off = np.concatenate([[0], np.cumsum(head["size"], dtype=np.int64)])
        w = Words(np.frombuffer(text, dtype=np.uint8), off, TABLE)
        if w.n < window:
            continue
        own = w.owner()
        at = np.flatnonzero(own[: w.n - window + 1] == own[window - 1 :])
        late = later_copies(w, at, window_hashes(w.hashes(), window)[at], head["doc"][own[at]], window)
        if late.any():
            start, count = runs_of(at[late])
            # a run may go on into the next packed string of another place: windows lie inside one string, so it does not
            h = head[own[start]]
            yield _found(h["doc"], h["tk"], h["start"] + start - w.first[own[start]], count, spread)


def _buckets(window: int, spread: int):
    """Rows come sorted by bucket: reported windows pass, packed strings are settled bucket by bucket."""

    def run(batches):
        np.seterr(over="ignore")
        now, blobs = None, []
        for b in batches:
            bucket = b.column("bucket").to_numpy(zero_copy_only=False)
            k = int(np.searchsorted(bucket, 0))
            if k:
                yield b.slice(0, k)
            data = b.column("data")
            for r in range(k, len(bucket)):
                if bucket[r] != now:
                    if blobs:
                        yield from _settle(blobs, window, spread)
                    now, blobs = bucket[r], []
                blobs.append(data[r].as_py())
        if blobs:
            yield from _settle(blobs, window, spread)

    return run


def _cover(window: int):
    def run(batches):
        np.seterr(over="ignore")
        for b in batches:
            found = b.column("found")
            out_n, out_r, out_k = [], [], []
            for i, j, raw, off in text_slices(b.column("text")):
                w = Words(raw, off, TABLE)
                out_n += np.diff(w.first).tolist()
                for d in range(j - i):
                    a, z = int(w.first[d]), int(w.first[d + 1])
                    spans = found[i + d].as_py()
                    if not spans:
                        out_r.append(0)
                        out_k.append(w.bytes_of(a, z))
                        continue
                    edge = np.zeros(z - a + 1, dtype=np.int64)
                    s = np.array([(x["start"], x["count"]) for x in spans], dtype=np.int64)
                    np.add.at(edge, s[:, 0], 1)
                    np.add.at(edge, s[:, 0] + s[:, 1] + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    out_r.append(int(gone.sum()))
                    start, count = runs_of(np.flatnonzero(~gone))
                    out_k.append(b" ".join(w.bytes_of(a + p, a + p + n) for p, n in zip(start.tolist(), count.tolist())))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(out_n, pa.int64()), pa.array(out_r, pa.int64()), pa.array([x.decode() for x in out_k], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeats(df: DataFrame, window: int = 13, m: int = 3, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept: each text without the words covered by a window that a document of smaller id has, too; words joined by one space.

    The id is a whole number. ``buckets`` follows the bytes of the texts and spark.sql.shuffle.partitions where it is not given.
    """
    spark = df.sparkSession
    d = documents(df, id_col, text_col)
    kind = d.schema["doc_id"].dataType
    if not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError("the id must be a whole number")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if buckets is None:
        size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(1 << 30, max(4 * parts, size // BUCKET_BYTES))
    parts = max(parts, min(100_000, buckets // 4))
    # the id tells rows apart, and where it repeats or is null, a hash of the text does; rows equal in both get equal results
    several = d.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("again"))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc")
    tk = F.when(F.col("doc_id").isNull() | F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    keyed = sent(d, cut(several), ["doc_id"], "left").select("doc_id", doc, tk.alias("tk"), "text")
    packed = keyed.select("doc", "tk", "text").mapInArrow(_pack(window, m, buckets), SCHEMA)
    found = packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_buckets(window, buckets), SCHEMA)
    spans = found.groupBy("doc", "tk").agg(F.collect_set(F.struct("start", "count")).alias("found"))
    joined = keyed.join(spans, ["doc", "tk"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_cover(window), f"doc_id {kind.simpleString()}, n_words long, n_removed long, kept string")
