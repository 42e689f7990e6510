"""Benchmark decontamination with suffix arrays of the training texts.

The documents are taken in shards, the slices of a task's batches. A shard's
words become numbers of the benchmark's vocabulary; a word that no benchmark
text has ends every match, so only suffixes that start with enough known words
are sorted. Every suffix of every benchmark text is then looked up in the
shard's suffix array by binary search; matches that go on from word to word are
joined into longest verbatim matches with their places. No row moves between
tasks. The benchmark is read in blocks of at most ``block_words`` words, and only
one block is sent to the tasks at a time.

Words are runs of characters other than ASCII ones that are neither letter nor
digit, with A-Z in lower case. A window has ``window`` words; a benchmark text of
fewer, but not none, is one window. Null and empty texts have no words; repeated
items and rows count each; an item without an id is written as an empty string;
without documents or items nothing is hit.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cut, documents
from ._words import Words, alphanumeric_table, text_slices

TABLE = alphanumeric_table()
HITS = "array<struct<start:bigint,end:bigint>>"
MATCHES = "array<struct<item_id:string,doc_start:bigint,item_start:bigint,length:bigint>>"


class Block:
    """Some benchmark texts: each distinct word sequence once, with the ids of its items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        np.seterr(over="ignore")
        self.window = window
        off = np.cumsum([0, *(len(t) for _, t in items)])
        w = Words(np.frombuffer(b"".join(t for _, t in items), dtype=np.uint8), off, TABLE)
        self.vocabulary, number = np.unique(w.hashes(), return_inverse=True)
        self.ids: list[list[str]] = []
        self.sequences: list[np.ndarray] = []
        self.texts: list[list[bytes]] = []
        known: dict[bytes, int] = {}
        for k, (item, _) in enumerate(items):
            a, b = int(w.first[k]), int(w.first[k + 1])
            if a == b:
                continue
            text = w.bytes_of(a, b)
            if text not in known:
                known[text] = len(self.ids)
                self.ids.append([])
                self.sequences.append(number[a:b].astype(np.int64) + 1)
                self.texts.append(text.split(b" "))
            if item not in self.ids[known[text]]:
                self.ids[known[text]].append(item)
        self.least = min((min(window, len(s)) for s in self.sequences), default=0)
        self.most = max((len(s) for s in self.sequences), default=0)
        flags = np.zeros(1 << 16, dtype=bool)
        flags[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.flags = flags

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 1; 0 for words that the block has not."""
        out = np.zeros(len(hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.flags[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == hashes[maybe]
        out[maybe[same]] = at[same] + 1
        return out


def suffix_array(seq: np.ndarray, depth: int, where: np.ndarray) -> np.ndarray:
    """Positions ``where`` in the order of what follows them, compared over depth words at least."""
    rank, k = seq, 1
    while k < depth:
        nxt = np.zeros_like(rank)
        nxt[:-k] = rank[k:]
        values, rank = np.unique(rank * (int(rank.max()) + 2) + nxt, return_inverse=True)
        k *= 2
        if len(values) == len(rank):
            break
    return where[np.argsort(rank[where], kind="stable")]


def find(words: Words, block: Block) -> list[tuple[int, int, int, int]]:
    """Longest verbatim matches in one shard: word, sequence number, word of the sequence, length."""
    if not block.least or not words.n:
        return []
    number = block.numbers(words.hashes())
    number_of_text = words.owner()
    # runs of known words within one text
    known = number > 0
    fresh = np.ones(words.n, dtype=bool)
    fresh[1:] = ~known[:-1] | (number_of_text[1:] != number_of_text[:-1])
    begins = np.flatnonzero(known & fresh)
    stop = np.ones(words.n, dtype=bool)
    stop[:-1] = ~known[1:] | (number_of_text[1:] != number_of_text[:-1])
    length = np.flatnonzero(known & stop) + 1 - begins
    long = length >= block.least
    begins, length = begins[long], length[long]
    if not len(begins):
        return []
    # the shard's text: the runs, each ended by a 0
    step = length + 1
    base = np.cumsum(step) - step
    place = np.repeat(begins - base, step) + np.arange(int(step.sum()))
    ends = base + length
    seq = number[np.minimum(place, words.n - 1)]
    seq[ends] = 0
    left = np.repeat(ends, step) - np.arange(len(seq))
    sa = suffix_array(seq, block.most, np.flatnonzero(left >= block.least))
    raw = seq.astype(">u4").tobytes()
    order = sa.tolist()
    found: list[tuple[np.ndarray, int, int, int]] = []
    for k, s in enumerate(block.sequences):
        w = min(block.window, len(s))
        pattern = s.astype(">u4").tobytes()
        key = lambda p, n=4 * w: raw[4 * p : 4 * p + n]
        for j in range(len(s) - w + 1):
            want = pattern[4 * j : 4 * (j + w)]
            lo = bisect_left(order, want, key=key)
            if lo < len(order) and key(order[lo]) == want:
                found.append((place[sa[lo : bisect_right(order, want, lo=lo, key=key)]], k, j, w))
    out = []
    if found:
        p = np.concatenate([f[0] for f in found])
        k, j, w = (np.repeat([f[i] for f in found], [len(f[0]) for f in found]) for i in (1, 2, 3))
        o = np.lexsort((p, p - j, k))
        p, k, j, w = p[o], k[o], j[o], w[o]
        first = np.ones(len(p), dtype=bool)
        first[1:] = (p[1:] != p[:-1] + 1) | (j[1:] != j[:-1] + 1) | (k[1:] != k[:-1]) | (number_of_text[p[1:]] != number_of_text[p[:-1]])
        at = np.flatnonzero(first)
        size = np.diff([*at, len(p)]) - 1 + w[at]
        for a, c, d, n in zip(p[at].tolist(), k[at].tolist(), j[at].tolist(), size.tolist()):
            if words.bytes_of(a, a + n) == b" ".join(block.texts[c][d : d + n]):
                out.append((a, c, d, n))
            else:  # two words share a hash: keep the windows that are truly equal
                w1 = min(block.window, len(block.sequences[c]))
                out += [(a + x, c, d + x, w1) for x in range(n - w1 + 1) if words.bytes_of(a + x, a + x + w1) == b" ".join(block.texts[c][d + x : d + x + w1])]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scan(block: Block):
    def run(batches):
        np.seterr(over="ignore")
        for b in batches:
            n_words, hits, matches = [], b.column("hits").to_pylist(), b.column("matches").to_pylist()
            for i, j, raw, off in text_slices(b.column("text")):
                w = Words(raw, off, TABLE)
                n_words += np.diff(w.first).tolist()
                own = w.owner()
                by: dict[int, list] = {}
                for m in find(w, block):
                    by.setdefault(int(own[m[0]]), []).append(m)
                for d, found in by.items():
                    first = int(w.first[d])
                    spans = [(h["start"], h["end"]) for h in hits[i + d]] + [(a - first, a - first + n) for a, _, _, n in found]
                    hits[i + d] = [{"start": x, "end": y} for x, y in merged(spans)]
                    matches[i + d] = matches[i + d] + [
                        {"item_id": item, "doc_start": a - first, "item_start": s, "length": n} for a, c, s, n in found for item in block.ids[c]
                    ]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("text"),
                    pa.array(n_words, pa.int64()),
                    pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(matches, pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))),
                ],
                ["doc_id", "text", "n_words", "hits", "matches"],
            )

    return run


def benchmark_blocks(bench: DataFrame, window: int, block_words: int, item_col: str = "item_id", text_col: str = "text"):
    """The benchmark as Blocks of at most block_words words (or one text)."""
    items: list[tuple[str, bytes]] = []
    size = 0
    rows = bench.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    for i, t in rows.toLocalIterator():
        data = t.encode()
        n = 1 + len(data) // 2
        if items and size + n > 2 * block_words:
            yield Block(items, window)
            items, size = [], 0
        # texts of two items are never joined into one word
        items.append((i, data + b" "))
        size += n
    if items:
        yield Block(items, window)


def contamination(df: DataFrame, bench: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_words: int = 500_000) -> DataFrame:
    """One row for each document: doc_id, text, n_words, hits (word spans inside windows that occur, disjoint and in order) and matches (longest verbatim matches by item)."""
    kind = df.schema[id_col].dataType.simpleString()
    out = documents(df, id_col, text_col).select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(HITS).alias("hits"), F.array().cast(MATCHES).alias("matches"))
    blocks = 0
    for block in benchmark_blocks(bench, window, block_words):
        out = out.mapInArrow(_scan(block), f"doc_id {kind}, text string, n_words long, hits {HITS}, matches {MATCHES}")
        blocks += 1
        if blocks % 8 == 0:
            out = cut(out)
    return out if blocks else out.mapInArrow(_scan(Block([], window)), f"doc_id {kind}, text string, n_words long, hits {HITS}, matches {MATCHES}")


def n_hit() -> F.Column:
    """Words inside the hit spans."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])


def item_ids() -> F.Column:
    """The ids of items with occurring windows, distinct, sorted as strings."""
    return F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))


def decontaminate(df: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """The rows of df whose text has no window of the benchmark, with all their columns."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col("text").alias("text"))  # so no name can clash
    kept = contamination(rows, bench, window, id_col="row")
    return kept.filter(F.size("hits") == 0).select("doc_id.*")
