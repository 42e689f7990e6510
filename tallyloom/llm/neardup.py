"""Near-duplicate documents: SetSketch registers, bands, likelihood, exact check.

A document's set holds the 64-bit hashes of its distinct five-word shingles (A-Z
in lower case). Each shingle is a Poisson process over the registers; a register
keeps its first arrival, the minimum over the set, on an exponentially spaced
scale. Registers of equal sets are equal, those of a union are the minima, and
two registers agree about as often as the sets' Jaccard similarity.

1. Documents of equal sets are one class, linked by definition; only the class's
   smallest id goes on.
2. Registers are cut into bands; classes that agree on a band share a bucket.
   With 51 bands of 5, two sets of similarity 0.75 share none once in a million.
3. In each bucket, every member is paired with one member picked by the bucket.
   A pair's similarity is estimated from its registers by maximum likelihood;
   pairs far below the threshold are dropped, the others are compared on their
   full sets. Links join to components.
4. In a bucket that still holds several components, the members outside its
   largest one are compared by registers with all others across components, in
   pairs of blocks. Where few pairs of two blocks may be alike, these pairs are
   returned, no more than the blocks have members; else the members that take
   part are, and the same two blocks are compared on full sets, which returns a
   tree of links. No task holds more than two blocks.

So a group of many copies costs a few rows a member. Two members of a bucket are
compared, or connected through others; a link is missed only where two sets share
no band or where their estimate falls ``SLACK`` short (five standard deviations).

Null and empty texts, and texts without words, have empty sets and no links; a
text of fewer than five words is one shingle. Every row is returned. Rows that
share an id are one node: it has the links of all of them. A row without an id is
linked with nothing, and its component is null. Other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cut, documents, sent
from .components import components
from ._words import Words, mix, text_slices, white_space_table, window_hashes

TABLE = white_space_table(True)
REGISTERS, ROWS = 256, 5
BANDS = REGISTERS // ROWS
#: How far below the threshold an estimate may fall.
SLACK = 0.14
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
_U = np.uint64


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = w.hashes()
    all_ = window_hashes(words, size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(all_[a : b - size + 1]))
        else:
            out.append(window_hashes(words[a:b], b - a) if b > a else np.empty(0, dtype=_U))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """REGISTERS values a set, 0 to TOP + 1; all 0 for the empty set."""
    n = len(sets)
    own = np.repeat(np.arange(n), [len(s) for s in sets])
    h = np.concatenate([*sets, np.empty(0, dtype=_U)])
    first = np.full(n * REGISTERS, np.inf)
    time = np.zeros(len(h))
    h = mix(h ^ _U(0x5DEECE66D))
    step = 0
    while len(h):
        step += 1
        h = mix(h + _U(0x9E3779B97F4A7C15))
        time = time - np.log(((h >> _U(12)).astype(np.float64) + 0.5) / (1 << 52)) / (RATE * REGISTERS)
        at = own * REGISTERS + (h & _U(REGISTERS - 1)).astype(np.int64)
        np.minimum.at(first, at, time)
        # later arrivals of a shingle matter only below the set's largest register
        on = time < first.reshape(n, REGISTERS).max(axis=1)[own]
        h, time, own = h[on], time[on], own[on]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(first) / np.log(BASE))
    return np.clip(np.where(np.isfinite(first), k, 0), 0, TOP + 1).reshape(n, REGISTERS).astype("<u2")


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Maximum likelihood Jaccard similarity of register rows x and y, given the sets' sizes.

    With u = nx / (nx + ny) and v = 1 - u, a register of x is the larger with
    probability p(u - v J), that of y with p(v - u J), else they agree.
    """
    up, down = (x > y).sum(axis=1), (x < y).sum(axis=1)
    same = x.shape[1] - up - down
    u = nx / (nx + ny)
    v = 1 - u
    scale = (BASE - 1) / BASE

    def p(z):
        return -np.log1p(-np.clip(z, 0, 1) * scale) / np.log(BASE)

    most = np.minimum(u / v, v / u)
    lo, hi = np.zeros(len(u)), most.copy()
    ratio = (np.sqrt(5) - 1) / 2

    def value(j):
        a, b = p(u - v * j), p(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(up > 0, up * np.log(np.maximum(a, 1e-300)), 0) + np.where(down > 0, down * np.log(np.maximum(b, 1e-300)), 0)
            return t + np.where(same > 0, same * np.log(np.maximum(1 - a - b, 1e-300)), 0)

    for _ in range(40):  # the likelihood has one peak
        c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        left = value(c) > value(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


def _sets(batch, size):
    for i, j, raw, off in text_slices(batch.column("text")):
        yield i, j, shingle_sets(Words(raw, off, TABLE), size)


def _sketch(size: int):
    def run(batches):
        np.seterr(over="ignore")
        for b in batches:
            for i, j, sets in _sets(b, size):
                regs = registers(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    ["doc_id", "n", "print", "regs"],
                )

    return run


def _bands(batches):
    """Each class to its bands: a hash of a band's registers, its low bits the band's number, is the bucket."""
    np.seterr(over="ignore")
    for b in batches:
        n = len(b)
        if not n:
            continue
        regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), dtype="<u2").reshape(n, REGISTERS)
        key = regs[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
        packed = np.zeros((n, BANDS), dtype=_U)
        for k in range(ROWS):
            packed = mix(packed ^ key[:, :, k].astype(_U) * _U(0x9E3779B97F4A7C15))
        packed = (packed & ~_U(63)) | np.arange(BANDS, dtype=_U)[None, :]
        ids = b.column("id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, BANDS)), pa.array(packed.ravel().view(np.int64))], ["id", "bucket"])


def _likely(least: float):
    """Pairs whose estimated similarity is at least this."""

    def run(batches):
        for b in batches:
            n = len(b)
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u2").reshape(n, REGISTERS) for c in ("regs_a", "regs_b"))
            nx, ny = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            yield b.select(["a", "b"]).filter(pa.array(estimate(x, y, nx, ny) >= least))

    return run


def alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _alike(percent: int):
    """Pairs whose sets have 100 * intersection >= percent * union."""

    def run(batches):
        for b in batches:
            keep = [alike(*(np.frombuffer(v.as_buffer(), dtype=_U) for v in pair), percent) for pair in zip(b.column("set_a"), b.column("set_b"))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _full(size: int):
    def run(batches):
        np.seterr(over="ignore")
        for b in batches:
            for i, j, sets in _sets(b, size):
                raw = [s.tobytes() for s in sets]
                prints = [hashlib.blake2b(x, digest_size=16).digest() for x in raw]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(prints, pa.binary()), pa.array(raw, pa.binary())], ["id", "print", "set"])

    return run


class Forest:
    """Which members are connected; the smaller of two roots is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class Group:
    """Two blocks of a bucket's members. Side 0 is compared with side 1; members of side 2 with each other."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.id, self.side, self.n = (np.array([r[c] for r in rows]) for c in ("id", "side", "n"))
        self.component, self.names = np.unique([r["component"] for r in rows], return_inverse=True)
        self.regs = np.frombuffer(b"".join(r["regs"] for r in rows), dtype="<u2").reshape(len(rows), REGISTERS)

    def likely(self, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs across components that may be alike, and how often their registers agree."""
        x, y = np.flatnonzero(self.side != 1), np.flatnonzero(self.side != 0)
        none = np.empty(0, dtype=np.int64)
        if len(self.component) < 2 or not len(x) or not len(y):
            return none, none, none.astype(float)
        agree = np.stack([(self.regs[y] == self.regs[i]).mean(axis=1) for i in x.tolist()])
        # registers agree about as often as sets do; what is far above or below needs no estimate
        open_ = (agree >= least - 0.1) & (self.names[x][:, None] != self.names[y][None, :])
        if self.side[0] == 2:
            open_ &= x[:, None] < y[None, :]
        i, j = np.nonzero(open_)
        how = agree[i, j]
        i, j, n = x[i], y[j], self.n.astype(float)
        grey = how < least + 0.1
        keep = ~grey
        if grey.any():
            p, q = i[grey], j[grey]
            keep[grey] = estimate(self.regs[p], self.regs[q], n[p], n[q]) >= least
        return i[keep], j[keep], how[keep]

    def links(self, least: float, percent: int) -> list[tuple[int, int]]:
        """Ids of pairs that are alike by their full sets and connect the components, the likeliest first."""
        i, j, how = self.likely(least)
        order = np.argsort(-how, kind="stable")
        sets = [np.frombuffer(r["set"], dtype=_U) for r in self.rows]
        forest, left, out = Forest(len(self.component)), len(self.component) - 1, []
        for a, b in zip(i[order].tolist(), j[order].tolist()):
            if forest.root(self.names[a]) != forest.root(self.names[b]) and alike(sets[a], sets[b], percent):
                forest.join(self.names[a], self.names[b])
                out.append((int(self.id[a]), int(self.id[b])))
                left -= 1
                if not left:
                    break
        return out


def _groups(batches):
    """Rows sorted by group to one list a group; one group is held at a time."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            key = (r["bucket"], r["p"], r["q"])
            if key != now:
                if rows:
                    yield rows
                now, rows = key, []
            rows.append(r)
    if rows:
        yield rows


def _screen(least: float):
    """Of each group: the pairs that may be alike (``other`` is not null) if they are no more than its members, else the members in such pairs."""

    def run(batches):
        for rows in _groups(batches):
            g = Group(rows)
            i, j, _ = g.likely(least)
            if not len(i):
                continue
            if len(i) <= len(rows):
                take, other = i, pa.array(g.id[j], pa.int64())
            else:
                take = np.unique(np.concatenate([i, j]))
                other = pa.nulls(len(take), pa.int64())
            cols = {c: pa.array([rows[k][c] for k in take.tolist()], kind) for c, kind in (("bucket", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("side", pa.int32()), ("component", pa.int64()), ("id", pa.int64()))}
            yield pa.RecordBatch.from_pydict(cols | {"other": other})

    return run


def _crowds(least: float, percent: int):
    """Of each group: a tree of links that connects its components as far as they are alike."""

    def run(batches):
        for rows in _groups(batches):
            if found := Group(rows).links(least, percent):
                a, b = np.array(found, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return run


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """Members (bucket, id, component) of buckets with several components to pairs of blocks (bucket, p, q), with their side.

    Members of a bucket's largest component are in blocks of one kind, all others
    in blocks of another: each of the others' blocks meets every block.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top")).filter("size > top.n")
    sizes = cut(sizes)  # written, so that a join with a large bucket can be split
    few, many = F.ceil((F.col("size") - F.col("top.n")) / block).cast("int"), F.ceil(F.col("top.n") / block).cast("int")
    rows = members.join(sizes, "bucket").withColumns({"few": few, "many": many, "inner": F.col("component") == F.col("top.component")})
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.when(F.col("inner"), F.col("many")).otherwise(F.col("few"))).cast("int"))
    mine, place = F.col("mine"), lambda p, q, side: F.struct(p.alias("p"), q.alias("q"), side.alias("side"))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    across = F.transform(each(F.col("many")), lambda j: place(mine, j, F.lit(0)))
    apart = F.transform(each(F.col("few")), lambda o: place(F.least(mine, o), F.col("many") + F.greatest(mine, o), F.when(mine == o, 2).when(mine < o, 0).otherwise(1)))
    meets = F.when(F.col("inner"), F.transform(each(F.col("few")), lambda i: place(i, mine, F.lit(1)))).otherwise(F.concat(across, apart))
    return rows.select("bucket", "id", "component", F.explode(meets).alias("at")).select("bucket", "id", "component", "at.*")


def _shared_ids(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    several = sketches.groupBy("doc_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).filter("lo < hi").select("doc_id")
    at = sent(sketches.select("doc_id", "print"), several, ["doc_id"], "left_semi").join(classes.select("print", "id"), "print")
    return at.join(at.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b").filter("a <> b").distinct()


def link(df: DataFrame, shingle: int = 5, percent: int = 75, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row, whose id is a whole number: doc_id, n_shingles and component_id, the smallest id reachable over links."""
    d = documents(df, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    least = percent / 100 - SLACK
    sketches = cut(d.mapInArrow(_sketch(shingle), "doc_id long, n long, print binary, regs binary"))
    named = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    classes = cut(named.groupBy("print").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    light = classes.select("id", "print", "n", "regs")
    parts_ = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def full_sets(ids: DataFrame) -> DataFrame:
        ids = cut(ids)  # asked for four times
        mine = sent(light, ids, ["id"], "left_semi")
        texts = sent(d.select(F.col("doc_id").alias("id"), "text"), ids, ["id"], "left_semi")
        return cut(texts.mapInArrow(_full(shingle), "id long, print binary, set binary").join(mine, ["id", "print"]).groupBy("id").agg(*(F.first(c).alias(c) for c in ("n", "regs", "set"))))

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
        return cut(pairs.join(one, "a").join(two, "b").mapInArrow(_alike(percent), "a long, b long"))

    def compared(rows: DataFrame, run, schema: str) -> DataFrame:
        return rows.repartition(parts_, "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(run, schema)

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    buckets = classes.select("id", "regs").mapInArrow(_bands, "id long, bucket long")
    shared = cut(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = cut(buckets.join(shared, "bucket"))
    # one member of each bucket, another one in every bucket: the first in an order that depends on it
    picks = cut(members.groupBy("bucket").agg(F.min(F.col("id").bitwiseXOR(F.col("bucket"))).alias("one")))
    picked = members.join(picks, "bucket").select("id", F.col("one").bitwiseXOR(F.col("bucket")).alias("pick")).filter("id <> pick")
    one, two = (light.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")) for x in "ab")
    pairs = picked.select(F.greatest("id", "pick").alias("a"), F.least("id", "pick").alias("b")).distinct().join(one, "a").join(two, "b")
    pairs = cut(pairs.mapInArrow(_likely(least), "a long, b long"))
    links = verified(pairs, full_sets(ends(pairs))).unionByName(_shared_ids(named, classes))
    parts = components(links)
    # what the picks left apart
    apart = cut(members.filter("size > 2").select("bucket", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    rows = _dealt(apart, block).join(light.drop("print"), "id")
    open_ = cut(compared(rows, _screen(least), "bucket long, p int, q int, side int, component long, id long, other long"))
    if not open_.isEmpty():
        pairs = open_.filter("other IS NOT NULL").select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()
        crowd = open_.filter("other IS NULL").drop("other")
        sets = full_sets(ends(pairs).unionByName(crowd.select("id")).distinct())
        more = cut(compared(crowd.join(sets, "id"), _crowds(least, percent), "a long, b long"))
        tied = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b")
        parts = components(tied.unionByName(verified(pairs, sets)).unionByName(more))
    own = classes.select("print", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("print", F.coalesce("component", "id").alias("component"))
    linked = sketches.join(own, "print", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return linked.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75) -> DataFrame:
    """The rows of df without those linked to a smaller id; rows without an id stay, and rows that share an id stay or go together."""
    linked = link(df, shingle, percent, id_col=id_col, text_col=text_col)
    later = cut(linked.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)))
    return sent(df, later, [id_col], "left_anti")
