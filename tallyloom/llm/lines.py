"""Line deduplication: equal lines, and lines within an edit distance.

A line with at least ``min_chars`` characters, white space around it not
counted, is dropped where an equal line stands earlier: in a document of smaller
id, or before it in the same one. A line of at least ``min_edit_chars`` also
goes, everywhere, if a line whose first place is earlier lies within
``threshold`` edits. Decisions are made on the input, not on what is left.

The edit join cuts each line into threshold + 1 segments; within the distance,
one segment of the shorter line is a substring of the longer one, near its own
place. Each line is filed under its segments, by length and number, and looked up
with the substrings that the length difference allows. Pairs found so are thinned
by the parity of their words (an edit changes at most three) and then verified by
a bit-parallel edit distance in a band of the threshold: one bit for each diagonal
of the band, one word for each number of errors, one step for each character.

A threshold of 1 has two finer indexes for segments and parts that very many lines
share; see ``near_pairs``. Their pairs are linear in the lines, however large a
family of like lines is.

Only DataFrame functions run here. The id is a whole number (else a TypeError).
Null and empty texts have no lines to drop; rows that repeat an id are each
treated as a document and do not count as earlier than each other; a null id is
later than all others. All columns of the input stay, under their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import cut, sent

LAST = (1 << 63) - 1
SPACE = " \t\r\x0b\x0c"


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g")]


def _row(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """doc and tk: the id, and a hash that tells rows apart whose id is null or repeats. Rows equal in both get equal results."""
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError("the id must be a whole number")
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("tk")]


def _trimmed(line: Column) -> Column:
    """The line without white space around it. Trimming a set of characters goes through the whole line, so only lines that need it are."""
    padded = reduce(or_, (at(c) for c in SPACE for at in (line.startswith, line.endswith)))
    return F.when(padded, F.trim(line, F.lit(SPACE))).otherwise(line)


def _lines(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc, tk, no and line of the lines long enough; line is without white space around it."""
    # the row's hash is made before the text is split: beside the split it would be made anew for each line
    d = df.select(*_row(df, id_col, text_col), F.col(f"`{text_col}`").alias("text_")).select("doc", "tk", F.posexplode(F.split("text_", "\n", -1)).alias("no", "line"))
    return d.withColumn("line", _trimmed(F.col("line"))).filter(F.length("line") >= min_chars)


def segment(n: Column, k: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment k of a line of length n: the last ones are longer by one where needed."""
    size = F.floor(n / parts).cast("int")
    longer = (n - size * parts).cast("int")
    before = F.greatest(F.lit(0), F.lit(k) - (F.lit(parts) - longer))
    return size * k + before + 1, size + F.when(F.lit(k) >= F.lit(parts) - longer, 1).otherwise(0)


def _filed(line: Column, threshold: int) -> list[Column]:
    n, parts = F.length(line), threshold + 1
    keys = []
    for k in range(parts):
        start, size = segment(n, k, parts)
        keys.append(F.xxhash64(n, F.lit(k), F.substr(line, start, size)))
    return keys


def _probes(line: Column, threshold: int, least: int) -> list[Column]:
    """Keys of the segments that a line at most threshold shorter may share, but for those the line is filed under itself."""
    n, parts = F.length(line), threshold + 1
    keys = []
    for less in range(threshold + 1):
        m = n - less
        for k in range(parts):
            start, size = segment(m, k, parts)
            lo, hi = max(-k, less - (threshold - k)), min(k, less + (threshold - k))
            keys += [F.when(m >= least, F.xxhash64(m, F.lit(k), F.substr(line, start + shift, size))) for shift in range(lo, hi + 1) if less or shift]
    return keys


#: A segment that more lines than this have in one place is looked up with the rest of the line.
CROWD = 16
PARTS = 8


def _rest(line: Column, less: int) -> list[Column]:
    """Keys of a line without one of its PARTS parts: lines of equal length that differ in one place share one, as does a line with one longer by less, taken apart as if the addition were in the part."""
    n = F.length(line) - less
    keys = []
    for k in range(PARTS):
        start, size = segment(n, k, PARTS)
        after = n - (start - 1) - size
        keys.append(F.xxhash64(n, F.lit(k), F.substr(line, F.lit(1), start - 1), F.substr(line, F.length(line) - after + 1, after)))
    return keys


def _variants(line: Column, k: int) -> tuple[Column, Column]:
    """Keys of a line without each character of part k, the first kind by the place of the character as well."""
    n = F.length(line)
    start, size = segment(n, k, PARTS)
    without = lambda at: F.concat(F.substr(line, F.lit(1), at - 1), F.substr(line, at + 1, n - at))
    each = lambda key: F.transform(F.sequence(start, start + size - 1), key)
    return each(lambda at: F.xxhash64(n, at, without(at))), each(lambda at: F.xxhash64(without(at)))


def near_pairs(lines: DataFrame, threshold: int, min_edit_chars: int) -> DataFrame:
    """Pairs of line hashes that share a segment; the place of a line is its first.

    For a threshold of 1, lines of a segment that more than CROWD lines have are
    matched by all but one of eight parts instead. Where more than CROWD lines
    share seven parts, they are matched by what is left when one character of the
    eighth is taken out: lines with the same rest and place are all an edit from
    each other, so each is paired with the one that stands first; a line whose
    rest is another line is paired with that. Every line an edit away from an
    earlier one is still in a pair with an earlier one. For other thresholds a
    crowded segment stays as it is.
    """
    own = lines.filter(F.length("line") >= min_edit_chars).select("doc", "tk", "no", "line", F.xxhash64("line").alias("h"))
    sides = ((_filed(F.col("line"), threshold), 0), (_probes(F.col("line"), threshold, min_edit_chars), 1))
    every = F.array(*(F.struct(key.alias("key"), F.lit(side).alias("side")) for keys, side in sides for key in keys))
    keys = cut(own.select("h", F.explode(every).alias("k")).filter("k.key IS NOT NULL").select("h", "k.key", "k.side").distinct())
    # a line asks for what it is filed under, too
    filed, asked = keys.filter("side = 0").select("key", F.col("h").alias("b")), keys.select("key", F.col("h").alias("a"))
    finer = []
    if threshold == 1:
        crowded = cut(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("key"))
        many = cut(sent(keys, crowded, ["key"], "left_semi").select("h").distinct())
        filed = sent(filed, crowded, ["key"], "left_anti")
        kept = cut(sent(own, many, ["h"], "left_semi").groupBy("h", "line").agg(F.min(F.struct("doc", "no", "tk")).alias("at")))
        rests = lambda less: F.array(*(F.struct(F.lit(k).alias("k"), key.alias("key")) for k, key in enumerate(_rest(F.col("line"), less))))
        one = kept.select(F.col("h").alias("b"), F.explode(rests(0)).alias("r")).select("b", "r.key", "r.k").distinct()
        two = kept.select(F.col("h").alias("a"), F.explode(F.concat(rests(0), rests(1))).alias("r")).select("a", "r.key", "r.k").distinct()
        thick = cut(one.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("key"))
        finer.append(two.join(sent(one, thick, ["key"], "left_anti"), "key").select("a", "b"))
        # lines that have or ask for a crowded part, with the numbers of these parts
        parts = sent(two, thick, ["key"], "left_semi").select(F.col("a").alias("h"), "k").unionByName(sent(one, thick, ["key"], "left_semi").select(F.col("b").alias("h"), "k"))
        parts = cut(parts.groupBy("h").agg(F.collect_set("k").alias("ks")))  # eight numbers at most
        dense = kept.join(parts, "h")
        if not parts.isEmpty():
            picked = lambda kind: F.flatten(F.array(*(F.when(F.array_contains("ks", k), _variants(F.col("line"), k)[kind]).otherwise(F.array().cast("array<bigint>")) for k in range(PARTS))))
            same = cut(dense.select("h", "at", F.explode(picked(0)).alias("key")))
            first = same.groupBy("key").agg(F.min(F.struct("at", "h")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.col("first.h").alias("b"))
            finer.append(same.select("key", F.col("h").alias("a")).join(cut(first), "key").select("a", "b"))
            whole = kept.select(F.xxhash64("line").alias("key"), F.col("h").alias("b"))
            finer.append(dense.select(F.col("h").alias("a"), F.explode(picked(1)).alias("key")).join(whole, "key").select("a", "b"))
    pairs = asked.join(filed, "key").select("a", "b")
    for x in finer:
        pairs = pairs.unionByName(x)
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether b is at most threshold edits from a, both arrays of characters.

    Bit d + threshold of word e says that the first j + d characters of a are at
    most e edits from the first j of b. With the next character of b, a diagonal
    goes on where characters agree or, from the word of one error less, by a
    substitution; an insertion comes from the diagonal above, a deletion from the
    one below.
    """
    t, full = threshold, (1 << (2 * threshold + 1)) - 1
    names = [f"e{e}" for e in range(t + 1)]
    zero = F.struct(*(F.lit(sum(1 << (d + t) for d in range(e + 1))).cast("long").alias(n) for e, n in enumerate(names)))

    def step(state: Column, j: Column) -> Column:
        c = F.get(b, j)
        agree = sum((F.when(F.get(a, j + d) == c, F.lit(1 << (d + t)).cast("long")).otherwise(F.lit(0).cast("long")) for d in range(-t, t + 1)), F.lit(0).cast("long"))

        def words(m: Column) -> Column:
            new = [state[names[0]].bitwiseAND(m)]
            for e in range(1, t + 1):
                less = state[names[e - 1]]
                moved = less.bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new[e - 1], 1))
                new.append(state[names[e]].bitwiseAND(m).bitwiseOR(moved).bitwiseAND(F.lit(full).cast("long")))
            return F.struct(*(x.alias(n) for x, n in zip(new, names)))

        return F.element_at(F.transform(F.array(agree), words), 1)

    # Spark's sequence counts down where its end is below its start
    places = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(places, zero, step, lambda s: s[names[t]])
    apart = F.size(a) - F.size(b)
    return (F.abs(apart) <= t) & (F.call_function("shiftright", end, F.greatest(F.lit(0), F.least(F.lit(2 * t), apart + t))).bitwiseAND(F.lit(1).cast("long")) == 1)


def characters(line: Column) -> Column:
    return F.filter(F.split(line, ""), lambda c: c != "")


def _parity(line: Column) -> Column:
    """64 bits: how many words of each of 64 kinds, odd or even."""
    kinds = F.transform(F.split(line, "[\\x20\\x09-\\x0D]+"), lambda x: F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    return F.aggregate(kinds, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))


def dropped(df: DataFrame, threshold: int = 1, min_chars: int = 24, min_edit_chars: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, tk, no of the lines to drop, with near (true if an edit away from an earlier one)."""
    lines = _lines(df, id_col, text_col, min_chars)
    places = lines.select("doc", "tk", "no", *_hashes(F.col("line")))
    pairs = cut(near_pairs(lines, threshold, min_edit_chars))
    names = cut(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct())
    found = sent(lines.filter(F.length("line") >= min_edit_chars).select("doc", "tk", "no", "line", *_hashes(F.col("line"))), names, ["h"], "left_semi")
    texts = cut(found.groupBy("h", "g", "line").agg(F.min(F.struct("doc", "no", "tk")).alias("at")).withColumn("parity", _parity(F.col("line"))))
    one, two = (texts.select(F.col("h").alias(x), F.col("g").alias(f"g_{x}"), F.col("parity").alias(f"parity_{x}")) for x in "ab")
    thin = pairs.join(one, "a").join(two, "b").filter(F.bit_count(F.col("parity_a").bitwiseXOR(F.col("parity_b"))) <= 3 * threshold).select("a", "g_a", "b", "g_b")
    one, two = (texts.select(F.col("h").alias(x), F.col("g").alias(f"g_{x}"), characters(F.col("line")).alias(f"line_{x}"), F.col("at").alias(f"at_{x}")) for x in "ab")
    close = thin.join(one, ["a", "g_a"]).join(two, ["b", "g_b"]).filter(within(F.col("line_a"), F.col("line_b"), threshold))
    later = F.col("at_a") > F.col("at_b")
    near = cut(close.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("h"), F.when(later, F.col("g_a")).otherwise(F.col("g_b")).alias("g")).distinct())
    # of each line that occurs twice or is near an earlier one: its first document; within a document by place
    first = places.groupBy("h", "g").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("times"))
    first = cut(sent(first, near.withColumn("near", F.lit(True)), ["h", "g"], "left").filter("times > 1 OR near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near")))
    again = sent(places, first, ["h", "g"], "inner")
    equal = again.filter((F.col("doc") > F.col("first")) | F.col("near")).select("doc", "tk", "no", (F.col("near") & (F.col("doc") == F.col("first"))).alias("near"))
    # in the first document all places but the first one; there the places are collected, by document
    inner = again.filter(F.col("doc") == F.col("first")).groupBy("doc", "tk", "h", "g").agg(F.array_sort(F.collect_set("no")).alias("nos"))
    same = inner.filter(F.size("nos") > 1).select("doc", "tk", F.explode(F.slice("nos", 2, F.size("nos"))).alias("no"), F.lit(False).alias("near"))
    return equal.unionByName(same).groupBy("doc", "tk", "no").agg(F.min("near").alias("near"))


def dedup(df: DataFrame, threshold: int = 1, min_chars: int = 24, min_edit_chars: int = 48, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, drop_empty: bool = False, drop_wordless: bool = False) -> DataFrame:
    """df with the dropped lines taken out of its text; with counts, also n_lines, n_equal and n_near; with drop_empty, without the rows that lost lines and have only lines under min_chars left; with drop_wordless, without those that lost lines and have no word left."""
    gone = dropped(df, threshold, min_chars, min_edit_chars, id_col, text_col)
    gone = gone.groupBy("doc", "tk").agg(F.collect_list("no").alias("no"), F.count_if(F.col("near")).alias("near"), F.count_if(~F.col("near")).alias("equal"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *_row(df, id_col, text_col))
    joined = rows.join(gone, ["doc", "tk"], "left")
    old = F.col("row")[text_col]
    kept = F.array_join(F.filter(F.split(old, "\n", -1), lambda x, i: ~F.array_contains("no", i)), "\n")
    new = F.when(F.col("no").isNull(), old).otherwise(kept)
    out = [(new if c == text_col else F.col("row")[c]).alias(c) for c in df.columns]
    if drop_empty:
        long = F.exists(F.split(kept, "\n", -1), lambda x: F.length(_trimmed(x)) >= min_chars)
        joined = joined.filter(F.col("no").isNull() | long)
    if drop_wordless:
        joined = joined.filter(F.col("no").isNull() | kept.rlike(r"[^\x20\x09-\x0D]"))
    if counts:
        out += [F.coalesce(F.size(F.split(old, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(f"n_{c}") for c in ("equal", "near"))]
    return joined.select(*out)
