"""Quality rules: counts, repetition, and divergence from the language's own texts.

The base rules reject texts of few words and texts that mostly repeat
three-word windows. The divergence rule compares two histograms of a text, of
character classes and of its language's most common words, with references by
Jensen-Shannon distance (base 2, 0 to 1). A language's references are the
median shares, to four decimals, over all its documents that pass the base rules.
A text goes if its characters are far off, or rather far off and its common words
as well. Texts too short for a histogram pass that rule, as do texts in languages
without a word list for the word histogram.

Only DataFrame functions run here. Null and empty texts have no words; each row
is judged alone, so rows that repeat get equal results; a null language is a
language of its own; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import cut

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Very common words by language code.
COMMON_WORDS = {
    "en": "the of and to in is that for it as was with be by on are this".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im nicht ein".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur".split(),
    "es": "de la que el en y a los se del las un por con no una para".split(),
}
N_COMMON = 17
N_CLASSES = 2 + 5 + 1  # small letters, white space, CLASSES, the rest

#: Character classes beside small letters and white space: name and characters.
CLASSES = {
    "upper": "A-Z",
    "digit": "0-9",
    "stop": r".,;:?'\"()\-",
    "shout": "!",
    "symbol": r"#*$%&|<>@^~=+/\\\[\]{}_`",
}


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


#: Low bits of a packed number that hold a window's place; the rest is its hash. Longer texts are counted by the windows themselves.
PLACE = 24


def _covered(places: Column) -> Column:
    """Words in the three-word windows that start at the given places, in ascending order."""
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n")), lambda a: a["n"])


def _neighbours(v: Column, same) -> Column:
    """Numbers of the cells that are the same as the next one; an empty array has none."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0))), lambda j: same(F.get(v, j), F.get(v, j + 1)))


def _both(v: Column, at: Column, place) -> Column:
    """Places, ascending, of the cells at these numbers and of those after them."""
    cells = F.flatten(F.transform(at, lambda j: F.array(place(F.get(v, j)), place(F.get(v, j + 1)))))
    return F.sort_array(F.array_distinct(cells))


def repeated_words_by_text(w: Column) -> Column:
    """The same as repeated_words, by sorting the windows as text."""
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.cast("long").alias("i")))
    return let(F.sort_array(every), lambda v: _covered(_both(v, _neighbours(v, lambda x, y: x["s"] == y["s"]), lambda x: x["i"])))


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array.

    Each window is a number, hash bits above and its place below; sorted, equal
    windows are neighbours. If neighbours with equal bits are different windows,
    the bits cannot tell, and the text's windows are sorted themselves.
    """
    n = F.size(w)
    mask, low = F.lit(-(1 << PLACE)), F.lit((1 << PLACE) - 1)

    def windows(h: Column) -> Column:
        two = F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: F.xxhash64(a, b))
        three = F.zip_with(F.slice(two, 1, n - 2), F.slice(h, 3, n - 2), lambda a, b: F.xxhash64(a, b))
        return F.transform(three, lambda x, i: x.bitwiseAND(mask).bitwiseOR(i.cast("long")))

    packed = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
    place = lambda v: v.bitwiseAND(low)

    def differ(x: Column, y: Column) -> Column:
        i, j = place(x).cast("int"), place(y).cast("int")
        return (F.get(w, i) != F.get(w, j)) | (F.get(w, i + 1) != F.get(w, j + 1)) | (F.get(w, i + 2) != F.get(w, j + 2))

    def counted(v: Column) -> Column:
        alike = _neighbours(v, lambda x, y: F.shiftright(x.bitwiseXOR(y), PLACE) == 0)
        clash = lambda at: F.exists(at, lambda j: differ(F.get(v, j), F.get(v, j + 1)))
        return let(alike, lambda at: F.when(clash(at), repeated_words_by_text(w)).otherwise(_covered(_both(v, at, place))))

    fast = F.when(n <= 1 << PLACE, let(F.sort_array(packed), counted)).otherwise(repeated_words_by_text(w))
    return F.when(n >= 3, fast).otherwise(F.lit(0).cast("long"))


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _histogram(lang: Column, w: Column) -> Column:
    """How often each common word of the language, in small letters, is among the words; null without a list."""
    lists = F.create_map(*(v for code, ws in COMMON_WORDS.items() for v in (F.lit(code), F.array(*map(F.lit, ws)))))
    found = lambda ws: F.filter(w, lambda x: F.array_contains(ws, x))
    return let(F.element_at(lists, F.coalesce(lang, F.lit(""))), lambda ws: let(found(ws), lambda c: F.transform(ws, lambda k: F.size(F.filter(c, lambda x: x == k)))))


def features(df: DataFrame, keep: list[str] | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Columns of df in ``row`` (all, or those to keep), and counts beside it."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in df.columns else F.lit(None).cast("string")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in keep or df.columns)).alias("row"), text.alias("t"), lang.alias("lang"))
    t = F.col("t")
    # what is left after the most frequent classes are taken out is short
    rows = rows.withColumn("w", words(t)).withColumn("r", F.regexp_replace(t, "[a-z]+", ""))
    w, r = F.col("w"), F.col("r")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.select(
        "row",
        "lang",
        F.length(t).cast("long").alias("n_chars"),
        F.size(w).cast("long").alias("n_words"),
        F.length(r).alias("n_rest"),
        F.regexp_replace(r, "[\\x20\\x09-\\x0D]+", "").alias("r"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        _histogram(F.col("lang"), w).alias("counts"),
    )
    space = F.col("n_rest") - F.length(r)
    classes = F.array(F.col("n_chars") - F.col("n_rest"), space, *(_removed(r, _spelled(c)) for c in CLASSES.values()))
    return rows.select(
        "row",
        "lang",
        "n_words",
        (F.col("n_chars") - space).cast("long").alias("word_chars"),
        _removed(r, SYMBOLS).cast("long").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        "n_chars",
        _shares(classes, F.col("n_chars")).alias("char_shares"),
        F.when(F.size("counts") >= 0, _shares(F.col("counts"), F.col("n_words"))).alias("word_shares"),
    )


def _spelled(ranges: str) -> str:
    """The characters of a class of CLASSES, one by one."""
    import re

    return "".join(chr(c) for c in range(128) if re.fullmatch(f"[{ranges}]", chr(c)))


def _shares(counts: Column, total: Column) -> Column:
    """Counts and the rest of the total, as shares."""

    def of(c: Column) -> Column:
        rest = F.greatest(F.lit(0).cast("long"), total.cast("long") - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
        return F.transform(F.concat(F.transform(c, lambda x: x.cast("long")), F.array(rest)), lambda x: x / F.greatest(total, F.lit(1)).cast("double"))

    return let(counts, of)


def _normal(a: Column) -> Column:
    return let(a, lambda x: F.transform(x, lambda v: v / F.greatest(F.lit(1e-9), F.aggregate(x, F.lit(0.0), lambda s, y: s + y))))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))


def judge(df: DataFrame, keep: list[str] | None = None, text_col: str = "text", lang_col: str = "lang", min_words: int = 50, max_repeat: int = 50, min_chars: int = 200, max_char_distance: float = 0.35, near_char_distance: float = 0.18, max_word_distance: float = 0.25, max_languages_sent: int = 10_000) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed and kept, beside ``row``, the input's columns (all, or those to keep)."""
    counts = cut(features(df, keep, text_col, lang_col))
    sizes = (("char_shares", N_CLASSES), ("word_shares", N_COMMON + 1))
    fair = (F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words) & (100 * F.col("n_repeat_words") <= max_repeat * F.col("n_words"))
    # shares are rounded, so an exact median counts at most ten thousand values, and no deal of the rows changes it
    middle = [F.percentile(F.when(fair, F.round(F.get(s, F.lit(k)), 4)), 0.5).alias(f"{s}{k}") for s, n in sizes for k in range(n)]
    reference = counts.groupBy(F.coalesce("lang", F.lit("")).alias("lang_key")).agg(*middle)
    reference = reference.select("lang_key", *(_normal(F.array(*(F.coalesce(F.col(f"{s}{k}"), F.lit(0.0)) for k in range(n)))).alias(f"ref_{s}") for s, n in sizes))
    reference = cut(reference)
    if reference.count() <= max_languages_sent:  # else the join deals out both sides
        reference = F.broadcast(reference)
    out = counts.withColumn("lang_key", F.coalesce("lang", F.lit(""))).join(reference, "lang_key")
    long = (F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words)
    out = out.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.when(long, distance(F.col("char_shares"), F.col("ref_char_shares"))).alias("char_distance"),
        F.when(long & F.col("word_shares").isNotNull(), distance(F.col("word_shares"), F.col("ref_word_shares"))).alias("word_distance"),
        ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))).alias("base_failed"),
    )
    chars, common = F.coalesce("char_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    far = (chars > max_char_distance) | ((chars > near_char_distance) & (common > max_word_distance))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)
