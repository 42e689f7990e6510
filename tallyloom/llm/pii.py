"""Personal data: entities by pattern, and terms that give them away.

Base entities are e-mail and IP addresses, card and phone numbers. Beyond them,
a term near an entity may tell which entity it is. How strongly is measured over
the corpus: with p the share of documents, the pointwise mutual information
log2(p(entity, term) / (p(entity) p(term))) never exceeds the entity's own
information -log2 p(entity); a term whose ratio of the two reaches the threshold
discloses the entity and is generalised wherever it stands, in documents without
the entity too: a number to its first digit and its length, a word to its form (a
name, a code or a word). The classes go through the same test; where a class
itself discloses, the term is removed. All counts are of documents, however far apart
the two stand; what lies inside base entities is no term. There is no least
number of documents: a pair counts if the term would hardly fall in so many of
the entity's documents by chance. With q the term's share of documents and n_both
of n_entity documents, that chance is at most
2^-(n_entity KL(n_both / n_entity || q)); times the number of terms in the corpus
it must not pass ``chance``. So words that merely stand there once are left alone
where such words are common, and not where they are rare.

Spans are in code points, end exclusive; spans of one kind do not overlap.

Only DataFrame functions run here. Null and empty texts have no spans; each row
is treated on its own, and rows that repeat count as documents of their own in
the statistics; an empty table has no rows. A corpus without entities has no
terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import cut, sent

#: Kind, pattern, and what a text must hold for it. Possessive parts and the look-behind change
#: no match; they keep long runs of letters or digits from being tried at each of their places.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
TERM = r"[\p{L}\p{N}][\p{L}\p{N}'-]*+"
SPANS = "array<struct<start:int,end:int>>"
STEP = 64


def let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(part: Column, base: Column) -> Column:
    """Spans of (gap, size) pairs that follow each other from base on."""
    zero = F.struct(base.alias("pos"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(
        part,
        zero,
        lambda a, x: F.struct(
            (a["pos"] + x["gap"] + x["size"]).alias("pos"),
            F.concat(a["out"], F.array(F.struct((a["pos"] + x["gap"]).alias("start"), (a["pos"] + x["gap"] + x["size"]).alias("end")))).alias("out"),
        ),
        lambda a: a["out"],
    )


def spans(text: Column, pattern: str) -> Column:
    """Start and end of all matches, from left to right: what stands between them and the matches themselves give the places."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size")))
    parts = F.filter(parts, lambda x: x["size"].isNotNull())

    def blocks(p: Column) -> Column:  # a fold appends to its array, so it is kept short
        cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(STEP)), lambda k: F.slice(p, k, STEP))
        sums = F.transform(cuts, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x["gap"] + x["size"]))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
        return let(starts, lambda at: F.flatten(F.transform(cuts, lambda b, k: _fold(b, F.get(at, k)))))

    return F.when(text.rlike(pattern), let(parts, blocks)).otherwise(F.array().cast(SPANS))


def _cut_out(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits pass the check: from the right, every second one doubled."""
    each = F.transform(F.split(F.reverse(number), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), x.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(digits(found), lambda n: F.when(F.length(n).between(16, 19), luhn(n)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(found)).between(8, 15)
    return F.lit(True)


def _checked(kind: str, text: Column):
    return lambda s: _holds(kind, _cut_out(text, s))


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def base(text: Column) -> dict[str, Column]:
    """Spans by kind."""
    out = {}
    for kind, (pattern, needs) in KINDS.items():
        every = F.when(F.contains(text, F.lit(needs)), spans(text, pattern)).otherwise(F.array().cast(SPANS)) if needs else spans(text, pattern)
        out[kind] = every if kind == "email" else F.filter(every, _checked(kind, text))
    return out


def listed(kind: Column, s: Column) -> Column:
    return F.transform(s, lambda x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string")))


def _blanked(text: Column, s: Column) -> Column:
    """The text with spaces in place of spans that do not overlap; places stay."""

    def pieces(x: Column, i: Column) -> Column:
        since = F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(0)
        return F.concat(F.substring(text, since + 1, x["start"] - since), F.repeat(F.lit(" "), x["end"] - x["start"]))

    rest = F.substring(text, F.element_at(s, -1)["end"] + 1, F.length(text))
    return F.when(F.size(s) > 0, F.concat(F.array_join(F.transform(s, pieces), ""), rest)).otherwise(text)


def _value(text: Column):
    """A hash of what an entity is, however it is written."""

    def of(e: Column) -> Column:
        found = _cut_out(text, e)
        return F.xxhash64(e["kind"], F.when(e["kind"] == "email", F.lower(found)).when(e["kind"] == "ip", found).otherwise(digits(found)))

    return of


def entities(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """rid, a number of the row; ``row``, the columns to keep; a column of spans for each kind; values, hashes of the entities; m, the text with spaces in place of them."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), t.alias("t"))
    found = rows.select("rid", "row", "t", *(s.alias(k) for k, s in base(F.col("t")).items()))
    each = F.concat(*(F.transform(k, _named(k)) for k in KINDS))
    found = found.withColumn("values", F.array_distinct(F.transform(each, _value(F.col("t"))))).withColumnRenamed("t", "m")
    for k in KINDS:  # spans of one kind do not overlap, those of several may
        found = found.withColumn("m", _blanked(F.col("m"), F.col(k)))
    return found


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _class(term: Column) -> Column:
    """What a term is generalised to."""
    number = F.when(F.length(term) > 1, F.concat(F.substring(term, 1, 1), F.repeat(F.lit("#"), F.length(term) - 1))).otherwise("#")
    return F.when(term.rlike(r"^\p{N}+$"), number).when(term.rlike(r"\p{N}"), "[CODE]").when(term.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def _held(found: DataFrame, form=F.lower) -> DataFrame:
    """rid and h: the terms of each text, or their classes, by hash."""
    return found.select("rid", F.explode(F.array_distinct(F.transform(F.array_distinct(_words(F.col("m"))), lambda x: F.xxhash64(form(x))))).alias("h"))


def evidence(both: Column, entity: Column, term: Column, total: int) -> Column:
    """Bits by which both of the entity's documents with the term are too many for chance (Chernoff's bound)."""
    other = entity - both
    rest = F.when(other > 0, other * F.log2(other * float(total) / (entity * F.greatest(F.lit(total) - term, F.lit(1))))).otherwise(0.0)
    return both * F.log2(both * float(total) / (entity * term)) + rest


def discloses(both: Column, entity: Column, term: Column, total: int, tested: int, threshold: float, chance: float) -> Column:
    information = F.log2(F.lit(float(total)) / entity)
    shared = F.log2(both * float(total) / (entity * term))
    return (information > 0) & (shared >= threshold * information) & (evidence(both, entity, term, total) >= math.log2(tested / chance))


def disclosing(found: DataFrame, threshold: float, chance: float, form=F.lower) -> DataFrame | None:
    """h, the hashes of terms (or classes of them) that disclose an entity; None if there are none."""
    named = found.filter(F.size("values") > 0).select("rid", F.explode("values").alias("entity"))
    alone = cut(named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")))
    most = alone.agg(F.max("n_entity")).first()[0]
    if most is None:
        return None
    total = found.count()
    # over all documents; terms by hash, so that counting them is sums of numbers
    used = cut(_held(found, form).groupBy("h").agg(F.count(F.lit(1)).alias("n_term")))
    tested = used.count()
    # a term more frequent than any entity's information allows, or too rare for chance at its best, is in no pair
    n = F.col("n_term")
    able = (n <= 1.001 * most**threshold * float(total) ** (1 - threshold)) & (n * F.log2(float(total) / n) >= math.log2(tested / chance) - 0.001)
    rare = cut(used.filter(able))
    terms = sent(_held(found.filter(F.size("values") > 0), form), rare, ["h"], "inner")
    best = F.least("n_entity", "n_term")
    both = terms.join(named.join(alone, "entity"), "rid").filter(discloses(best, F.col("n_entity"), F.col("n_term"), total, tested, threshold, chance))
    pairs = both.groupBy("entity", "n_entity", "h", "n_term").agg(F.count(F.lit(1)).alias("n_both"))
    out = cut(pairs.filter(discloses(F.col("n_both"), F.col("n_entity"), F.col("n_term"), total, tested, threshold, chance)).select("h").distinct())
    return None if out.isEmpty() else out


def _hits(found: DataFrame, telling: DataFrame | None, form, name: str) -> DataFrame:
    """rid and the hashes of a text's telling terms or classes, for texts that have any."""
    if telling is None:
        return found.select("rid", F.array().cast("array<bigint>").alias(name)).limit(0)
    return cut(sent(_held(found, form), telling, ["h"], "left_semi").groupBy("rid").agg(F.collect_list("h").alias(name)))


def find(df: DataFrame, keep: list[str] | None = None, text_col: str = "text", threshold: float = 0.9, chance: float = 0.05) -> DataFrame:
    """Spans of email, ip, card, phone and term, ``general``, what each term is replaced by, and ``sanitised``, the text
    without all of them, beside ``row``, the input's columns (all, or those to keep)."""
    found = cut(entities(df, keep or df.columns, text_col))
    telling = disclosing(found, threshold, chance)
    none = F.array().cast("array<string>")
    if telling is None:
        return found.select("row", *KINDS, F.array().cast(SPANS).alias("term"), none.alias("general"), sanitise(F.col("m"), list(KINDS)).alias("sanitised"))
    hits = _hits(found, telling, F.lower, "hs")
    # a class that discloses is looked for only in texts that have a telling term
    wide = _hits(found.join(hits, "rid", "left_semi"), disclosing(found, threshold, chance, _class), _class, "cs")
    marked = found.join(hits.join(wide, "rid", "left"), "rid", "left")
    m = F.col("m")
    instead = lambda c: F.when(F.coalesce(F.array_contains("cs", F.xxhash64(c)), F.lit(False)), "[TERM]").otherwise(c)
    each = F.zip_with(spans(m, TERM), _words(m), lambda s, x: F.when(F.array_contains("hs", F.xxhash64(F.lower(x))), F.struct(s.alias("s"), instead(_class(x)).alias("c"))))
    told = F.when(F.col("hs").isNotNull(), F.filter(each, lambda e: e.isNotNull()))
    out = marked.select("row", *KINDS, "m", told.alias("told_"))
    out = out.select("row", *KINDS, "m", F.coalesce("told_.s", F.array().cast(SPANS)).alias("term"), F.coalesce("told_.c", none).alias("general"))
    return out.select("row", *KINDS, "term", "general", sanitise(m, [*KINDS, "term"], F.col("general")).alias("sanitised"))


def all_spans(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, joined by commas."""
    return F.array_join(F.flatten(F.array(*(listed(F.lit(k), F.col(k)) for k in kinds))), ",")


def sanitise(text: Column, kinds: list[str], general: Column | None = None) -> Column:
    """The text with each span replaced by its kind in brackets, a term by what ``general`` has for it if that is given.

    Spans that overlap go together, for what the first, then the longest, is replaced by.
    """

    def named(kind: str):
        entry = lambda s, mark: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), mark.alias("mark"))
        if kind == "term" and general is not None:
            return F.zip_with(kind, general, entry)
        return F.transform(kind, lambda s: entry(s, F.lit(f"[{kind.upper()}]")))

    def heads(every: Column, ends: Column, before: Column) -> Column:
        """The first spans of those that overlap, and how far all before them reach; the greatest ends are known by blocks."""

        def reach(x: Column, i: Column) -> Column:
            block = (i / STEP).cast("int")
            last = F.coalesce(F.array_max(F.slice(ends, block * STEP + 1, i - block * STEP)), F.lit(0))
            return F.struct(x["start"].alias("start"), x["mark"].alias("mark"), F.greatest(F.get(before, block), last).alias("since"))

        return F.filter(F.transform(every, reach), lambda x: x["start"] >= x["since"])

    def joined(every: Column, ends: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(ends), F.lit(STEP)), lambda k: F.array_max(F.slice(ends, k, STEP)))
        upto = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x))))
        parts = let(upto, lambda before: F.transform(heads(every, ends, before), lambda x: F.concat(F.substring(text, x["since"] + 1, x["start"] - x["since"]), x["mark"])))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    each = F.array_sort(F.flatten(F.array(*(named(k) for k in kinds))))
    some = sum((F.size(k) for k in kinds), F.lit(0)) > 0
    return F.when(some, let(each, lambda every: let(F.transform(every, lambda x: -x["end"]), lambda ends: joined(every, ends)))).otherwise(text)
