"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, lines, neardup, pii, quality, substring, tokenfile, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(ids, path))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids with crc32 mod 4 = 2 are held out; a null id is not."""
    documents, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.fit(documents, labels, ~held_out)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "weight")


PII_KINDS = ["email", "ip", "card", "phone", "term"]


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "row.doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in PII_KINDS[:-1]),
        F.sha2(pii.all_spans(PII_KINDS[:-1]), 256).alias("base_sha256"),
        pii.all_spans(PII_KINDS).alias("spans"),
        F.sha2("sanitised", 256).alias("sanitised_sha256"),
    )


#: Stands for a null conv_id while the log is folded.
NO_ID = -(1 << 63)
#: A conversation whose texts read like a template's marks.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def chat_log(rows: DataFrame) -> DataFrame:
    """The log that rows (conv_id, turn, role, text) may come from, in no order.

    Each row is a message: streamed in two parts; or drafted and then edited; or
    drafted, dropped by a regeneration and told anew. Rows that share a turn are
    messages of their own, in the order of role and text hash, and so are equal
    rows; rows without a turn come last.
    """
    rows = rows.select(F.coalesce("conv_id", F.lit(NO_ID)).alias("conv_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    copies = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    text, n = F.col("text"), F.length("text")
    msg = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), "copy")
    head, tail, draft = F.substring(text, 1, F.floor(n / 2).cast("int")), F.substring(text, F.floor(n / 2).cast("int") + 1, n), F.concat(F.reverse(text), F.lit("..."))
    step = lambda k, kind, t: F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), t.alias("text"))
    none = F.lit(None).cast("string")
    logs = [
        [("message", head), ("delta", tail)],
        [("message", draft), ("delta", head), ("edit", head), ("delta", tail)],
        [("delta", draft), ("edit", tail), ("regenerate", none), ("delta", head), ("delta", tail)],
    ]
    which = F.pmod(F.xxhash64("text", "turn"), F.lit(len(logs)))
    steps = F.array().cast("array<struct<step:int,kind:string,text:string>>")
    for k, log in enumerate(logs):
        steps = F.when(which == k, F.array(*(step(i, *x) for i, x in enumerate(log)))).otherwise(steps)
    events = copies.select("conv_id", msg.alias("msg"), "role", F.explode(steps).alias("s"))
    return events.select("conv_id", F.struct("msg", F.col("s.step").alias("step")).alias("seq"), "s.kind", "msg", "role", "s.text")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows as a log of streams, edits and regenerations, folded, rendered and read back."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string"))
    chunk = F.struct(F.col("msg.late"), F.floor(F.col("msg.turn") / chat.CHUNK).alias("part"))
    back = chat.read_back(chat.render(chat.fold(chat_log(rows), chunk)))
    return back.withColumn("conv_id", F.nullif("conv_id", F.lit(NO_ID)))


def op8_line_dedup(spark: SparkSession, sf_dir: str, min_chars: int = 24) -> DataFrame:
    kept = lines.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=min_chars, counts=True)
    return kept.select("doc_id", "n_lines", "n_equal", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_line_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal lines of any length go, but for empty ones."""
    return op8_line_dedup(spark, sf_dir, min_chars=1)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = neardup.link(_read(spark, sf_dir, "documents"))
    return linked.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    items = decontaminate.item_ids()
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM bk),
dk AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, dk.n, p, item_id FROM (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s FROM dk) dk JOIN win ON dk.n = win.n AND dk.s = win.s),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM k) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM late)),
word AS (SELECT doc_id, q, w[q] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM d)),
kept AS (SELECT word.doc_id, count(gone.q) AS n, coalesce(string_agg(x, ' ' ORDER BY word.q) FILTER (WHERE gone.q IS NULL), '') AS s FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.q = gone.q GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

# Backslashes are put into control strings as the template says; the rest is counting.
OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z_]+\||/?s>|/?INST\]|/?<?/?SYS>)', '\1\\\2\3', 'g') AS e FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length('<|im_start|>') + length(role) + 1 + length(e) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

OP8_SQL = r"""
WITH l AS (SELECT doc_id, i AS no, trim(s[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS x, s[i] AS raw FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
o AS (SELECT * FROM l WHERE length(x) >= 24),
first AS (SELECT x, min(doc_id) AS doc, min({'d': doc_id, 'n': no}) AS at FROM o GROUP BY x),
near AS (SELECT DISTINCT a.x FROM first a JOIN first b ON length(b.x) BETWEEN length(a.x) - 1 AND length(a.x) + 1 AND b.at < a.at
WHERE length(a.x) >= 48 AND length(b.x) >= 48 AND (left(a.x, length(a.x) // 2) = left(b.x, length(a.x) // 2) OR right(a.x, length(a.x) // 2) = right(b.x, length(a.x) // 2)) AND levenshtein(a.x, b.x) <= 1),
m AS (SELECT o.doc_id, o.no, (o.doc_id > first.doc OR o.no > min(o.no) OVER (PARTITION BY o.doc_id, o.x)) AS equal, near.x IS NOT NULL AS near FROM o JOIN first ON o.x = first.x LEFT JOIN near ON o.x = near.x),
k AS (SELECT l.doc_id, l.no, l.raw, coalesce(equal, false) AS equal, coalesce(near, false) AS near FROM l LEFT JOIN m ON l.doc_id = m.doc_id AND l.no = m.no)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE equal) AS n_equal, count(*) FILTER (WHERE near AND NOT equal) AS n_near,
sha256(coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE NOT equal AND NOT near), '')) AS kept_sha256 FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""

OP8_ALL_SQL = OP8_SQL.replace("length(x) >= 24", "length(x) >= 1")

OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT i, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT i, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT i, count(*) AS n FROM s GROUP BY i),
p AS (SELECT a.i AS a, b.i AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.i <> b.i GROUP BY ALL),
e AS (SELECT DISTINCT f.doc_id AS a, g.doc_id AS b FROM p JOIN n x ON a = x.i JOIN n y ON b = y.i JOIN d f ON a = f.i JOIN d g ON b = g.i WHERE 100 * common >= 75 * (x.n + y.n - common) AND f.doc_id IS NOT NULL AND g.doc_id IS NOT NULL),
r AS (SELECT DISTINCT doc_id AS node, doc_id AS least FROM d WHERE doc_id IS NOT NULL UNION SELECT e.b, r.least FROM r JOIN e ON r.node = e.a WHERE r.least < e.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.least AS component_id, coalesce(d.doc_id = c.least, true) AS kept
FROM d LEFT JOIN n ON d.i = n.i LEFT JOIN (SELECT node, min(least) AS least FROM r GROUP BY node) c ON d.doc_id = c.node
"""

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_pii": op5_pii,
    "op6_chat": op6_chat,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op8_line_dedup_all": op8_line_dedup_all,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_token_file": op10_token_file,
}
ORACLES = {
    "op4_decontaminate": OP4_SQL,
    "op6_chat": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op8_line_dedup_all": OP8_ALL_SQL,
    "op9_near_duplicates": OP9_SQL,
}
