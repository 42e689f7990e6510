"""Chat formatting from an event log.

An event belongs to a conversation, has a place in its order (``seq``), a kind
and the message it is about (``msg``, a number):

* ``message``: the message begins anew with this role and text;
* ``delta``: text streamed to the message's end;
* ``edit``: the message's text is replaced;
* ``regenerate``: the message and all later ones are dropped, to be told anew;
* ``delete``: the message is dropped.

An event but for the last two makes its message where there is none, with its own
role. Each message is folded on its own, by conversation and message, so a
conversation of any length is spread over tasks. What a regeneration drops is
known from a running maximum: within chunks of a conversation, and over the
chunks' maxima. ``seq`` and ``msg`` are of any type that has an order; ``chunk`` is
one that ascends with the message. A message is rendered as

    <|im_start|>role\\ntext<|im_end|>\\n

where a backslash is put into whatever in a text or role reads like a control
string, also when backslashes stand there already, so that taking one backslash
out of each restores the text; a line end in a role is written as \\\\n. The loss
mask of a rendered message is the span of its text if the role is the trained
one. A formatted conversation is its rendered messages in order; they are kept
as rows, so no conversation has to fit into one cell.

Null texts and roles are empty; a null kind is a message; events without a
conversation or message are left out; of events with the same place the kind,
then the text decides. Conversations whose messages are all dropped have no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Strings that chat templates use as marks.
CONTROL = r"([<\[])(\\*)(\|[A-Za-z_]+\||/?s>|/?INST\]|/?<?/?SYS>)"
BEGIN, END, HEAD = "<|im_start|>", "<|im_end|>", "\n"


def escape(text: Column) -> Column:
    """One backslash more inside whatever reads like a control string."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


_ESCAPED = re.compile(r"([<\[])\\(\\*)(\|[A-Za-z_]+\||/?s>|/?INST\]|/?<?/?SYS>)")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


#: Messages of one chunk, where messages are numbers.
CHUNK = 4096


def fold(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """conv_id, msg, role and text of the final messages of events (conv_id, seq, kind, msg, role, text)."""
    chunk = F.floor(F.col("msg") / CHUNK) if chunk is None else chunk
    e = events.filter("conv_id IS NOT NULL AND msg IS NOT NULL").select("conv_id", chunk.alias("chunk"), "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    again = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again")
    here = e.groupBy("conv_id", "chunk", "msg").agg(again, F.max(F.when(F.col("kind") == "delete", F.col("seq"))).alias("gone"))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("msg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each chunk that regenerates
    chunks = here.groupBy("conv_id", "chunk").agg(F.max("again").alias("most"))
    chunks = chunks.withColumn("earlier", F.max("most").over(before)).filter("earlier IS NOT NULL").select("conv_id", "chunk", "earlier")
    cuts = here.withColumn("upto", F.max("again").over(upto)).join(chunks, ["conv_id", "chunk"], "left")
    cuts = cuts.select("conv_id", "msg", F.greatest("upto", "earlier", "gone").alias("cut")).filter("cut IS NOT NULL")
    alive = e.filter("kind IN ('message', 'delta', 'edit')").drop("chunk").join(cuts, ["conv_id", "msg"], "left").filter("cut IS NULL OR seq > cut").drop("cut")
    last = F.max(F.when(F.col("kind") != "delta", F.struct("seq", "kind", "text"))).alias("base")
    told = F.max(F.when(F.col("kind") == "message", F.struct("seq", "kind", "text", "role"))).alias("told")
    first = F.min(F.struct("seq", "kind", "text", "role")).alias("first")
    kept = alive.groupBy("conv_id", "msg").agg(last, told, first, F.max(F.when(F.col("kind") == "delta", F.col("seq"))).alias("streamed"))
    kept = kept.select("conv_id", "msg", "base", "streamed", F.coalesce("told.role", "first.role").alias("role"))
    streams = kept.filter("streamed IS NOT NULL AND (base IS NULL OR streamed > base.seq)").select("conv_id", "msg", F.col("base.seq").alias("since"))
    deltas = alive.filter("kind = 'delta'").join(streams, ["conv_id", "msg"]).filter("since IS NULL OR seq > since")
    tails = deltas.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("d"))
    tails = tails.select("conv_id", "msg", F.array_join(F.transform("d", lambda x: x["text"]), "").alias("tail"))
    return kept.join(tails, ["conv_id", "msg"], "left").select("conv_id", "msg", "role", F.concat(F.coalesce("base.text", F.lit("")), F.coalesce("tail", F.lit(""))).alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """Adds ``formatted``, the rendered message, and loss_start and loss_end, the span of it under the loss mask (null if there is none)."""
    role = F.replace(escape(F.replace("role", F.lit("\\"), F.lit("\\\\"))), F.lit("\n"), F.lit("\\n"))
    text = escape(F.col("text"))
    head = F.concat(F.lit(BEGIN), role, F.lit(HEAD))
    learn = F.col("role") == trained
    start = F.length(head)
    return messages.select(
        "conv_id",
        "msg",
        F.concat(head, text, F.lit(END + "\n")).alias("formatted"),
        F.when(learn, start).alias("loss_start"),
        F.when(learn, start + F.length(text)).alias("loss_end"),
    )


_ROLE = re.compile(r"\\(.)", re.S)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    head, _, body = formatted[len(BEGIN) : -len(END) - 1].partition(HEAD)
    head = unescape(head.replace("\\n", "\n") if "\\\\" not in head else _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[0], head))
    return head.replace("\\\\", "\\"), unescape(body)


def _read(kind: pa.DataType):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, state, begun = None, None, False

        def row():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), *(pa.array([r[k] for r in rows], pa.string() if k in (2, 4) else pa.int64()) for k in range(1, 6))], names)

        for b in batches:
            done = []
            for conv, text, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if not begun or conv != now:
                    if begun:
                        done.append(row())
                    now, begun, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse(text)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                if lo is not None:
                    learnt = unescape(text[lo:hi])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            if done:
                yield made(done)
        if begun:
            yield made([row()])

    return run


def read_back(rendered: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read from the rendered messages; a conversation passes as a stream, never as a whole."""
    field = rendered.schema["conv_id"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[field]
    rows = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "msg")
    return rows.mapInArrow(_read(kind), f"conv_id {field}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
