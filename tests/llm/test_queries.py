"""The registered queries, with production parameters, over the smallest tables: against SQL, or against brute force."""

import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tallyloom.llm import bpe, queries, tokenfile

from .conftest import words
from .test_operators import LOW, RANKS, WORDS, P, edits, personal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def table(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want))


def test_bpe(spark, table):
    enc = bpe.encoder(RANKS, P.PATTERN)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_byte_bpe(spark, SF).collect()}
    assert got == {i: (len(x := enc.encode_ordinary(t)), sha(" ".join(map(str, x))), sha(t)) for i, t in table.items()}


def test_quality(spark, table):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols) for r in queries.op2_quality(spark, SF).collect()}
    assert got == {i: (len(w := words(t)), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t)) for i, t in table.items()}


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF.replace('0.001', '0.1')}/labels.parquet").collect()}
    got = [r for r in queries.op3_toxicity(spark, SF.replace("0.001", "0.1")).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    hit = sum(y and p for y, p in held)
    assert hit / sum(y for y, _ in held) > 0.9 and hit / sum(p for _, p in held) > 0.9


def test_personal_data(spark, table):
    for r in queries.op5_pii(spark, SF).collect():
        found = personal(table[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, found.values()))
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, v in found.items() for a, b in v))


def test_token_files(spark, table):
    tok = tokenfile.tokenizer(WORDS).library
    got = sorted(map(tuple, queries.op10_token_file(spark, SF).collect()))
    start = 0
    for (i, t), r in zip(sorted(table.items()), got, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert r == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pipeline(spark, table):
    """Stage by stage by brute force, from the documents that the quality rules keep."""
    docs = {r.doc_id: table[r.doc_id] for r in queries.op2_quality(spark, SF).collect() if r.kept}
    # lines
    cells = [(i, k, x.strip(" \t\r\x0b\x0c")) for i, t in docs.items() for k, x in enumerate(t.split("\n"))]
    cells = [c for c in cells if len(c[2]) >= 24]
    first = {}
    for i, k, x in cells:
        first[x] = min(first.get(x, (i, k)), (i, k))
    long = sorted((x for x in first if len(x) >= 48), key=len)
    near = {a for a in long for b in long if a != b and abs(len(a) - len(b)) <= 1 and first[b] < first[a] and (a[:20] == b[:20] or a[-20:] == b[-20:]) and edits(a, b) <= 1}
    drop = {}
    for i, k, x in cells:
        if first[x] != (i, k) or x in near:
            drop.setdefault(i, set()).add(k)
    for i, gone in drop.items():
        left = [x for k, x in enumerate(docs[i].split("\n")) if k not in gone]
        docs[i] = "\n".join(left) if any(len(x.strip(" \t\r\x0b\x0c")) >= 24 for x in left) else None
    docs = {i: t for i, t in docs.items() if t is not None}
    # near duplicates
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := [x.translate(LOW) for x in words(t)]) else set() for i, t in docs.items()}
    group = {i: i for i in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = {i: lo if g == hi else g for i, g in group.items()}
    docs = {i: t for i, t in docs.items() if group[i] == i}
    # benchmark
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = pattern.findall((r.text or "").translate(LOW))
        if w:
            windows.setdefault(min(10, len(w)), set()).update(grams(w, min(10, len(w))))
    docs = {i: t for i, t in docs.items() if not any(grams(pattern.findall(t.translate(LOW)), n) & s for n, s in windows.items())}
    enc = bpe.encoder(RANKS, P.PATTERN)
    want = {i: (len(x := enc.encode_ordinary(t)), sha(" ".join(map(str, x))), sha(t)) for i, t in docs.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert 0 < len(want) < len(table)


def test_turns_that_repeat_or_are_missing_stay(spark, tmp_path):
    import duckdb

    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "assistant", "ho"), (1, None, "assistant", "late"), (1, 1, "user", "x"), (None, 0, "user", "nobody's"), (None, 0, "assistant", None), (2, 0, None, "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cols = "conv_id, n_turns, loss_chars, formatted_chars"
    want = con.sql(f"SELECT {cols} FROM ({queries.OP6_SQL})").fetchall()
    got = {r.conv_id: r for r in queries.op6_chat(spark, str(tmp_path)).collect()}
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols.split(", "))) for r in got.values())
    assert got[1].turns_sha256 == sha("assistant\nho\nuser\nhi\nuser\nhi\nuser\nx\nassistant\nlate\n")
