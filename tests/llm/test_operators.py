"""Each operator against a brute-force version on small, awkward tables."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import bpe, chat, components, decontaminate, lines, neardup, pii, quality, substring, tokenfile, toxicity
from tallyloom.llm import _words

from .conftest import words

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
LOW = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def bag(rows):
    return Counter(map(str, rows))


# 1


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 16), (700, 64), (32768, 1024)])
def test_bpe_is_the_librarys_and_decodes_to_the_text(docs, plain, chunk, overlap):
    enc = bpe.encoder(RANKS, P.PATTERN)
    got = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN, chunk_chars=chunk, overlap=overlap), RANKS).collect()
    assert bag((r.doc_id, list(r.ids), bytes(r.data)) for r in got) == bag((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in plain)


def test_bpe_of_repeated_rows_and_nothing(spark, none):
    rows = spark.createDataFrame([(1, "ab " * 50), (1, "ab " * 50), (1, "cd"), (1, "cd")], "doc_id long, text string")
    assert Counter(len(r.ids) for r in bpe.encode(rows, RANKS, P.PATTERN, chunk_chars=20, overlap=8).collect()) == Counter(2 * [len(bpe.encoder(RANKS, P.PATTERN).encode_ordinary("ab " * 50))] + 2 * [1])
    assert bpe.digests(bpe.decode(bpe.encode(none, RANKS, P.PATTERN), RANKS)).collect() == []


def pieces(text, chunk, overlap):
    """What the stages of the operator make of one text, without a table between them."""
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "tk": pa.array([2], pa.int64()), "copies": pa.array([1], pa.int64()), "text": [text]})
    cut = pa.Table.from_batches(bpe._edges(P.PATTERN, chunk, overlap)(bpe._chunks(chunk, overlap)([rows]))).to_pandas()
    return bpe._stitch(chunk)(cut)["text"].tolist()


def test_bpe_where_chunks_end_in_white_space():
    import random

    enc = bpe.encoder(RANKS, P.PATTERN)
    rng = random.Random(11)
    parts = ["\n\n", " ", "  ", "\t", "\n", "\r\n", " \n ", "\u00a0", "\u3000", "ab", "word", "'s", "12", "!?", "é", "😀", "don't"]

    def same(text, chunk, overlap):
        cut = pieces(text, chunk, overlap)
        assert "".join(cut) == text
        assert [x for p in cut for x in enc.encode_ordinary(p)] == enc.encode_ordinary(text), (text, chunk)

    for _ in range(1500):
        same("".join(rng.choice(parts) for _ in range(rng.randint(1, 90))), rng.randint(20, 60), 16)
    for gap in ("\n\n", "\n\n\n ", " \n\t ", "\r\n\r\n", " " * 40, "  x", "\x1c\x1d a", "\x85\x85b"):  # every place of the gap about a cut, at the sizes of production
        for at in range(32768 - 12, 32768 + 12):
            same("a" * 5 + " word" * ((at - 5) // 5) + "x" * ((at - 5) % 5) + gap + "more words follow here " * 200, 32768, 1024)
        for at in range(32768 + 1024 - 12, 32768 + 1024 + 4):
            same("a" * 5 + " word" * ((at - 5) // 5) + "x" * ((at - 5) % 5) + gap + "more words follow here " * 200, 32768, 1024)


def test_stitching_where_nothing_resynchronises():
    assert bpe.cut_points([0, 3, 9], [4, 9]) == 9
    assert bpe.cut_points([0], [0]) is None
    assert bpe.boundaries("ab cd", P.PATTERN, True) == [0, 2]


# 2


def test_quality_counts(docs, plain):
    got = quality.judge(docs, keep=["doc_id", "text"]).collect()
    want = []
    for i, t in plain:
        t = t or ""
        w, at = words(t), {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
        full = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(covered), failed))
    assert bag((r.row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == bag(want)
    assert not any(r.kept and r.base_failed for r in got)


def test_windows_whose_bits_clash_are_sorted_as_text(spark, docs, plain, monkeypatch):
    """With few hash bits, or places for few words only, the counts stay the same."""
    want = bag((r.row.doc_id, r.n_repeat_words) for r in quality.judge(docs, keep=["doc_id"]).collect())
    for place in (2, 60):
        monkeypatch.setattr(quality, "PLACE", place)
        assert bag((r.row.doc_id, r.n_repeat_words) for r in quality.judge(docs, keep=["doc_id"]).collect()) == want


def verdicts(rows):
    """kept of each (lang, text), by brute force with numpy."""
    import math

    seen, spelled = [], [quality._spelled(x) for x in quality.CLASSES.values()]
    for lang, t in rows:
        t, w, n_of = t or "", words(t), Counter(t or "")
        at = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if at[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kinds = [sum(n_of[c] for c in x) for x in ("abcdefghijklmnopqrstuvwxyz", " \t\n\v\f\r", *spelled)]
        common = quality.COMMON_WORDS.get(lang)
        parts = [(kinds, len(t)), ([w.count(x) for x in common] if common else None, len(w))]
        shares = [None if c is None else [x / max(n, 1) for x in [*c, max(0, n - sum(c))]] for c, n in parts]
        seen.append((lang or "", failed, len(t) >= 200, shares))
    medians = {}
    for lang in {x[0] for x in seen}:
        fair = [x[3] for x in seen if x[0] == lang and not x[1] and x[2]]
        for k in (0, 1):
            table = [[round(v, 4) for v in x[k]] for x in fair if x[k]]
            middle = [float(np.median(c)) for c in zip(*table)] if table else None
            medians[lang, k] = middle and [v / max(1e-9, sum(middle)) for v in middle]

    def distance(p, q):
        if p is None or q is None:
            return 0.0
        half = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
        return math.sqrt(max(0.0, sum(half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in zip(p, q)) / 2))

    out = []
    for lang, failed, long, shares in seen:
        a, b = (distance(shares[k], medians[lang, k]) for k in (0, 1))
        out.append((failed, not failed and not (long and (a > 0.35 or a > 0.18 and b > 0.25)), min(abs(a - 0.35), abs(a - 0.18), abs(b - 0.25))))
    return out


def test_quality_verdicts(spark):
    rows = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.row.doc_id: (r.base_failed, r.kept) for r in quality.judge(df.repartition(7), keep=["doc_id"]).collect()}
    want = {i: v for (i, _, _), v in zip(rows, verdicts([x[1:] for x in rows]))}
    # distances within 1e-9 of a bound may fall on either side
    assert all(got[i] == v[:2] for i, v in want.items() if v[2] > 1e-9) and len(got) == len(want)
    assert sum(not f and not k for f, k in got.values()) > 5
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    own = [labels[i] for i, (f, k) in got.items() if not f and not k and i in labels]
    assert own.count(0) > 10 * own.count(1)


def test_quality_distance_rejects_odd_characters(spark, none):
    good = [(k, " ".join(f"the w{(k * 7 + j * j) % 97}x of" for j in range(60)), "en") for k in range(20)]
    odd = [(100, " ".join(f"the| w{j * j % 89}x| of|" for j in range(60)), "en"), (101, " ".join(f"THE W{j * j % 89}X!! OF!!" for j in range(60)), "en")]
    df = spark.createDataFrame(good + odd, "doc_id long, text string, lang string")
    kept = {r.row.doc_id: r.kept for r in quality.judge(df).collect()}
    assert not kept[101] and all(kept[k] for k in range(20))
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    got = spark.range(1).select(quality.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    js = sum(a * np.log2(a / c) / 2 for a, c in zip(p, m) if a) + sum(b * np.log2(b / c) / 2 for b, c in zip(q, m) if b)
    assert abs(got - js**0.5) < 1e-12
    assert quality.judge(none).collect() == [] and quality.judge(df.drop("lang")).count() == 22


# 3


def test_folding():
    assert toxicity.fold("1d10t TRA$H!! the$$$ 1234 ｉｄｉｏｔ id​iot рathetic") == " idiot trash the 1234 idiot idiot pathetic "
    assert toxicity.fold("") == "  "


def test_toxicity_learns_words_and_exceptions(spark, none):
    # a neutral word list with one marked word: the operator is told by labels alone
    mild = [(k, f"some plain words about thing{k} and other matters here", 0) for k in range(60)]
    mild += [(100 + k, "we saw the zork fish swim in the sea", 0) for k in range(6)]
    bad = [(200 + k, f"you zork and z0rk you ZORK thing{k}", 1) for k in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in mild + bad] + [(900, None), (901, ""), (902, "zоrk zork zork"), (903, "fine words")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in mild + bad] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert any("zork" in t for t in model.weights) and any("zork" in p for p in model.exceptions)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[902] > 0.5 and all(got[200 + k] > 0.5 for k in range(30))
    assert max(got[900], got[901], got[903], got[100], got[0]) < 0.3
    assert all(0 <= s <= 1 for s in got.values())
    empty = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}
    assert toxicity.score(none, model).collect() == []


def folded(text):
    """The fold, character by character."""
    text = unicodedata.normalize("NFC", text.lower())
    text = "".join(toxicity.LOOK_ALIKES.get(c, chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) < 0xFF5F else c) for c in text if c not in "\u00ad\u200b\u200c\u200d\u2060\ufeff")
    inside = [c.isalnum() or c in "@$!" and 0 < k < len(text) - 1 and text[k - 1].isalnum() and text[k + 1].isalnum() for k, c in enumerate(text)]
    out, k = "", 0
    while k < len(text):
        if not inside[k]:
            out, k = out + " ", k + 1
            continue
        end = k
        while end < len(text) and inside[end]:
            end += 1
        run = text[k:end]
        if any(c.isalpha() for c in run):
            run = "".join(toxicity.STAND_INS.get(c, c) for c in run)
        out, k = out + "".join(c if c.isalnum() else " " for c in run), end
    return f" {' '.join(out.split())} "


def test_scores_against_a_plain_reading(spark):
    import random

    rng = random.Random(5)
    parts = ["zork", "z0rk", "ZORK", "zоrk", "fish", "f1sh", "the", "sea", "idi", "ot", "1d10t", "12", "3", "@", "$", "!", "_", "-", " ", " ", " ", "\u200b", "é", "e\u0301", "ｉ", "\n", "a@b", "zor"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)] + [None, "", "   ", "zork " * 20_000 + "the zork fish"]
    model = toxicity.Model({" zork ": 2.5, " zor": 0.25, " idiot ": 1.75, " fi": 0.5, " sea ": 1.0}, [" the zork fish ", " zork zork ", " fish sea the "], (-2.0, 1.5, 0.75))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("weight", F.lit(1))
    for r in toxicity.score(df, model).collect():
        f = folded(texts[r.doc_id] or "")
        spared = {k for p in model.exceptions for m in re.finditer(f"(?={re.escape(p)})", f) for k in range(m.start(), m.start() + len(p))}
        weight = sum(w for p, w in model.weights.items() for m in re.finditer(f"(?={re.escape(p)})", f) if m.start() not in spared)
        n = len(f.split())
        z = -2.0 + 1.5 * math.log(1 + weight) + 0.75 * math.log(1 + 100 * weight / max(n, 20))
        assert (r.n_words, round(r.weight, 9), round(r.score, 9)) == (n, round(weight, 9), round(1 / (1 + math.exp(-z)), 9)), texts[r.doc_id]


# 4


def test_benchmark_windows(spark, docs, plain):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    long = [t for _, t in plain if t and len(pattern.findall(t)) > 30]
    items = [(1, " ".join(words(long[0])[3:25])), (2, long[1].upper()), (10, "w1 w2"), (3, "le"), (4, "zz yy"), (5, ""), (6, None), (2, long[2]), (7, long[1]), (None, long[1][:90])]
    bench = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    windows = {}
    for i, t in items:
        w = pattern.findall((t or "").translate(LOW))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    want = []
    for i, t in plain:
        w, hit, ids = pattern.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), sorted(ids)))
    for block_words in (500_000, 20):
        found = decontaminate.contamination(docs, bench, block_words=block_words)
        got = found.select("doc_id", "n_words", decontaminate.n_hit().alias("n"), decontaminate.item_ids().alias("i")).collect()
        assert bag((r.doc_id, r.n_words, r.n, list(r.i)) for r in got) == bag(want)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not h for _, _, h, _ in want)
    assert decontaminate.contamination(docs, bench.limit(0)).filter("size(hits) > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []


def test_decontamination_of_awkward_columns(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x A b-c d e f g h i j", "r"), (None, "x " * 300_000 + "a b c d e f g h i j", "r"), (2, None, "r"), (2, "clean", "r")], "doc_id long, text string, row string")
    for name in ("row_", "row__", "row___", "hits", "matches", "n_words"):
        docs = docs.withColumn(name, F.lit(7))
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    assert sorted(str(r.text) for r in decontaminate.decontaminate(docs, bench).collect()) == ["None", "clean"]


def test_longest_matches(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l y a b c d e f g h i j")], "doc_id long, text string")
    got = decontaminate.contamination(docs, bench).first().matches
    assert sorted((m.doc_start, m.item_start, m.length) for m in got) == [(1, 0, 12), (14, 0, 10)]


# 5

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    out = {}
    for kind, pattern in PII.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            sums = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
            good = {"email": True, "ip": kind != "ip" or max(map(int, m[0].split("."))) <= 255, "card": 16 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in sums) % 10 == 0, "phone": 8 <= len(d) <= 15}
            if good[kind]:
                out[kind].append((m.start(), m.end()))
    return out


def test_personal_data(spark, docs, none):
    import random

    rng = random.Random(2)
    parts = ["a", "b.", "@", "1", ".", "25", "+", "-", " ", "(", ")", "é", "😀", "%", "0000", "4111 1111 1111 1111", "a@b.co", "+1 (555) 555-0100", "10.0.0.256", "8.8.8.8"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(400)] + [None, "", "a" * 3000, "1." * 3000, "x@y.zz " * 300, "a@" + "b." * 20000 + "c", "+1" + "(" * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df, keep=["doc_id"]).collect():
        assert {k: [(s.start, s.end) for s in r[k]] for k in PII} == personal(texts[r.row.doc_id] or ""), texts[r.row.doc_id]
    assert pii.find(docs).count() == docs.count() and pii.find(none).collect() == []


def test_disclosing_terms_are_found_beside_their_entity(spark):
    rows = [(k, f"note {k}: ask Marrowby at m.marrow@example.org today about item{k}") for k in range(5)]
    rows += [(50 + k, f"today item{k} and note {k} were about other people, ask them at u{k}@example.org today") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: [(s.start, s.end) for s in r.term] for r in pii.find(df, keep=["doc_id"]).collect()}
    for k in range(5):
        assert [rows[k][1][a:b] for a, b in got[k]] == ["Marrowby"]
    assert not any(got[50 + k] for k in range(200))
    clean = spark.createDataFrame([("x a@b.cc y 1.2.3.4",)], "text string").select("text", *(c.alias(k) for k, c in pii.base(F.col("text")).items()))
    assert clean.select(pii.sanitise(F.col("text"), list(PII))).first()[0] == "x [EMAIL] y [IP]"


def test_terms_of_rare_entities_are_judged_by_chance(spark):
    def marked(rows):
        texts = dict(rows)
        found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()
        return {r.row.doc_id: [texts[r.row.doc_id][s.start : s.end] for s in r.term] for r in found if r.term}

    # many words stand in one document only: two documents tell, one does not
    rich = [(k, f"w{k} and v{k} stand here, ask at noon of it") for k in range(600)] + [(1000 + k, f"ask Quillfeather at q@example.org of w{k}") for k in range(2)] + [(2000, "ask Zephyrine at z@example.org")]
    assert marked(rich) == {1000: ["Quillfeather"], 1001: ["Quillfeather"]}
    # nearly no word does: one document tells
    poor = [(k, f"w{k % 20} and v{k % 15} stand here at noon") for k in range(2000)] + [(2000, "w1 and Zephyrine at z@example.org stand here")]
    assert marked(poor) == {2000: ["Zephyrine"]}


def test_disclosing_terms_go_far_from_their_entity_and_without_it(spark):
    far = "it was said that nothing else came of it " * 4
    rows = [(k, f"w{k} and v{k} came of it, as was said") for k in range(400)]
    rows += [(1000 + k, f"Marrowby came. {far} or m.m@example.org or m.m@example.org, {far} said MARROWBY's") for k in range(4)]
    rows += [(1004, "it was said marrowby came, and marrowbys")]
    texts = dict(rows)
    got = {r.row.doc_id: [texts[r.row.doc_id][s.start : s.end] for s in r.term] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect() if r.term}
    assert got.pop(1004) == ["marrowby"]
    assert set(got) == {1000, 1001, 1002, 1003} and all("Marrowby" in x for x in got.values())


TERM = r"[^\W_](?:[^\W_]|['-])*"


def test_terms_classes_and_sanitised_texts_by_brute_force(spark):
    import random

    rng = random.Random(11)
    rows = []
    for k in range(700):
        rows.append((k, " ".join(rng.choice(["note", "came", "of", "it", f"w{k % 90}", f"v{k % 70}", str(1000 + k % 7), "Paris"]) for _ in range(rng.randint(4, 12)))))
    for k in range(8):
        rows.append((2000 + k, f"Marrowby {1900 + k // 4} came at m.m@example.org, MARROWBY's 77123 of note {k}"))
        rows.append((3000 + k, f"it came to Quill at 10.1.1.1 or x7q9 , quill of Paris"))
    rows += [(4000, "marrowby and 77123 without it"), (4001, ""), (4002, None), (4003, "z@z.zz and +4111 1111 1111 1111 11 of z@z.zz")]
    threshold, chance, total = 0.9, 0.05, len(rows)
    blank, ents, where = {}, {}, {}
    for i, t in rows:
        t = t or ""
        where[i], m = personal(t), t
        for kind, found in where[i].items():
            for a, b in found:
                v = (kind, t[a:b].lower() if kind == "email" else t[a:b] if kind == "ip" else re.sub("[^0-9]", "", t[a:b]))
                ents.setdefault(v, set()).add(i)
                m = m[:a] + " " * (b - a) + m[b:]
        blank[i] = m

    def kind_of(x):
        if x.isnumeric():
            return x[0] + "#" * (len(x) - 1) if len(x) > 1 else "#"
        return "[CODE]" if any(c.isnumeric() for c in x) else "[NAME]" if x[0].isupper() else "[WORD]"

    def telling(of):
        docs = {}
        for i, m in blank.items():
            for x in re.findall(TERM, m):
                docs.setdefault(of(x), set()).add(i)
        out = set()
        for x, d in docs.items():
            for e in ents.values():
                both = len(d & e)
                if not both or len(e) == total:
                    continue
                share = math.log2(both * total / (len(e) * len(d)))
                rest = (len(e) - both) * math.log2((len(e) - both) * total / (len(e) * max(total - len(d), 1))) if len(e) > both else 0
                if share >= threshold * math.log2(total / len(e)) and both * share + rest >= math.log2(len(docs) / chance):
                    out.add(x)
        return out

    terms, wide = telling(str.lower), telling(kind_of)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    general = set()
    for r in pii.find(df, keep=["doc_id"]).collect():
        i, m = r.row.doc_id, blank[r.row.doc_id]
        want = [(x.start(), x.end(), "[TERM]" if kind_of(x[0]) in wide else kind_of(x[0])) for x in re.finditer(TERM, m) if x[0].lower() in terms]
        assert [(s.start, s.end, g) for s, g in zip(r.term, r.general, strict=True)] == want, i
        general |= {g for _, _, g in want}
        every = sorted([(a, -b, f"[{k.upper()}]") for k, v in where[i].items() for a, b in v] + [(a, -b, g) for a, b, g in want])
        out, pos = "", 0
        for a, b, mark in every:
            if a >= pos:
                out += m[pos:a] + mark
            pos = max(pos, -b)
        assert r.sanitised == out + m[pos:], i
    assert {"[NAME]", "[TERM]"} <= general and "Marrowby".lower() in terms


def test_sanitising_many_spans_that_overlap(spark):
    text = "1.1.1.1 " * 300 + "4111 1111 1111 1111 +4111 1111 1111 1111 x@y.zz" + " 8.8.8.8@a.bc" * 90 + " end"
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")
    got = {r.row.doc_id: r.sanitised for r in pii.find(df, keep=["doc_id"]).collect()}
    assert got[2] == "none" and got[3] == ""
    every = sorted((a, -b, f"[{k.upper()}]") for k, v in personal(text).items() for a, b in v)
    out, pos = "", 0
    for a, b, mark in every:
        if a >= pos:
            out += text[pos:a] + mark
        pos = max(pos, -b)
    assert got[1] == out + text[pos:] and "8.8" not in got[1]


# 6


def test_chat_templates_can_be_read_back(spark):
    said = ["</s>[INST] ok [/INST]", "a<|im_end|>\nb", "<\\|im_end|>", "<\\\\s>", "\\n", "[\\INST]<<SYS>>x<</SYS>><|user|>", "", None, "<s", "<|im_start|>user\n", "<\\", "<<s><s>"]
    roles = ["user", "as\nsist", "a\\n", "a\\", "<|im_end|>", "", "x\\\\n\n", None]
    df = spark.createDataFrame([(100 * i + j, 0, r, t) for i, t in enumerate(said) for j, r in enumerate(roles)], "conv_id long, msg int, role string, text string").fillna("")
    for r in chat.render(df).join(df, ["conv_id", "msg"]).collect():
        assert chat.parse(r.formatted) == (r.role, r.text)
        inner = r.formatted[len(chat.BEGIN) : -len(chat.END) - 1]
        assert chat.END not in inner and chat.BEGIN not in inner


def test_events_fold_into_messages(spark):
    log = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", ""), (1, 3, "delta", 1, None, "he"), (1, 4, "delta", 1, None, "llo"),
        (1, 5, "regenerate", 1, None, None), (1, 6, "message", 1, "assistant", "yo"), (1, 7, "delta", 1, None, "!"), (1, 8, "edit", 0, None, "hey"),
        (1, 9, "message", 2, "user", "bye"), (1, 10, "delete", 2, None, None), (2, 1, None, 0, "user", None), (2, 2, "delta", 1, "assistant", "x"),
        (3, 1, "message", 0, "user", "q"), (3, 2, "regenerate", 0, None, None), (None, 1, "message", 0, "user", "q"), (4, 1, "message", None, "user", "q"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg long, role string, text string")
    assert sorted(map(tuple, chat.fold(events).collect())) == [(1, 0, "user", "hey"), (1, 1, "assistant", "yo!"), (2, 0, "user", ""), (2, 1, "assistant", "x")]
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(events))).collect()}
    assert back[1].n_turns == 2 and back[1].loss_chars == 3
    assert back[1].turns_sha256 == hashlib.sha256(b"user\nhey\nassistant\nyo!\n").hexdigest()
    assert chat.read_back(chat.render(chat.fold(events.limit(0)))).collect() == []


def told(log):
    """The final messages of a log, event by event."""
    out = {}
    for conv, seq, kind, msg, role, text in sorted((e for e in log if e[0] is not None and e[3] is not None), key=lambda e: e[1]):
        now, role, text, kind = out.setdefault(conv, {}), role or "", text or "", kind or "message"
        if kind == "regenerate":
            out[conv] = {m: x for m, x in now.items() if m < msg}
        elif kind == "delete":
            now.pop(msg, None)
        elif kind == "message":
            now[msg] = (role, text)
        elif msg not in now:
            now[msg] = (role, text)
        else:
            now[msg] = (now[msg][0], now[msg][1] + text if kind == "delta" else text)
    return sorted((c, m, *x) for c, now in out.items() for m, x in now.items())


@pytest.mark.parametrize("chunk", [2, 4096])
def test_random_logs_fold_as_they_are_told(spark, chunk):
    import random

    rng = random.Random(6)
    log = [(rng.choice([1, 2, 3, None]) if k % 50 == 0 else rng.randint(1, 40), k, rng.choice(["message", "delta", "delta", "edit", "regenerate", "delete", None]), rng.randint(0, 8), rng.choice(["user", "assistant", "tool", None]), rng.choice(["a", "bc", "", None, "d\n"])) for k in range(3000)]
    shuffled = rng.sample(log, len(log))
    events = spark.createDataFrame(shuffled, "conv_id long, seq long, kind string, msg long, role string, text string").repartition(5)
    assert sorted(map(tuple, chat.fold(events, F.floor(F.col("msg") / chunk)).collect())) == told(log)


# 7


def test_later_copies_of_windows_go(docs, plain, none, monkeypatch):
    order = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for i, t in plain:
        w = words(t)
        for k in range(len(w) - 4):
            first[tuple(w[k : k + 5])] = min(first.get(tuple(w[k : k + 5]), 2**64), order(i))
    want = []
    for i, t in plain:
        w = words(t)
        gone = {k + j for k in range(len(w) - 4) if first[tuple(w[k : k + 5])] < order(i) for j in range(5)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    for buckets, m, size in ((None, 2, 8 << 20), (2, 3, 2000), (1, 2, 1)):
        monkeypatch.setattr(substring, "PASS_BYTES", size)
        assert bag(tuple(r) for r in substring.remove_repeats(docs, window=5, m=m, buckets=buckets).collect()) == bag(want)
    assert substring.remove_repeats(none).collect() == []


def test_repeats_in_passes(texts):
    """One bucket settled in one pass and in many: the same windows are reported."""
    import pyarrow as pa

    some = [t or "" for t in texts] * 2
    rows = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(some)), pa.int64()), "tk": pa.array([0] * len(some), pa.int64()), "text": some})
    blobs = [x.as_py() for k in (0, 40) for b in substring._pack(5, 2, 1)([rows.slice(k, 40)]) for x in b.column("data") if x.is_valid]

    def reported(size):
        old, substring.PASS_BYTES = substring.PASS_BYTES, size
        try:
            return {(d, s + k) for b in substring._settle(blobs, 5, 7) for d, s, c in zip(*(b.column(n).to_pylist() for n in ("doc", "start", "count"))) for k in range(c)}
        finally:
            substring.PASS_BYTES = old

    assert reported(1 << 30) == reported(1000) == reported(1) != set()


def test_repeats_in_rows_that_share_an_id(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (1, f"{a} x"), (2, f"y {a} z"), (2, b), (2, b), (None, f"{b} q"), (None, a), (None, b)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=5, m=2)
    assert bag(map(tuple, got.collect())) == bag([(1, 7, 0, a), (1, 8, 0, f"{a} x"), (2, 9, 7, "y z"), (2, 6, 0, b), (2, 6, 0, b), (None, 7, 6, "q"), (None, 7, 7, ""), (None, 6, 6, "")])


def test_windows_whose_hashes_clash_are_told_apart(monkeypatch, spark):
    monkeypatch.setattr(substring, "window_hashes", lambda h, n: np.zeros(max(len(h) - n + 1, 0), dtype=np.uint64))
    w = _words.Words(np.frombuffer(b"a b c d a b x y a b c d", dtype=np.uint8), np.array([0, 7, 15, 23]), substring.TABLE)
    at = np.array([0, 4, 8])
    assert substring.later_copies(w, at, np.zeros(3, np.uint64), np.array([5, 6, 7]), 4).tolist() == [False, False, True]


# 8


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [1, 2])
def test_lines_that_repeat_or_nearly_do(spark, threshold):
    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(8, 24))).strip() or "x" for _ in range(14)]

    def changed(x):
        x = list(x)
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "é", " "])
        return "".join(x)

    rows = [(rng.randint(0, 70), "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 5)))) for _ in range(50)]
    rows += [(None, base[0]), (None, base[0]), (5, None), (6, ""), (7, base[1] + "\n" + base[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("no", F.lit(2))
    got = lines.dedup(df, threshold, 6, 10)
    assert got.columns == df.columns
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    last = 2**63 - 1
    seen = [(last if i is None else i, t, k, x.strip(" \t\r\x0b\x0c"), d) for d, (i, t) in enumerate(rows) for k, x in enumerate(t.split("\n") if t is not None else [])]
    seen = [s for s in seen if len(s[3]) >= 6]
    place = {}
    for i, t, k, x, _ in seen:
        place[x] = min(place.get(x, (last + 1, 0, 0)), (i, k, hashes[t]))
    near = {a for a in place for b in place if a != b and min(len(a), len(b)) >= 10 and abs(len(a) - len(b)) <= threshold and place[b] < place[a] and edits(a, b) <= threshold}
    drop = {}
    for i, t, k, x, d in seen:
        if x in near or i > place[x][0] or any(y == x and e == d and m < k for _, _, m, y, e in seen):
            drop.setdefault(d, set()).add(k)
    want = [(i, t if d not in drop else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[d])) for d, (i, t) in enumerate(rows)]
    assert bag((r.doc_id, r.text) for r in got.collect()) == bag(want)


def test_bit_parallel_distance(spark):
    import random

    rng = random.Random(9)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.choice([0, 1])] = rng.choice(["", "a", "b", "é"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.characters(F.col("a")).alias("x"), lines.characters(F.col("b")).alias("y"))
    for t in (1, 2, 3):
        for r in df.withColumn("near", lines.within(F.col("x"), F.col("y"), t)).collect():
            assert r.near == (edits(r.a, r.b) <= t), (r.a, r.b, t)


def test_a_large_family_of_like_lines(spark, monkeypatch):
    """More lines than CROWD share a segment, and seven parts; pairs stay linear, and what goes is what brute force says."""
    import random

    rng = random.Random(4)
    text = "the same long line stands here again and again but for a few letters of it"
    assert len(text) >= 48
    family = set()
    while len(family) < 160:
        x = list(text)
        for k in rng.sample(range(40, 48), rng.randint(0, 2)):
            x[k] = rng.choice("qzj")
        if rng.random() < 0.3:
            x.insert(rng.randrange(40, 48), rng.choice("qzj"))
        family.add("".join(x))
    rows = [(k, x) for k, x in enumerate(rng.sample(sorted(family), len(family)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in lines.dedup(df, counts=True).collect() if r.n_near}
    assert got == {i for i, x in rows if any(j < i and abs(len(x) - len(y)) <= 1 and edits(x, y) <= 1 for j, y in rows)}
    found = lines.near_pairs(lines._lines(df, "doc_id", "text", 24), 1, 48)
    assert found.count() <= 30 * len(rows) < len(rows) ** 2 / 4


def test_lines_without_an_id_and_other_ids(spark):
    same = [(None, f"line number {k} that stands here only once") for k in range(300)]
    df = spark.createDataFrame(same + [(None, same[0][1] + "!"), (None, None)], "doc_id long, text string")
    assert all(r.n_equal == 0 for r in lines.dedup(df, counts=True, min_edit_chars=10**6).collect())
    assert lines._row(df, "doc_id", "text")[1]._jc.toString() == F.xxhash64(F.col("`text`")).alias("tk")._jc.toString()  # 64 bits
    with pytest.raises(TypeError):
        lines.dedup(df.withColumn("doc_id", F.lit("x")))


def test_lines_of_awkward_tables(docs, none):
    assert lines.dedup(docs, counts=True).count() == docs.count()
    assert lines.dedup(none).collect() == []
    assert lines.dedup(docs, drop_empty=True).count() < docs.count()


def test_documents_with_words_left_stay(spark):
    shared = "this line stands in every document of the table"
    df = spark.createDataFrame([(1, shared), (2, f"{shared}\nroses are red\nviolets blue"), (3, shared), (4, f"{shared}\n \t")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup(df, drop_wordless=True).collect()}
    assert got == {1: shared, 2: "roses are red\nviolets blue"}


# 9


def classes_of(rows):
    """n_shingles and component_id of each (doc_id, text), by brute force."""
    sets = []
    for _, t in rows:
        w = [x.translate(LOW) for x in words(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, _) in enumerate(rows):
        for (j, _), t in zip(rows[:k], sets):
            if None not in (i, j) and t and 100 * len(sets[k] & t) >= 75 * len(sets[k] | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(t), None if i is None else find(i)) for (i, _), t in zip(rows, sets)]


def test_near_duplicates(spark, docs, plain, none):
    want = classes_of(plain)
    for block in (512, 4):
        assert bag(map(tuple, neardup.link(docs, block=block).collect())) == bag(want)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == sum(i == c for i, _, c in want)
    assert neardup.link(none).collect() == []


@pytest.mark.parametrize("block", [3, 64])
def test_a_large_family_whose_members_are_linked_through_others(spark, block):
    import random

    rng = random.Random(5)
    base, rows = [f"w{k}" for k in range(70)], []
    for i in range(260):  # members drift apart: many pairs lie near the threshold on either side
        near = list(base)
        for _ in range(rng.randint(0, 9)):
            near[rng.randrange(70)] = f"x{rng.randrange(9)}"
        rows.append((1000 - i, " ".join(near)))
    rows += [(rng.randrange(700, 1000), None), (None, rows[0][1]), (None, rows[0][1]), (None, None), (rows[3][0], "a b c d e f g h"), (5, "A b c d e f g h"), (rows[7][0], rows[8][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = classes_of(rows)
    assert 5 < len({c for _, _, c in want}) < 250
    assert bag(map(tuple, neardup.link(df, block=block).collect())) == bag(want)


def test_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (2, "a b c d e f"), (3, "x y z"), (3, "k l m"), (4, "k l m"), (None, "k l m")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(map(tuple, neardup.link(df).collect())) == bag(classes_of(rows))
    assert sorted(r.doc_id or 0 for r in neardup.keep_first(df).collect()) == [0, 1, 1, 1, 3, 3]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in "ab")
    x, y, both = neardup.registers([np.unique(a), np.unique(b), np.unique(np.concatenate([a, b]))])
    assert (np.maximum(x, y) == both).all()
    for part in (0, 150, 300, 450):
        u, v = np.unique(a), np.unique(np.concatenate([a[:part], b[part:]]))
        r = neardup.registers([u, v])
        true = len(np.intersect1d(u, v)) / len(np.union1d(u, v))
        assert abs(neardup.estimate(r[:1], r[1:], np.array([float(len(u))]), np.array([float(len(v))]))[0] - true) < 0.12


@pytest.mark.parametrize("crowd", [1, 1000])
def test_components(spark, monkeypatch, crowd):
    links = [(5, 4), (4, 3), (3, 9), (20, 21), (30, 30), (41, 40), (42, 41), (43, 42), (44, 43), (40, 44)]
    monkeypatch.setattr(components, "CROWD", crowd)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, **{k: 40 for k in range(40, 45)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# 10


def test_token_files(spark, docs, plain, none, tmp_path):
    tok = tokenfile.tokenizer(WORDS)
    keyed = sorted(((i, t) for i, t in plain), key=lambda r: (r[0] is not None, r[0] or 0))
    got = tokenfile.round_trip(docs, WORDS, 2, length=16).orderBy("start").collect()
    start = 0
    for r, (i, t) in zip(got, keyed, strict=True):
        ids = [*tok.library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.round_trip(none, WORDS, 2).collect() == []


def test_sequences_by_number(spark, docs, tmp_path):
    files = tokenfile.write(docs, WORDS, str(tmp_path / "f"), 2, length=16, parts=1)
    total = files.first().n_ids
    f = tokenfile.TokenFile(str(tmp_path / "f"), 0)
    flat = f.ids(0, total)
    for k in (0, 1, total // 16 - 1, total // 16):
        ids, mask = f.sequence(k)
        assert len(ids) == 16 and (ids[mask] == flat[16 * k : 16 * k + 16]).all() and mask.sum() == min(16, total - 16 * k)


def test_words_of_any_text_are_the_librarys(texts):
    tok = tokenfile.tokenizer(WORDS)
    for t in [*filter(None, texts), "It's 'RE Ǆ ŉ a'sb 12 a1b2 ...!? ª² º µ ß ẞ <|endoftext|> x", "İstanbul ΟΔΟΣ á", "x\x1cy\x0bz a b"]:
        assert np.frombuffer(tok.encode(t), tok.dtype).tolist() == tok.library.encode(t, add_special_tokens=False).ids
