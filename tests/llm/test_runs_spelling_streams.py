"""Periodic runs, spelling variants and streamed BPE against brute force and the tokenizers library, with odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulseframe.llm import periodic_runs, queries, spelling, stream_bpe

SF = "/root/testdata/sf0.001"
MODEL = stream_bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def odd(spark):
    """Odd and very long texts, a repeated row, a null id, and columns with clashing names."""
    r = random.Random(3)
    texts = [
        None, "", " \n\t ", "one", "a b a b a b a b", "tail a b a b a b a b c", "buy now " * 9, "x " * 20000, "  spaced\r\nout\x0bwords\x0c ", "é 中文 \U0001f600 'tis it's\r\n\tx  ",
        " ".join(r.choice("ab") for _ in range(300)), "say <|endoftext|> and <|endo", "a" * 200_000, "Colour colour color COLOR colours Öffnung öffnung", "colour color " * 40,
    ]
    rows = [*enumerate(texts), (4, texts[4]), (None, "no id here no id here no id here no id here")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, x long")
    return df.select("*", *[F.lit(1).alias(c) for c in ("runs", "RUN", "collapsed", "n_words", "token_ids", "decoded", "word", "n", "near", "form", "root")])


# 11. Periodic runs


def brute_runs(ws, least, exponent):
    found = {}
    for q in range(1, len(ws) // exponent + 1):
        i = 0
        while i < len(ws) - q:
            j = i
            while j < len(ws) - q and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_equal_brute_force():
    r = random.Random(7)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 4)):
            unit, n = [r.choice("abc") for _ in range(r.randint(1, 6))], r.randint(0, 60)
            ws = r.choice([[r.choice("ab") for _ in range(n)], (unit * 12)[:n], ["a"] * n + ["b"] * 5 + ["a"] * n, [r.choice("abcdefgh") for _ in range(n)]])
            texts.append([w if r.random() > 0.02 else "z" for w in ws])
        least, exponent = r.choice([(6, 4), (2, 2), (4, 3)])
        got = periodic_runs._batch([" ".join(w).encode() for w in texts], least, exponent)
        assert [[tuple(x.values()) for x in one] for one in got[1].to_pylist()] == [brute_runs(w, least, exponent) for w in texts]


def test_runs_of_long_texts_and_bounds_from_the_table(monkeypatch):
    monkeypatch.setattr(periodic_runs, "JUMPS", 1)
    monkeypatch.setattr(periodic_runs, "AT_ONCE", 64)
    for ws in (["a"] * 3000, ["a", "b", "c"] * 500 + ["a"] * 900 + ["b"], ["w%d" % (k % 700) for k in range(2900)]):
        got = periodic_runs._batch([" ".join(ws).encode()], 6, 4)[1].to_pylist()[0]
        assert [tuple(x.values()) for x in got] == brute_runs(ws, 6, 4)


def test_runs_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for i, text in docs:
        ws = (text or "").encode().split()
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and ws:
            a = h // 10 % len(ws)
            p = 1 + (len(ws) - a) // (3 + h // 10 % 8)
            ws = [w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws)]
        runs = brute_runs(ws, 6, 4) if len(ws) < 3000 else None
        if runs is None:
            continue
        planted += bool(runs)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        row = got[i]
        assert (row["start"], row["length"], row["period"], row["n_runs"]) == (*best, len(runs))
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for k, w in enumerate(ws) if k not in gone)).hexdigest()
    assert planted


def test_runs_of_odd_rows_and_of_none(spark, odd):
    out = periodic_runs.find_runs(odd)
    assert {"RUN", "x", "token_ids"} <= set(out.columns) and out.columns.count("runs") == 1
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        ws = (r["text"] or "").encode().split()
        assert r["n_words"] == len(ws)
        if len(ws) < 1000:
            assert [tuple(x) for x in r["runs"]] == brute_runs(ws, 6, 4)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[7]["collapsed"] == "x" and by_id[0]["collapsed"] == "" and by_id[6]["collapsed"] == "buy now"
    assert periodic_runs.digests(periodic_runs.find_runs(odd.where("false"))).count() == 0
    assert periodic_runs.plant(odd).count() == odd.count()
    with pytest.raises(ValueError):
        periodic_runs.find_runs(odd, min_exponent=1)


# 12. Spelling variants


def brute_variants(occurrences, least=6, at_least=5, ratio=5):
    n = {}
    for w in occurrences:
        if len(w) >= least:
            n[w] = n.get(w, 0) + 1
    n = {w: k for w, k in n.items() if k >= at_least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, out = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (forms[w], n[w], len(close), n[best] if forms[w] else None)
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def test_variants_equal_brute_force(spark):
    r = random.Random(5)
    base = ["aabbaa", "colour", "niveau", "größen", "éééééé"]
    words = []
    for w in base:
        for k in range(30):
            x = list(w)
            for _ in range(r.randint(0, 2)):
                i = r.randrange(len(x))
                x[i : i + r.randint(0, 1)] = r.choice([[], ["a"], ["é"], [x[i]]])
            words += ["".join(x)] * r.choice([1, 4, 5, 6, 30, 200, 1200])
    got = spelling.variants(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert {g["word"]: (g["form"], g["root"], g["n"], g["n_near"], g["form_n"]) for g in got} == brute_variants(words)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    words = spelling.runs(spark.read.parquet(f"{SF}/documents.parquet")).select(F.col("run").alias("word"))
    want = sorted(map(str, spelling.variants(words).collect()))
    monkeypatch.setattr(spelling, "MOST_BITS", 256)
    monkeypatch.setattr(spelling, "AT_ONCE", 5000)
    assert sorted(map(str, spelling.variants(words).collect())) == want


def test_neighbourhood_is_full_and_distinct(spark):
    vocab = spark.createDataFrame([("aab", 5), ("b", 6), ("aaa", 7)], "word string, n long")
    ones = np.full(8, 255, np.uint8)
    real, spelling.bloom = spelling.bloom, lambda *a: ones
    try:
        got = [(r["word"], r["near"]) for r in spelling.neighbourhood(vocab, "ab").collect()]
    finally:
        spelling.bloom = real
    want = {("aab", x) for x in ("ab", "aa", "bab", "abb", "aaa", "aaab", "baab", "abab", "aabb", "aaba")} | {("b", x) for x in ("", "a", "ab", "ba", "bb")}
    want |= {("aaa", x) for x in ("aa", "baa", "aba", "aab", "aaaa", "baaa", "abaa", "aaba", "aaab")}
    assert sorted(got) == sorted(want)


def test_variants_of_odd_rows_and_of_none(spark, odd):
    found = spelling.runs(odd)
    assert {r["run"] for r in found.collect()} >= {"colour", "öffnung", "Öffnung", "a" * 200_000}
    long = "b" * 3000
    more = spark.createDataFrame([(long,)] * 5 + [(long + "b",)] * 30, "word string")
    got = {r["word"]: r for r in spelling.variants(spelling.with_slips(found).unionByName(more)).collect()}
    assert got["colour"]["n_near"] == 0 and got[long]["root"] == long + "b"
    assert spelling.variants(spelling.with_slips(spelling.runs(odd.where("false")))).count() == 0


def test_slips_follow_the_hash(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("Spelling variants").alias("text"))
    got = sorted(r["word"] for r in spelling.with_slips(spelling.runs(docs), every=7).collect())
    want = []
    for i in range(400):
        for w in ("spelling", "variants"):
            h = zlib.crc32(f"{i}:{w}".encode())
            want.append(w if h % 7 else w[: h % len(w)] + w[h % len(w) + 1 :])
    assert got == sorted(want)


def test_spelling_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    got = queries.op12_spelling_variants(spark, SF).select(*cols).collect()
    want = con.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()['op12_spelling_variants']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


# 13. Streamed BPE


def encoded(model, text, size, slices=None):
    e, out = stream_bpe.Encoder(model, slices), []
    for at in range(0, max(len(text), 1), size):
        out += e.push(text[at : at + size], at + size >= len(text))
    return out


def test_lookahead_suffices_for_any_rules():
    r = random.Random(2)
    for _ in range(600):
        made, rules = [bytes([97 + i]) for i in range(r.randint(1, 3))], []
        for _ in range(40):
            u, v = r.choice(made), r.choice(made)
            if u + v not in made and len(u + v) <= 8:
                made.append(u + v)
                rules.append((u, v))
        vocab = {bytes([b]): b for b in range(256)} | {u + v: 256 + k for k, (u, v) in enumerate(rules)}
        model = stream_bpe.Model.of(vocab, rules)
        m = stream_bpe.Merger(model)
        m.window = 1 + model.longest
        text, got = bytes(r.choice(b"abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 200))), []
        for at in range(0, len(text), 7):
            got += m.push(text[at : at + 7])
            assert len(m.held) <= m.window + model.ahead + 7
        assert got + m.end() == m._many([model.byte_ids[b] for b in text]) == m._few([model.byte_ids[b] for b in text])


def test_lookahead_of_known_rules():
    assert stream_bpe.lookahead([(b"a", b"b")]) == 1
    assert stream_bpe.lookahead([(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 3
    for bad in ([(b"ab", b"c")], [(b"a", b"b"), (b"a", b"b")]):
        with pytest.raises(ValueError):
            stream_bpe.lookahead(bad)
    assert 0 < MODEL.ahead < 1000


def test_pieces_of_any_size_encode_like_the_library(monkeypatch):
    monkeypatch.setattr(stream_bpe, "PIECE", 16)
    monkeypatch.setattr(stream_bpe, "WINDOW", 1)
    r, slices = random.Random(4), stream_bpe.Slices(MODEL)
    parts = ["a" * 40, "b", "'s", "'re", " ", "  ", "\n", "\t", " \n ", "1234", "!?", "...'", " é", "中文", "\U0001f600", "<|endoftext|>", "<|endo", "|>", "'ll", "   x", " " * 50, "=" * 90, "'"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert encoded(MODEL, text, r.randint(1, 30), slices) == want
        assert stream_bpe._text(MODEL, np.array(want, np.int32)) == text
    for _ in range(100):
        ids = [r.randrange(50257) for _ in range(40)]
        assert stream_bpe._text(MODEL, np.array(ids, np.int32)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_every_code_point_is_cut_as_the_library_cuts_it():
    slices = stream_bpe.Slices(MODEL)
    points = [c for c in [*range(0x3100), *range(0x3100, 0x110000, 251)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)} '{chr(c)}s" for c in points]
    for text, want in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoded(MODEL, text, 100, slices) == want.ids


def test_one_endless_slice_needs_constant_memory():
    e, most = stream_bpe.Encoder(MODEL), 0
    out = []
    for _ in range(40):
        out += e.push("ab" * 20_000)
        most = max(most, len(e.held) + len(e.merger.held))
    out += e.push("", True)
    assert most <= stream_bpe.PIECE + 40_000 + e.merger.window + MODEL.ahead
    assert out == LIBRARY.encode("ab" * 800_000, add_special_tokens=False).ids


def test_stream_query_equals_the_library(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op13_stream_bpe(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_streams_of_odd_rows_and_of_none(spark, odd):
    coded = stream_bpe.encode(odd, MODEL)
    assert coded.columns.count("token_ids") == 1 and "x" in coded.columns
    rows = stream_bpe.decode(coded, MODEL).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["token_ids"] == LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    assert stream_bpe.digests(stream_bpe.encode(odd.where("false"), MODEL, decoded=True)).count() == 0


def test_other_files_are_refused(tmp_path):
    import json

    said = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    said["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(said), encoding="utf-8")
    with pytest.raises(ValueError):
        stream_bpe.load(str(tmp_path / "t.json"))
