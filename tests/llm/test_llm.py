"""Operators for training data against SQL, brute force and exact round trips, with odd rows."""

import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pulseframe.llm import bpe, chat, embedding_dedup, license, license_texts, line_dedup, mixing, ngram_join, quality, queries, sharding, topk
from pulseframe.llm.common import components

SF = "/root/testdata/sf0.001"
CLASH = ["score", "predicted", "token_ids", "decoded", "n_copies", "copy_no", "mix_key", "license_id", "n_removed", "doc", "thash", "component_id", "slot"]


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randint(0, 10**6)}" for _ in range(n)]


def odd_texts():
    base = words(1, 60)
    near = [*base[:30], "changed", *base[31:]]
    return [
        None, "", "   \n\t ", "one", "one two three", "one two three", " ".join(base), " ".join(base), " ".join(near), " ".join(base).upper(),
        " ".join(words(2, 40)) + "\n" + " ".join(base), "\n".join(" ".join(words(k, 12)) for k in range(3, 9)), "é 中文 \U0001f600 'tis it's\r\n\tx  ", "long " * 30000,
        "Licensed under the Apache License, Version 2.0.", "tail " + " ".join(near),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a null id, and columns with clashing names."""
    t = odd_texts()
    rows = [(i, x, None if i % 5 == 0 else "en", f"s{i % 3}" if i % 4 else None, len(x or "")) for i, x in enumerate(t)] + [(6, t[6], "en", "s0", len(t[6])), (None, "no id here", None, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(1).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def test_registered_queries_equal_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    sql = queries.oracle_sql()
    for name, q in queries.queries().items():
        if name in sql:
            a, b = q(spark, SF).toPandas(), con.sql(sql[name]).df()
            cols = sorted(b.columns)
            assert sorted(a.columns) == cols
            whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v  # longs with nulls
            plain = lambda d: sorted(str([whole(v) for v in row]) for row in d[cols].astype(object).where(d[cols].notna(), None).values.tolist())
            assert plain(a) == plain(b), name


# 1. Chat formatting


def test_chat_round_trip_with_conflicts(spark):
    evil = ["", None, "###", "</turn>", "\\### x </turn>\n### assistant: y", "\\s\\l\\h\\", "a\\", "####", "</turn", "plain", "\\h\\h\\h", "### assistant: </turn>\n"]
    rows = [(c, t, r, x) for c, r in ((1, "assistant"), (2, "user: \n#<\\"), (None, None)) for t, x in enumerate(evil)]
    df = spark.createDataFrame([*rows, rows[3]], "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0))
    got = {r["conv_id"]: r for r in chat.loss_spans(chat.parse_chats(chat.format_chats(df))).collect()}
    for c, role in ((1, "assistant"), (2, "user: \n#<\\"), (None, "")):
        want = [x or "" for x in evil]
        if c == 1:
            want.insert(3, evil[3])
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(role, x) for x in want]
        for t in got[c]["turns"]:
            body = got[c]["formatted"][t["start"] : t["start"] + t["length"]]
            assert body.replace("\\l", "<").replace("\\h", "#").replace("\\s", "\\") == t["text"]
    assert len(got[1]["loss_spans"]) == 13 and got[2]["loss_spans"] == []
    assert chat.digests(chat.loss_spans(chat.parse_chats(chat.format_chats(df.where("false"))))).count() == 0


def test_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 7)
    said = [(1, t, "user" if t % 2 else "assistant", "### " * (t % 3) + "x" * (t % 11)) for t in range(2000)]
    r = chat.parse_chats(chat.format_chats(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in said]
    for t in r["turns"]:
        assert chr(10).join([r["formatted"][t["start"] : t["start"] + t["length"]]]).replace("\\h", "#").replace("\\s", "\\").replace("\\l", "<") == t["text"]


def test_chat_sentinel(spark):
    r = next(x for x in queries.op1_chat_format(spark, SF).collect() if x["conv_id"] == -7)
    s = queries.SENTINEL
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{s}\nassistant\n{s}\n".encode()).hexdigest()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(s), hashlib.sha256(s.encode()).hexdigest())


# 2. Line dedup


def line_tokens(line, run=5):
    w = line.strip(" \t\x0b\x0c\r").split()
    return frozenset(" ".join(w[i : i + run]) for i in range(max(len(w) - run, 0) + 1)) if w else frozenset()


def brute_lines(rows, run=5):
    """rows: (doc_id, text) without repeats of a doc_id."""
    seen, out = [], {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[d] = None
            continue
        kept, had = [], False
        for line in text.split("\n"):
            t = line_tokens(line, run)
            if t and any(4 * len(t & s) >= 3 * len(t | s) for s in seen):
                had = True
            else:
                kept.append(line)
            if t:
                seen.append(t)
        if not had or any(line_tokens(x, run) for x in kept):
            out[d] = "\n".join(kept)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [words(100 + k, rng.choice([1, 3, 8, 40, 60])) for k in range(12)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 4)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 3)}"
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines) if i % 9 else None))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(docs)


def brute_docs(seed, n=60):
    rng = random.Random(seed)
    pool = [words(seed + k, rng.choice([1, 3, 8, 40, 60])) for k in range(12)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 4)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 3)}"
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines)))
    return docs


def test_line_dedup_with_words_as_tokens_and_with_keys_that_collide(spark, monkeypatch):
    docs = brute_docs(31)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, run=1).collect()}
    assert got == brute_lines(docs, 1)
    monkeypatch.setattr(line_dedup, "HASH_BITS", 3)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(docs)


def test_only_lines_with_a_key_of_many_are_counted(spark, monkeypatch):
    """A passage in many lines: these lines alone are counted and joined by rarity, and matches by either order are found."""
    rng = random.Random(8)
    passage, docs = words(900, 12), []
    for i in range(40):
        own = words(300 + i, 24)
        near = [*own[:-1], "z"]
        docs.append((i, " ".join(passage + own if i % 2 else own)))
        docs.append((100 + i, " ".join(passage + near if i % 4 == 1 else near if i % 4 == 2 else words(700 + i, 24))))
    rng.shuffle(docs)
    counted, count = [], line_dedup.rarity

    def counting(docs, text_col, lines, run):
        counted.append(lines.count())
        return count(docs, text_col, lines, run)

    monkeypatch.setattr(line_dedup, "rarity", counting)
    monkeypatch.setattr(line_dedup, "FEW", 4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(sorted(docs)) and len(got) == 60
    with_passage = sum(" ".join(passage) in text for _, text in docs)
    assert len(counted) == 1 and 0 < counted[0] <= with_passage < len(docs)
    counted.clear()
    few = [d for d in docs if " ".join(passage) not in d[1]]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(few, "doc_id long, text string")).collect()}
    assert got == brute_lines(sorted(few)) and not counted


def test_classes_of_counts_rise_and_never_saturate(spark):

    # counts up to the greatest long keep their order in the sort key, behind which whole tables are read
    counts = spark.createDataFrame([(3 * k, 1 << k) for k in range(63)] + [(500, (1 << 63) - 1)], "bucket int, n long").select("bucket", line_dedup.count_class(F.col("n")).alias("c"))
    table = line_dedup.class_table(counts, 9)
    keys = spark.range(512).select("id", F.shiftleft(F.get(table, F.col("id").cast("int")).cast("long"), line_dedup.HASH_BITS).alias("key")).orderBy("id").collect()
    assert [keys[3 * k]["key"] >> line_dedup.HASH_BITS for k in range(63)] == [8 * k for k in range(63)] and all(r["key"] >= 0 for r in keys) and keys[500]["key"] >= keys[186]["key"] > 0 == keys[1]["key"]
    words = F.array(*[F.lit(f"w{k}") for k in range(40)])
    line = spark.range(1).select(F.lit(1).alias("doc"), F.lit(2).alias("thash"), F.lit(0).alias("ln"), words.alias("words"))
    full = line_dedup.class_table(spark.range(512).select(F.col("id").cast("int").alias("bucket"), (F.col("id") % 505).cast("int").alias("c")), 9)
    prefix = line_dedup.prefixed(line, 9, full).first()["prefix"]
    assert prefix == sorted(prefix) and len({k >> line_dedup.HASH_BITS for k in prefix}) > 3 and prefix[-1] >> line_dedup.HASH_BITS < 505


def test_lines_whose_tokens_agree_in_many_bits_are_kept(spark):
    pairs = [("w3041977", "w3279555"), ("w590887", "w313774"), ("w750390", "w2650290")]
    flat = [w for p in pairs for w in p]
    h = [r.h for r in spark.createDataFrame([(w,) for w in flat], "w string").select(F.xxhash64("w").alias("h")).collect()]
    mask = (1 << 41) - 1
    assert all((x ^ y) & mask == 0 and x != y for x, y in zip(h[::2], h[1::2], strict=True))
    docs = [(i, w) for i, w in enumerate(flat)] + [(10, flat[0] + "\n" + "own line")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs) and len(got) == len(docs) and got[10] == "own line"


def test_words_of_lines_with_any_spaces(spark):
    lines = ["a b", "a  b", "a\t\x0b\x0c\r b   c", "one", "x\u00a0y z"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r.w for r in df.select(line_dedup.words_of(F.col("line")).alias("w")).collect()] == [["a", "b"], ["a", "b"], ["a", "b", "c"], ["one"], ["x\u00a0y", "z"]]


def test_trimming_looks_through_a_line_only_where_a_rare_space_ends_it(spark):
    odd = ["", " ", "a", " a b ", "\ta", "a\x0b", " \t a \r ", "\x0c \x0c", "a\tb", "\u00a0a\u00a0 ", "\t", " \u00e4\t"]
    df = spark.createDataFrame([(t,) for t in odd], "line string").select("line", line_dedup.trimmed(F.col("line")).alias("t"))
    assert [r.t for r in df.collect()] == [t.strip(" \t\x0b\x0c\r") for t in odd]


def test_line_dedup_of_odd_rows(odd, nothing):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [c for c in odd.columns if c != "n_removed"] + ["n_removed"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] is None and got[1] == "" and got[2] == "   \n\t " and 5 not in got and 7 not in got
    assert got[10] == " ".join(words(2, 40)) and got[None] == "no id here"
    assert out.where("doc_id = 6").count() == 2
    assert line_dedup.dedup_lines(nothing).count() == 0


# 3. N-gram Jaccard join


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def test_ngram_join_equals_brute_force_in_chains_and_hot_groups(spark):
    rng = random.Random(8)
    docs, base = [], words(7, 120)
    for i in range(220):  # one large group with edits from few to many, so that links form chains
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"q{rng.randint(0, 40)}"
        docs.append(" ".join(w[: rng.choice([120, 120, 110, 95])]))
    for i in range(80):
        w = words(1000 + i % 30, 50) + base[:20]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"y{rng.randint(0, 5)}"
        docs.append(" ".join(w))
    rng.shuffle(docs)
    rows = [(3 * i + 1, t) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_ngram_join_of_odd_rows(spark, odd, nothing):
    got = ngram_join.jaccard_components(odd).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()]
    want = brute_components(rows)
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert ngram_join.jaccard_components(nothing).count() == 0
    assert ngram_join.one_of_each(odd).columns == odd.columns


def test_components_of_long_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (90, 80)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(spark, e).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 80: 80, 90: 80}
    assert components(spark, e.where("false")).count() == 0


# 4. Mixing


def test_mixing_matches_the_inverse_of_the_distribution(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "a" if i % 3 else None, i) for i in range(600)], "doc_id long, text string, source string, n_copies int")
    out = mixing.mix(docs, weights={"a": 3.0, None: 1.0, "absent": 1.0}, epochs=2.0).collect()
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append(r["copy_no"])
    for i in range(600):
        mean = (0.6 if i % 3 else 0.2) * 2.0 * 600 / (400 if i % 3 else 200)
        u = int(hashlib.md5(f"17|{i}|{hashlib.md5(f't{i}'.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / (1 << 52)
        k, p = 0, math.exp(-mean)
        total = p
        while total <= u:
            k += 1
            p *= mean / k
            total += p
        assert sorted(got.get(i, [])) == list(range(1, k + 1))
    share = sum(len(v) for i, v in got.items() if i % 3) / sum(map(len, got.values()))
    assert abs(share - 0.75) < 0.06


def test_mixing_of_odd_rows(odd, nothing):
    out = mixing.mix(odd)
    assert set(out.columns) == set(odd.columns)
    assert out.where("doc_id = 6").count() % 2 == 0
    assert mixing.mix(nothing).count() == 0


def test_large_means(spark):
    cdf = spark.createDataFrame([(900.0,)], "m double").select(mixing.poisson_cdf(F.col("m")).alias("c")).first()["c"]
    assert abs(cdf[-1] - 1) < 1e-9 and 0.4 < cdf[900] < 0.6


def test_means_beyond_the_table_are_split(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "rare" if i < 20 else "common") for i in range(2000)], "doc_id long, text string, source string")
    out = mixing.mix(docs, weights={"rare": 20.0, "common": 1.0}, epochs=20.0).where("source = 'rare'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy_no").alias("m"), F.min("n_copies").alias("c")).toPandas()
    mean = 20 / 21 * 20 * 2000 / 20
    assert len(out) == 20 and (out["n"] == out["m"]).all() and (out["n"] == out["c"]).all()
    assert abs(out["n"].mean() - mean) < 4 * math.sqrt(mean / 20) and 0.4 < out["n"].std() / math.sqrt(mean) < 1.8


# 5. Exact top-k


def brute_top(rows, k=10):
    q = sorted((i, [math.floor(1024 * x) for x in v]) for i, v in rows)
    asked = {i: v for i, v in reversed(q) if i % 100 == 0}  # the least vector of an id
    out = []
    for i, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, u, strict=False)), j) for j, u in q if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_skips_blocks_of_clustered_vectors_whatever_their_ids(spark, monkeypatch):
    r = np.random.default_rng(0)
    centres = r.normal(size=(60, 16))
    vectors = [(centres[i % 60] + 0.05 * r.normal(size=16)).tolist() for i in range(3000)]
    monkeypatch.setattr(topk, "BLOCK", 16)
    shares = []
    for step in (1, 1_000_003):
        seen = []
        df = spark.createDataFrame([(i * step, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        got = topk.top_k(df, lambda i: i % 100 == 0, tell=lambda *x: seen.append(x)).collect()
        assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == brute_top([(i * step, v) for i, v in enumerate(vectors)])
        read, skipped, opened, left = (x.value for x in seen[0])
        shares.append(skipped / (read + skipped))
        assert left > opened  # the queries come from three of sixty clusters
    assert min(shares) > 0.5 and abs(shares[0] - shares[1]) < 0.2


def test_top_k_of_unlike_lengths_large_numbers_and_several_chunks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i * 50, [rng.choice([-1e6, 0.25, 1e6, rng.uniform(-1, 1)]) for _ in range(rng.randint(0, 5))]) for i in range(120)]
    monkeypatch.setattr(topk, "CHUNK", 20)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(rows)


def test_top_k_equals_brute_force_with_ties(spark):
    rng = random.Random(2)
    rows = [(i * 7 - 300, [rng.choice([-0.5, 0.0, 0.5, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(700)]
    rows += [(100_000 + i, rows[i][1]) for i in range(30)]
    bad = [(5, None), (6, [None] * 6), (8, [float("nan")] * 6), (9, [float("inf")] * 6), (None, rows[0][1]), rows[0]]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.where("vec_id is not null and vec_id not in (5, 6, 8, 9)").collect()]
    got = topk.top_k(df, lambda i: i % 100 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(rows)
    assert topk.top_k(df.where("false"), lambda i: i % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(few, lambda i: i % 100 == 0).collect()] == [(1, -1024 * 1024)]


# 6. License scans


def test_license_digests_ignore_case_marks_claims_and_spelling(spark, odd, nothing):
    mit = license.KNOWN[0][1]
    texts = [mit, "Copyright (c) 2019 Someone\n\n" + mit.upper(), mit.replace(".", " ;"), mit + " more", None, "", "***", "This work is licenced under the GNU General Public Licence, version 3"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["license_id"] for r in license.scan(df).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: "GPL-3.0"}
    lines = license.scan_lines(spark.createDataFrame([(1, "a\nReleased under the MIT License.\nx"), (2, None)], "i int, text string"))
    assert {r["i"]: r["line_licenses"] for r in lines.collect()} == {1: ["MIT"], 2: []}
    out = license.scan(odd)
    assert out.where("license_id = 'Apache-2.0'").count() == 1 and out.count() == odd.count()
    assert license.scan(nothing).count() == 0


def test_whole_files_of_common_licenses_are_known(spark):
    full = license_texts.TEXTS
    claim = "Copyright (c) 2021 Someone Else\n\n"
    mit, bsd = license.KNOWN[0][1], full["BSD-3-Clause"]
    wrapped = mit.replace(", ", ",\n").replace("Software", "Software\n")
    two = bsd[: bsd.index("3. Neither")] + bsd[bsd.index("THIS SOFTWARE IS") :]
    files = [("MIT", "MIT License\n\n" + claim + wrapped), ("MIT", "The MIT License (MIT)\n" + claim + mit), ("ISC", "ISC License\n" + claim + license.KNOWN[1][1])]
    files += [("BSD-3-Clause", "BSD 3-Clause License\n\n" + claim + "All rights reserved.\n\n" + bsd), ("BSD-2-Clause", claim + two), ("BSD-2-Clause", "BSD 2-Clause License\n" + claim + two)]
    files += list(full.items()) + [(k, "\n".join(full[k].splitlines()[2:])) for k in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")]
    files += [("Apache-2.0", full["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Someone")), ("Apache-2.0", full["Apache-2.0"][: full["Apache-2.0"].index("   APPENDIX")])]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(files)], "i int, text string")
    got = {r["i"]: r["license_id"] for r in license.scan(df).collect()}
    assert got == {i: k for i, (k, _) in enumerate(files)}


def test_claims_without_a_year_go_and_licence_lines_stay(spark):
    mit, isc = license.KNOWN[0][1], license.KNOWN[1][1]
    wrapped = mit.replace("The above copyright notice", "The above\ncopyright notice").replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS OR\nCOPYRIGHT HOLDERS")
    texts = ["Copyright Jane Doe\n\n" + mit, "Copyright (c) Jane Doe and others\n" + wrapped, "(c) 2020\n© Jane\nCopyright\n" + isc, "Copyright: the authors, see AUTHORS\n" + mit]
    got = {r["i"]: r["license_id"] for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "ISC", 3: "MIT"}


def test_scan_lines_finds_every_given_text(spark):
    known = [("A", "Zlib applies to this file."), ("B", "Use at own risk"), ("C", "An organisation's rules")]
    df = spark.createDataFrame([(1, "x\nzlib APPLIES to this file\nUse at own -- risk"), (2, "an organization s rules\nan ORGANISATION's rules"), (3, "no match")], "i int, text string")
    assert {r["i"]: r["line_licenses"] for r in license.scan_lines(df, known=known).collect()} == {1: ["A", "B"], 2: ["C"], 3: []}


# 7. Byte-level BPE


def test_workers_of_the_pipeline_get_batches_of_bounded_bytes(spark):
    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(30, numPartitions=1).select("id", F.repeat(F.lit("ab c "), 200_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], names=["n", "size"])

    steps = {
        "bpe": lambda: bpe.encode(rows, {b"a": 0}),
        "classifier": lambda: quality.score(rows, quality.learn([])),
        "n-gram join": lambda: ngram_join.jaccard_components(spark.range(2).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))),
    }
    try:
        for name, step in steps.items():
            spark.conf.unset(key)
            step()
            got = rows.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r["n"] for r in got) == 30 and max(r["size"] for r in got) < 6_000_000, name
        spark.conf.set(key, "1m")
        bpe.encode(rows, {b"a": 0})
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


def test_bpe_holds_a_bounded_number_of_bytes_at_once():
    """Memory follows the bytes of a slice, not the number of texts in it: 200 texts of 42 kB at once took 554 MB."""
    import tracemalloc

    ranks = {bytes([i]): i for i in range(256)}
    texts = [f"{i} ".encode() + b"some words of a text " * 2000 for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["t"])
    merger, vocab, n = bpe.Merger(ranks), bpe.Vocabulary(ranks), 0
    next(bpe.coded(iter([batch.slice(0, 1)]), 0, merger, vocab, True))
    tracemalloc.start()
    for some, (ids, _, decoded) in bpe.coded(iter([batch]), 0, merger, vocab, True):
        assert decoded.to_pylist() == texts[n : n + len(some)] and len(ids) == len(some)
        n += len(some)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and peak < 200e6


def test_bpe_equals_the_library(spark, odd, nothing):
    import public_tokenizers as P
    import tiktoken

    ranks = queries.public_ranks()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = list("aB é1²٣ \n\t 　\x1c'''sdmtlvre!?.,中ß\U0001f600́_")
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, "!" * 3000, " " * 999 + "x", "'s", "<|endoftext|>"] + [t or "" for t in odd_texts()]
    assert bpe.encode_texts(texts, bpe.Merger(ranks)) == [enc.encode_ordinary(t) for t in texts]
    out = bpe.decode(bpe.encode(odd, ranks), ranks)
    for r in out.collect():
        t = r["text"] or ""
        assert r["token_ids"] == enc.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
        assert r["token_offsets"] == [0, *np.cumsum([len(enc.decode_single_token_bytes(i)) for i in r["token_ids"]]).tolist()]
    whole = bpe.digests(bpe.encode(odd, ranks, decoded=True)).drop("text")
    assert sorted(map(str, whole.collect())) == sorted(map(str, bpe.digests(out).drop("text").select(*whole.columns).collect()))
    assert bpe.digests(bpe.decode(bpe.encode(nothing, ranks), ranks)).count() == 0


# 8. Embedding near-dedup


def test_embedding_links_reach_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for g in range(40):
        c = r.normal(size=16)
        rows += [((c + r.normal(size=16) * r.choice([0.02, 0.1, 0.25])).tolist(), int(g % 2)) for _ in range(8)]
    rows += [(rows[0][0], 0)] * 30 + [([0.0] * 16, 0), (None, 0), ([float("nan")] * 16, 1), ([None] * 16, 1), (rows[0][0], None)]
    df = spark.createDataFrame([(i, v, l) for i, (v, l) in enumerate(rows)], "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit(0))
    x = {i: np.array(v, np.float32).astype(float) for i, (v, l) in enumerate(rows[:350]) if l is not None}
    want = {(i, j) for i in x for j in x if i < j and rows[i][1] == rows[j][1] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.93}
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    linked = sum(r["n_links"] for r in got.values()) / 2
    assert 0.99 * len(want) <= linked <= len(want)
    for i in range(350, 355):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[330]["component_id"] == 0 and got[330]["n_links"] >= 30
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_embedding_recall_at_the_threshold(spark):
    """Pairs whose cosine is just above the threshold, in 64 dimensions, among unrelated vectors."""
    r = np.random.default_rng(9)
    base = r.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = r.normal(size=(400, 64))
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = 0.9301 * base + math.sqrt(1 - 0.9301**2) * away
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(np.concatenate([base, near]))], "vec_id long, embedding array<double>, label string")
    got = embedding_dedup.near_duplicates(df).toPandas()
    assert got["n_links"].sum() / 800 >= 0.96 and (got["n_links"] <= 1).all()


def test_a_large_group_of_near_copies_makes_few_pairs(spark):
    r = np.random.default_rng(4)
    c = r.normal(size=64)
    rows = [(i, (c + 0.08 * r.normal(size=64)).tolist(), 1) for i in range(1500)] + [(5000 + i, r.normal(size=64).tolist(), 1) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([v for _, v, _ in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(1) - 1
    got = embedding_dedup.near_duplicates(df).orderBy("vec_id").toPandas()
    assert got["n_links"].tolist() == want.tolist() and (got["component_id"][:1500] == 0).all()
    classes = df.select(F.col("vec_id").alias("cid"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("x"))
    plan = embedding_dedup.plan_for(2000, 0.93)
    placed = embedding_dedup._placed(classes, plan).cache()
    assert embedding_dedup._pairs(placed, embedding_dedup._cliques(placed, plan)).count() < 10 * len(rows)


def test_long_lists_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART", 16)
    r = np.random.default_rng(7)
    c = r.normal(size=8)
    rows = [(i, (c + 0.3 * r.normal(size=8)).tolist(), i % 2) for i in range(200)]
    u = np.array([v for _, v, _ in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.93) & (np.arange(200)[:, None] % 2 == np.arange(200) % 2)).sum() - 200
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    assert 0.99 * want <= got["n_links"].sum() <= want


def test_embeddings_of_unlike_lengths_and_labels_of_text(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [1.0, 0.0, 0.0], "x"), (3, [1.0, 0.01], "x"), (4, [1.0, 0.0], "y"), (5, [], "x"), (6, [1.0, 0.0], None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}


# 9. Sharding


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def brute_map(sizes, shards, start, slots=sharding.SLOTS):
    """Slots of ids by hash, and the shards of slots after moves from the fullest shard to the emptiest, recomputed at each step."""
    weight = [0] * slots
    for i, size in sizes.items():
        weight[signed(xxhash.xxh64_intdigest(str(i).encode(), 42)) % slots] += size
    shard = list(start)
    while True:
        load = [0] * shards
        for s, x in enumerate(shard):
            load[x] += weight[s]
        high, low = load.index(max(load)), load.index(min(load))
        fit = [(weight[s], -s) for s in range(slots) if shard[s] == high and 0 < weight[s] <= (load[high] - load[low]) // 2]
        if not fit:
            return shard
        shard[-max(fit)[1]] = low


def test_shards_follow_the_stored_map_and_its_edits(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.createDataFrame([(i, "x" * random.Random(i).choice([5, 50, 500, 4000])) for i in range(2000)], "doc_id long, text string")
    sizes = {r["doc_id"]: len(r["text"]) + 8 for r in docs.collect()}
    first = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, 24, map_path=path).collect()}
    one = brute_map(sizes, 24, [s % 24 for s in range(sharding.SLOTS)])
    slot = {i: signed(xxhash.xxh64_intdigest(str(i).encode(), 42)) % sharding.SLOTS for i in sizes}
    assert first == {i: one[slot[i]] for i in sizes}
    again = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, 25, map_path=path).collect()}
    two = brute_map(sizes, 25, one)
    assert again == {i: two[slot[i]] for i in sizes}
    stored = sharding.load_map(spark, path)
    assert stored.versions[1:] == [one, two] and stored.shards == 25
    assert sum(a != b for a, b in zip(one, two, strict=True)) < sharding.SLOTS / 20
    fewer = sharding.assign(docs, 20, map_path=path).toPandas()
    load = fewer.groupby("shard")["size"].sum()
    assert len(load) == 20 and load.max() / load.min() < 1.1 and sharding.load_map(spark, path).shards == 20


def test_shards_are_even_and_places_have_no_gaps(spark, odd, nothing, tmp_path):
    docs = spark.createDataFrame([(i, "x" * random.Random(i).choice([5, 50, 500, 4000])) for i in range(3000)], "doc_id long, text string")
    out = sharding.assign(docs, 24, map_path=str(tmp_path / "map")).toPandas()
    total = out.groupby("shard")["size"].sum()
    assert len(total) == 24 and total.max() / total.min() < 1.02
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    loaded = sharding.load_map(spark, str(tmp_path / "map"))
    assert len(loaded.versions) == 2 and loaded.shards == 24
    got = sharding.assign(odd, 3).collect()
    assert len(got) == odd.count()
    texts = {(r["doc_id"]): r["text"] or "" for r in odd.collect()}
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert sharding.assign(nothing, 3).count() == 0


def test_rebalancing_moves_few_slots():
    m = sharding.new_map(4, 64)
    w = [1] * 64
    w[0] = 5
    m.rebalance(w)
    assert sum(a != b for a, b in zip(m.versions[0], m.versions[1], strict=True)) <= 4
    m.rebalance(w, shards=5)
    moved = [(a, b) for a, b in zip(m.versions[1], m.versions[2], strict=True) if a != b]
    assert moved and max(m.loads(w)) - min(m.loads(w)) <= 2


# 10. Quality classifier


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op10_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.97
    assert out.loc[out["quality"] == 1, "predicted"].mean() > 0.99


def test_score_equals_the_sum_over_pairs():
    r = np.random.default_rng(0)
    m = quality.BUCKETS + len(quality.STRUCTURE)
    n = len(quality.STRUCTURE)
    fm = quality.Machine(0.1, r.normal(size=m).astype(np.float32), (0.1 * r.normal(size=(m, 4))).astype(np.float32), np.zeros(n), np.ones(n))
    text = "some words, some more words\nand a line"
    idx, val, numbers = quality.features(text)
    x = np.zeros(m)
    np.add.at(x, idx, val)
    x[quality.BUCKETS :] = fm.scaled(np.array(numbers))
    at = np.flatnonzero(x)
    pairs = sum(float(fm.v[i] @ fm.v[j]) * x[i] * x[j] for a, i in enumerate(at) for j in at[a + 1 :])
    want = 1 / (1 + math.exp(-(0.1 + float(fm.w @ x) + pairs)))
    assert abs(fm.score([text])[0] - want) < 1e-4


def test_classifier_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(16)] + [(3, None, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality.accept(odd, labels).columns == odd.columns
    many = odd.where("doc_id = 10").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(50)))).drop("i").unionByName(odd)
    assert quality.score(odd, quality.fit(many, labels)).select("score").collect() == [(r["score"],) for r in out]
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert quality.score(named, quality.fit(named, labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))).count() == odd.count()
    one = quality.fit(nothing, labels.where("false"))
    assert quality.score(nothing, one).count() == 0 and quality.score(odd, one).count() == odd.count()


def test_no_text_goes_to_a_scorer_twice(spark, odd):
    """Neither beside the rows that are kept, nor beside itself."""
    machine = quality.learn([])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (quality.accept(odd, labels), quality.score(odd, machine)):
        child = out._jdf.queryExecution().analyzed()
        while "MapInArrow" not in child.getClass().getSimpleName():
            child = child.children().apply(0)
        kinds = child.children().apply(0).schema().simpleString()
        assert kinds.count("text:string") == 1


# The pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    kept = cp.quality_stage(spark, docs, sf).cache()
    assert kept.columns == cols and kept.count() < docs.count()
    lined = cp.line_stage(spark, kept, sf).cache()
    want = brute_lines([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == want
    one = cp.ngram_stage(spark, lined, sf).cache()
    comp = brute_components(sorted((r["doc_id"], r["text"]) for r in lined.collect()))
    assert {r["doc_id"] for r in one.collect()} == {d for d, (_, c) in comp.items() if d == c}
    mixed = cp.mix_stage(spark, one, sf)
    assert mixed.columns == cols and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in one.collect()}
    assert cp.run(spark, sf).count() == mixed.count()


def test_pipeline_of_odd_rows_and_of_none(spark, odd, tmp_path):
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(16)], "doc_id long, quality int, toxic int")
    clean = odd.where("length(text) < 10000 or text is null")
    for name, docs in (("odd", clean), ("none", clean.where("false"))):
        sf = str(tmp_path / name)
        docs.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        before = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in cp.STAGES[:-1]:
            after = stage(spark, before, sf)
            assert [c.lower() for c in after.columns if c not in CLASH] == [c.lower() for c in before.columns if c not in CLASH]
        out = cp.run(spark, sf).collect()
        assert (len(out) > 0) == (name == "odd")
