"""The registered queries of these operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embedding_dedup, license, line_dedup, mixing, ngram_join, periodic_runs, quality, sharding, spelling, stream_bpe, topk
from .common import shared_dir

SHARDS = 24
SENTINEL = "\\### Assistant: </turn> ok"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_ranks() -> dict[bytes, int]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", SENTINEL), (-7, 1, "assistant", SENTINEL)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.loss_spans(chat.parse_chats(chat.format_chats(turns))))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_copies", "copy_no")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return license.scan_lines(license.scan(docs)).select("doc_id", "license_digest", "license_id", F.array_join("line_licenses", ",").alias("line_licenses"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_ranks()
    coded = bpe.encode(_read(spark, sf_dir, "documents"), ranks, keep=["doc_id"], decoded=True)
    return bpe.digests(coded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    docs = _read(spark, sf_dir, "documents")
    out = sharding.assign(docs, SHARDS, map_path=path)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    machine = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, machine, keep=["doc_id"]).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.plant(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    out = periodic_runs.digests(periodic_runs.find_runs(docs, keep=["doc_id"]))
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.with_slips(spelling.runs(_read(spark, sf_dir, "documents"))))


def op13_stream_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = stream_bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    coded = stream_bpe.encode(_read(spark, sf_dir, "documents"), model, keep=["doc_id"], decoded=True)
    return stream_bpe.digests(coded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = [op1_chat_format, op2_line_dedup, op3_ngram_jaccard_join, op4_mix_sources, op5_top_k, op6_license_scan, op7_byte_bpe, op8_embedding_dedup, op9_virtual_slot_shards, op10_quality_classifier, op11_periodic_runs, op12_spelling_variants, op13_stream_bpe, pipeline]
    return {f.__name__: f for f in ops}


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *,
    CASE WHEN contains(body, '###') OR contains(body, '</turn>') OR contains(body, '\s') OR contains(body, '\l') OR contains(body, '\h')
      THEN CASE WHEN contains(replace(replace(replace(body, '\', '\s'), '</turn>', '\l/turn>'), '###', '\h\h\h'), '###')
        THEN replace(replace(replace(body, '\', '\s'), '<', '\l'), '#', '\h')
        ELSE replace(replace(replace(body, '\', '\s'), '</turn>', '\l/turn>'), '###', '\h\h\h') END
      ELSE body END AS shown
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  coalesce(sum(length(body)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || role || ': ' || shown || '</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP2_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(range(len(ls))) AS ln, unnest(ls) AS line FROM raw
), w AS (
  SELECT doc_id, ln, string_split_regex(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[\x20\x09\x0B-\x0D]+') AS ws
  FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
), s AS (
  SELECT doc_id, ln, list_sort(list_distinct(list_transform(range(greatest(len(ws) - 5, 0) + 1), lambda i: list_aggregate(ws[i + 1 : i + 5], 'string_agg', ' ')))) AS toks FROM w
), d AS (
  SELECT toks, min((doc_id, ln)) AS f, row_number() OVER (ORDER BY min((doc_id, ln))) AS id, len(toks) AS n FROM s GROUP BY toks
), p AS (
  SELECT id, n, unnest(toks) AS tok FROM d
), near AS (
  SELECT a.id AS x, b.id AS y FROM p a JOIN p b ON a.tok = b.tok AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), gone AS (
  SELECT s.doc_id, s.ln FROM s JOIN d ON s.toks = d.toks WHERE (s.doc_id, s.ln) > d.f OR d.id IN (SELECT y FROM near)
), n AS (
  SELECT doc_id, count(*) AS k FROM gone GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.ln) AS text, bool_or(w.ln IS NOT NULL) AS words
  FROM l LEFT JOIN w ON w.doc_id = l.doc_id AND w.ln = l.ln WHERE (l.doc_id, l.ln) NOT IN (SELECT (doc_id, ln) FROM gone) GROUP BY l.doc_id
)
SELECT doc_id, CASE WHEN k IS NULL THEN raw.text ELSE kept.text END AS text, coalesce(k, 0)::BIGINT AS n_removed
FROM raw LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id) WHERE k IS NULL OR coalesce(words, false)
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(greatest(len(ws) - 5, 0) + 1), lambda i: list_aggregate(ws[i + 1 : i + 5], 'string_agg', ' ')))) END AS toks FROM w
), d AS (
  SELECT toks, min(doc_id) AS id, len(toks) AS n FROM s WHERE len(toks) > 0 GROUP BY toks
), p AS (
  SELECT id, n, unnest(toks) AS tok FROM d
), near AS (
  SELECT a.id AS x, b.id AS y FROM p a JOIN p b ON a.tok = b.tok AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), e AS (
  SELECT x, y FROM near UNION SELECT y, x FROM near
), r AS (
  SELECT id, id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON r.id = e.x
), c AS (
  SELECT id, min(c) AS c FROM r GROUP BY id
)
SELECT s.doc_id, len(s.toks)::BIGINT AS n_shingles, coalesce(c.c, s.doc_id) AS component_id
FROM s LEFT JOIN d ON s.toks = d.toks LEFT JOIN c ON c.id = d.id
"""

OP4_SQL = f"""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(pow(n, 0.7)) AS t, sum(n) AS size FROM c),
m AS (SELECT source, (pow(n, 0.7) / t.t) * 1.0::DOUBLE * size / n AS mean FROM c, t),
logs AS (SELECT source, mean, k, sum(CASE WHEN k > 0 THEN ln(mean) - ln(k::DOUBLE) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS lg
  FROM m, (SELECT unnest(range(400)) AS k) WHERE k <= ceil(mean) + {mixing.TERMS} + ceil(sqrt(mean) * {mixing.PER_ROOT})),
cdf AS (SELECT source, k, sum(exp(lg - mean)) OVER (PARTITION BY source ORDER BY k) AS p FROM logs),
lists AS (SELECT source, list(p ORDER BY k) AS ps FROM cdf GROUP BY source),
u AS (SELECT *, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE AS u FROM documents),
k AS (SELECT u.doc_id, u.source, u.text, len(list_filter(ps, lambda p: p <= u))::BIGINT AS n_copies FROM u JOIN lists ON u.source IS NOT DISTINCT FROM lists.source)
SELECT doc_id, source, text, n_copies, unnest(range(1, n_copies + 1)) AS copy_no FROM k WHERE n_copies > 0
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) a JOIN v b ON a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _op6_sql() -> str:
    def canonical(c: str) -> str:
        c = f"translate({c}, '{license.UPPER}', '{license.LOWER}')"
        for word in license.NOT_CLAIMS:
            c = f"replace({c}, 'copyright {word}', 'copyright_{word}')"
        c = f"regexp_replace({c}, '{license.CLAIM}', ' ', 'g')"
        c = f"(' ' || regexp_replace({c}, '[^a-z0-9]+', ' ', 'g') || ' ')"
        for a, b in license.SPELLINGS:
            c = f"replace({c}, ' {a} ', ' {b} ')"
        return f"regexp_replace(trim({c}), ' +', ' ', 'g')"

    known = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in license.KNOWN)
    return f"""
WITH k AS (SELECT sha256({canonical("t")}) AS dg, min(i) AS id FROM (VALUES {known}) AS x(i, t) GROUP BY 1),
d AS (SELECT doc_id, row_number() OVER () AS rid, text, {canonical("text")} AS c FROM documents),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
h AS (SELECT rid, k.id FROM (SELECT rid, sha256({canonical("line")}) AS dg FROM l WHERE {canonical("line")} <> '') z JOIN k USING (dg)),
g AS (SELECT rid, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM h GROUP BY rid)
SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS license_digest, k.id AS license_id, coalesce(g.ids, '') AS line_licenses
FROM d LEFT JOIN k ON k.dg = CASE WHEN c <> '' THEN sha256(c) END LEFT JOIN g ON g.rid = d.rid
"""


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), r AS (
  SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a
), c AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, m.vec_id) AS component_id, m.vec_id IS NOT DISTINCT FROM coalesce(c.c, m.vec_id) AS kept
FROM embeddings m LEFT JOIN c ON c.id = m.vec_id LEFT JOIN n ON n.a = m.vec_id
"""


#: CRC-32 is a table of 256 remainders of its reversed polynomial, and a fold over bytes.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), d AS (
  SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
), h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x), 2), lambda i: ('0x' || x[i + 1 : i + 2])::BIGINT)), lambda a, b: xor(a // 256, t[(xor(a, b) % 256 + 1)::INT])), 4294967295) AS h
  FROM d, tab
), w AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[1 : (h % length(run))::INT] || run[(h % length(run))::INT + 2 :] ELSE run END AS word, n FROM h
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, length(word) AS l, i, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.l = b.l AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN v ON c.rest = v.word UNION SELECT v.word, c.word FROM cut c JOIN v ON c.rest = v.word
), best AS (
  SELECT near.word, count(*) AS k, min((-b.n, near.near)) AS f FROM near JOIN v b ON b.word = near.near GROUP BY near.word
), f AS (
  SELECT v.word, v.n, coalesce(k, 0) AS n_near, CASE WHEN -f[1] >= 5 * v.n THEN f[2] END AS form, CASE WHEN -f[1] >= 5 * v.n THEN -f[1] END AS form_n FROM v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM f JOIN (SELECT chain.word, root FROM chain JOIN f ON f.word = root WHERE f.form IS NULL) c ON c.word = f.word
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": OP1_SQL,
        "op2_line_dedup": OP2_SQL,
        "op3_ngram_jaccard_join": OP3_SQL,
        "op4_mix_sources": OP4_SQL,
        "op5_top_k": OP5_SQL,
        "op6_license_scan": _op6_sql(),
        "op8_embedding_dedup": OP8_SQL,
        "op12_spelling_variants": OP12_SQL,
    }
