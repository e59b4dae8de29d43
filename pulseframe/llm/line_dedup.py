"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its distinct tokens, which are runs of five words; a line of fewer words has one token, all
of it. Two lines match when the Jaccard similarity of their sets is 0.75 or more; the first tokens of each in one order, as
many as the prefix filter needs, are the keys of the join; length and position filter candidates, and whole sets
verify them. Any order of the tokens finds the same matches, so that the first order is that of their hashes, which needs no count.
Matches that it gives only by keys of more than FEW lines are between lines that both have such a key: these lines, and
no others, are joined once more in the order of rarity, counted over them in hash buckets whose number grows with the text, then
by hash. Buckets that tokens share cost time only.
A line goes when an earlier one matches, in the order of doc_id, a hash of the text, and line number.

Equal sets are one line to the join: two independent hashes of the sorted 64-bit tokens tell them apart, and of the
words themselves where a set is one token. Candidates come in two steps, so that a group of many like lines doesn't meet in
all pairs: in each list the earliest line meets the others; then lines that nothing has removed meet the rest.

Defined results: lines without words stay and match nothing; a null text stays null; a document all of whose
lines with words go is dropped, as it repeats others whole; documents without such lines stay; rows that repeat
doc_id and text are one document, whose lines don't remove one another, and each row gets the same result; null ids
are least; an empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Scratch, semi_by_key, without

#: Words in a token.
WORDS = 5
#: Similarity as a fraction: matching when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Bits of the number of buckets that count tokens: one bucket for so many bytes of input, within these bounds (32 MB at most).
BYTES_A_BUCKET, LEAST_BITS, MOST_BITS = 16384, 16, 22
#: Numbers of lines, over all documents, up to which those that go are broadcast to their documents (8 MB).
BROADCAST_LINES = 2_000_000
#: Lines of a key in the order of hashes; those of a longer list are joined in the order of rarity.
FEW = 16
#: Bits of a token's hash in its sort key, behind the class of its count.
HASH_BITS = 54
#: Spaces other than the plain one, which most texts don't have.
RARE_SPACES = "\t\x0b\x0c\r"


def words_of(line: Column) -> Column:
    """The words of a trimmed line: splitting at one plain space needs no pattern, and what is empty between several goes."""
    rare = F.contains(line, F.lit(RARE_SPACES[0]))
    for c in RARE_SPACES[1:]:
        rare = rare | F.contains(line, F.lit(c))
    plain = F.when(rare, F.translate(line, RARE_SPACES, " " * len(RARE_SPACES))).otherwise(line)
    return F.array_remove(F.split(plain, " ", -1), "")


def trimmed(line: Column) -> Column:
    """Without spaces of all kinds at both ends. Trimming the plain one looks at the ends alone; trimming by a list of characters goes through the whole line, and is left to lines that need it."""
    plain = F.trim(line)
    rare = F.lit(False)
    for c in RARE_SPACES:
        rare = rare | F.startswith(plain, F.lit(c)) | F.endswith(plain, F.lit(c))
    return F.when(rare, F.btrim(plain, F.lit(" " + RARE_SPACES))).otherwise(plain)


def raw_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, thash, ln, line): the trimmed lines that have words."""
    hashed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("thash"), F.col(text_col).alias("text"))  # once a text, not once a line
    lines = hashed.select("doc", "thash", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    return lines.withColumn("line", trimmed(F.col("line"))).where("line <> ''")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, thash, ln, words): the lines that have words."""
    return raw_lines(docs, id_col, text_col).select("doc", "thash", "ln", words_of(F.col("line")).alias("words"))


def _token(words: Column, i: Column, run: int) -> Column:
    """The hash of the run of words from i; a null beyond the end adds nothing, and i is 0 then."""
    return F.xxhash64(*[F.get(words, i + k) for k in range(run)])


def last_run(words: Column, run: int = WORDS) -> Column:
    return F.greatest(F.size(words) - run, F.lit(0))


def tokens(words: Column, run: int = WORDS) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last_run(words, run)), lambda i: _token(words, i, run)))


def count_class(n: Column) -> Column:
    """Rises with a count, by 8 to a doubling; below 512 for every long, so that none is capped and the key behind it stays positive."""
    return F.floor(8 * F.log2(n.cast("double"))).cast("int")


def rarity(docs: DataFrame, text_col: str, lines: DataFrame, run: int = WORDS) -> tuple[int, Column]:
    """(bits, array<int>): the class of the occurrences of each bucket's tokens. The table is put together in one row of text, of some four bytes a bucket."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # as Catalyst knows it, without a scan
    if size > 1 << 50:  # it doesn't know
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_A_BUCKET).bit_length()))
    runs = lines.select("words", F.explode(F.sequence(F.lit(0), last_run(F.col("words"), run))).alias("i"))
    counts = runs.groupBy(_bucket(_token(F.col("words"), F.col("i"), run), bits).alias("bucket")).agg(count_class(F.count("*")).alias("c"))
    return bits, class_table(counts, bits)


def class_table(counts: DataFrame, bits: int) -> Column:
    """array<int> by bucket of (bucket, c); 0 where a bucket has none."""
    every = counts.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("c", F.lit(0)).alias("c")))), lambda x: x["c"].cast("string"))
    text = every.agg(F.array_join(listed, ",").alias("t")).first()["t"]
    return F.from_json(F.lit(f"[{text}]"), "array<int>")


def _bucket(token: Column, bits: int) -> Column:
    return F.shiftrightunsigned(token, 64 - bits).cast("int")


def _sets(lines: DataFrame, run: int) -> DataFrame:
    """(doc, thash, ln, s1, s2, set): the line's set of whole tokens in order, and two hashes of it."""
    words = F.col("words")
    whole = lines.select("doc", "thash", "ln", F.sort_array(tokens(words, run)).alias("set"), F.xxhash64(F.lit(2), F.slice(words, 1, run)).alias("head"))
    one = F.size("set") == 1
    return whole.select("doc", "thash", "ln", F.xxhash64("set").alias("s1"), F.when(one, F.col("head")).otherwise(F.xxhash64(F.lit(1), "set")).alias("s2"), "set")


def _prefix(keys: str) -> tuple[Column, Column]:
    n = F.size(keys)
    return n.alias("n"), F.slice(keys, F.lit(1), n - F.ceil(n * F.lit(NUM / DEN)).cast("int") + 1).alias("prefix")


def hash_prefixed(lines: DataFrame, run: int = WORDS) -> DataFrame:
    """(doc, thash, ln, s1, s2, n, prefix): two hashes of the line's set of whole tokens, its size, and its first tokens in the order of hashes."""
    return _sets(lines, run).select("doc", "thash", "ln", "s1", "s2", *_prefix("set"))


def prefixed(lines: DataFrame, bits: int, classes: Column, run: int = WORDS) -> DataFrame:
    """(doc, thash, ln, s1, s2, n, prefix): as hash_prefixed, with the keys of the line's rarest tokens, rarest first."""
    hashed = F.lit((1 << HASH_BITS) - 1)
    key = lambda t: F.shiftleft(F.coalesce(F.get(classes, _bucket(t, bits)), F.lit(0)).cast("long"), HASH_BITS).bitwiseOR(t.bitwiseAND(hashed))
    keyed = _sets(lines, run).select("doc", "thash", "ln", "s1", "s2", F.sort_array(F.transform("set", key)).alias("keys"))
    return keyed.select("doc", "thash", "ln", "s1", "s2", *_prefix("keys"))


def _entries(sets: DataFrame) -> DataFrame:
    """(s1, n, pos, t, m) of (s1, n, prefix): the entries of lists of two lines at least, and the list's length, counted where the entries of a key meet anyway."""
    posted = sets.select("s1", "n", F.posexplode("prefix").alias("pos", "t"))
    return posted.withColumn("m", F.expr("count(*) over (partition by t)")).where("m > 1")


def _filters(x: str, y: str) -> Column:
    """Length and positional filters for entries of one list."""
    c = lambda t, k: F.col(f"{t}.{k}")
    both = c(x, "n") + c(y, "n")
    length = F.least(c(x, "n"), c(y, "n")) * DEN >= F.greatest(c(x, "n"), c(y, "n")) * NUM
    return length & ((1 + F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos"))) * (NUM + DEN) >= both * NUM)


def _first_lines(docs: DataFrame, ids: DataFrame, wanted: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(s1, s2, first, words) of the wanted sets (s1), from the first line of each. Documents without such a line are left out before any is taken apart.

    docs: (id, text); ids: (s1, s2, .., first) with the place of each set's first line.
    """
    id_col, text_col = docs.columns
    wanted = scratch.save(wanted.distinct(), f"{tag}-wanted")
    where = scratch.save(semi_by_key(ids.select("s1", "s2", "first.*"), wanted, ["s1"]), f"{tag}-where")
    some = semi_by_key(docs.where(F.col(id_col).isNotNull()), where.select(F.col("doc").alias(id_col)).distinct(), [id_col])
    lines = raw_lines(some.unionByName(docs.where(F.col(id_col).isNull())), id_col, text_col)
    small = where.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    where = where.select("s1", "s2", F.struct("doc", "thash", "ln").alias("first"))
    on = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("thash") == F.col("first.thash")) & (F.col("ln") == F.col("first.ln"))
    return lines.join(F.broadcast(where) if small else where, on).select("s1", "s2", "first", words_of(F.col("line")).alias("words"))


def _whole_sets(docs: DataFrame, ids: DataFrame, pairs: DataFrame, scratch: Scratch, tag: str, run: int) -> DataFrame:
    """(s1, s2, first, s) of the sets in pairs."""
    found = _first_lines(docs, ids, pairs.select(F.col("x").alias("s1")).union(pairs.select("y")), scratch, tag)
    return scratch.save(found.select("s1", "s2", "first", tokens(F.col("words"), run).alias("s")), f"{tag}-sets", tidy=True)


def _busy_entries(docs: DataFrame, ids: DataFrame, entries: DataFrame, scratch: Scratch, run: int) -> DataFrame:
    """Entries, in the order of rarity, of the sets that have a key of more than FEW lines in the order of hashes."""
    busy = _first_lines(docs, ids, entries.where(F.col("m") > FEW).select("s1"), scratch, "busy")
    lines = scratch.save(busy.select("first.*", "words"), "busy-lines", tidy=True)
    sets = prefixed(lines, *rarity(docs, docs.columns[1], lines, run), run)
    return scratch.save(_entries(sets.dropDuplicates(["s1", "s2", "n"])), "busy-entries", tidy=True)


def _matching(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(s1, s2) of the later sets of pairs whose whole sets match; first says again which is later, for sets that share s1."""
    x = sets.select(F.col("s1").alias("x"), F.col("first").alias("first_x"), F.col("s").alias("sx"))
    met = pairs.join(x, "x").join(sets.withColumnRenamed("s1", "y"), "y").where("first_x < first")
    common = F.size(F.array_intersect("sx", "s"))
    return met.where(common * DEN >= (F.size("sx") + F.size("s") - common) * NUM).select(F.col("y").alias("s1"), "s2").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = WORDS) -> DataFrame:
    """(doc, thash, lns): the numbers of the lines that go, by text. run: words in a token."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    docs = docs.select(id_col, text_col)
    lines = lines_of(docs, id_col, text_col)
    found = scratch.save(hash_prefixed(lines, run), "found")
    at = F.struct("doc", "thash", "ln")
    distinct = scratch.save(found.groupBy("s1", "s2", "n").agg(F.min(at).alias("first"), F.count("*").alias("copies"), F.any_value("prefix").alias("prefix")), "distinct", tidy=True)
    line_sets = scratch.save(found.drop("prefix"), "lines")
    scratch.drop("found")
    entries = scratch.save(_entries(distinct), "entries", tidy=True)
    ids = scratch.save(distinct.select("s1", "s2", "n", "first", "copies"), "ids")
    scratch.drop("distinct")
    lists = entries.where(F.col("m") <= FEW)
    if not entries.where(F.col("m") > FEW).isEmpty():
        lists = lists.unionByName(_busy_entries(docs, ids, entries, scratch, run))
    lists = scratch.save(lists.drop("m").join(ids.select("s1", "first"), "s1"), "lists", tidy=True)
    first = F.min(F.struct("first", "s1", "n", "pos")).alias("h")
    heads = lists.groupBy("t").agg(first).select("t", F.col("h.s1").alias("s1"), F.col("h.n").alias("n"), F.col("h.pos").alias("pos"))
    stars = lists.alias("y").join(heads.alias("x"), "t").where("x.s1 <> y.s1").where(_filters("x", "y")).select(F.col("x.s1").alias("x"), F.col("y.s1").alias("y"))
    stars = scratch.save(stars.distinct(), "stars")
    gone = scratch.save(_matching(stars, _whole_sets(docs, ids, stars, scratch, "star", run)), "gone", tidy=True)
    scratch.drop("star-sets")
    clear = ids.join(gone, ["s1", "s2"], "left_anti").select("s1").distinct()
    open_ = lists.join(clear, "s1", "left_semi")
    rest = open_.alias("y").join(lists.alias("x"), "t").where("x.first < y.first").where(_filters("x", "y")).select(F.col("x.s1").alias("x"), F.col("y.s1").alias("y"))
    rest = scratch.save(rest.distinct().join(stars, ["x", "y"], "left_anti"), "rest", tidy=True)
    more = scratch.save(_matching(rest, _whole_sets(docs, ids, rest, scratch, "rest", run)), "more", tidy=True)
    matched = gone.union(more).distinct().withColumn("gone", F.lit(True))
    # a set's later lines go, and its first one if an earlier set matches
    named = scratch.save(ids.join(matched, ["s1", "s2"], "left").where("copies > 1 or gone").select("s1", "s2", "n", "first", "gone"), "named")
    out = line_sets.select("doc", "thash", "ln", "s1", "s2", "n").join(named, ["s1", "s2", "n"])
    out = scratch.save(out.where(F.col("gone").isNotNull() | (at > F.col("first"))).select("doc", "thash", "ln").distinct().groupBy("doc", "thash").agg(F.collect_set("ln").alias("lns")), "removed")
    for name in ("lines", "named", "entries", "lists", "ids", "stars", "rest", "rest-sets", "gone", "more", "busy-lines", "busy-entries", *[f"{t}-{n}" for t in ("star", "rest", "busy") for n in ("wanted", "where")]):
        scratch.drop(name)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", run: int = WORDS) -> DataFrame:
    """docs with the lines that repeat earlier ones taken out, and n_removed, how many those are; n_chars, if there is one, is counted anew."""
    docs = without(docs, "n_removed")
    gone = repeated_lines(docs, id_col, text_col, run).select(F.col("doc").alias("__pf_doc"), F.col("thash").alias("__pf_of"), F.col("lns").alias("__pf_lns"))  # lines of one text
    size = gone.agg(F.count("*").alias("n"), F.sum(F.size("__pf_lns")).alias("lines")).first()
    if size["n"] <= BROADCAST_KEYS and (size["lines"] or 0) <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    keyed = docs.withColumn("__pf_thash", F.xxhash64(text_col))
    met = keyed.join(gone, F.col(id_col).eqNullSafe(F.col("__pf_doc")) & (F.col("__pf_thash") == F.col("__pf_of")), "left")
    lns = F.col("__pf_lns")
    some = lns.isNotNull()
    kept = F.filter(F.split(text_col, "\n", -1), lambda line, i: ~F.array_contains(lns, i))
    met = met.withColumn("__pf_kept", F.when(some, kept)).where(~some | F.exists("__pf_kept", lambda x: F.btrim(x, F.lit(" " + RARE_SPACES)) != ""))
    met = met.withColumn("n_removed", F.coalesce(F.size(lns), F.lit(0)).cast("long"))
    met = met.withColumn(text_col, F.when(some, F.array_join("__pf_kept", "\n")).otherwise(F.col(text_col)))
    if n_chars_col in docs.columns:
        met = met.withColumn(n_chars_col, F.when(some, F.length(text_col).cast("long")).otherwise(F.col(n_chars_col)))
    return met.select(*[f"`{c}`" for c in docs.columns], "n_removed")
