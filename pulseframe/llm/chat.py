"""Chat formatting by a grammar round trip, in DataFrame functions only.

Grammar:  conversation := turn*    turn := "### " role ": " body "</turn>\\n"
A body is plain, or escaped at the first level at which parsing the turn again gives back the source:
0 as it is, 1 with backslashes and control strings escaped, 2 with every `\\`, `<` and `#` escaped.
An escape is a backslash and one letter: `\\s` for `\\`, `\\l` for `<`, `\\h` for `#`, `\\c` for `:`,
`\\n` for a line feed in a role. The parser refuses a body that holds "###" or "</turn>", and undoes escapes.
The whole conversation is parsed again too, and its turns must equal the source's, or the query fails.

Defined results: null texts and roles count as empty; turns are ordered by turn, then role, then text,
null turns first; repeated rows are turns of their own; rows without a conv_id form one conversation;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "###", "</turn>"


def _chain(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(body: Column, level: int) -> Column:
    if level == 0:
        return body
    c = _chain(body, ("\\", "\\s"))
    return _chain(c, (CLOSE, "\\l/turn>"), (OPEN, "\\h\\h\\h")) if level == 1 else _chain(c, ("<", "\\l"), ("#", "\\h"))


def unescape(body: Column) -> Column:
    return _chain(body, ("\\l", "<"), ("\\h", "#"), ("\\s", "\\"))


def escape_role(role: Column) -> Column:
    return _chain(escape(role, 2), (":", "\\c"), ("\n", "\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(_chain(role, ("\\c", ":"), ("\\n", "\n")))


def reparsed(body: Column) -> Column:
    """The source that the parser reads from a rendered body; null where it refuses it."""
    return F.when(~F.contains(body, F.lit(OPEN)) & ~F.contains(body, F.lit(CLOSE)), unescape(body))


def conflict_free(text: Column) -> Column:
    """The text at the first level whose round trip is identical."""
    tries = [escape(text, k) for k in (0, 1, 2)]
    return F.coalesce(*[F.when(reparsed(t) == text, t) for t in tries], F.raise_error(F.lit("a turn can't be rendered reversibly")))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) of rows (conv_id, turn, role, text): one row for each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    shown = rows.select("conv_id", F.struct("turn", "role", "text", F.concat(F.lit(OPEN + " "), escape_role(F.col("role")), F.lit(": "), conflict_free(F.col("text")), F.lit(CLOSE + "\n")).alias("shown")).alias("t"))
    whole = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("_source"))
    whole = whole.select("conv_id", F.array_join(F.transform("_source", lambda t: t["shown"]), "").alias("formatted"), "_source")
    said = lambda turns: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    same = said(_pieces(F.col("formatted"))) == said(F.col("_source"))
    return whole.select("conv_id", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation can't be rendered reversibly"))).alias("formatted"))


def _pieces(formatted: Column) -> Column:
    """array<struct<role, text, head, length>>: what each turn says, the characters before its body, and those of its body."""
    head = len(OPEN) + 1
    # after the last separator comes an empty piece
    parts = F.split(formatted, F.lit(CLOSE + "\n"), F.lit(-1))

    def one(p: Column) -> Column:
        colon = F.locate(": ", p)
        body = F.substr(p, colon + 2)
        return F.struct(
            unescape_role(F.substr(p, F.lit(head + 1), colon - F.lit(head + 1))).alias("role"),
            reparsed(body).alias("text"),
            (colon + 1).alias("head"),
            F.length(body).alias("length"),
        )

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), one)


#: Turns whose places are summed in one list, before those of the next ones; keeps long conversations from copying a list a turn.
RUN = 256


def _starts(turns: Column) -> Column:
    """array<int>: where each turn's body begins. Sums run within runs of turns, then over the runs."""
    tail = len(CLOSE) + 1
    none = F.expr("cast(array() as array<int>)")
    size = lambda t: t["head"] + t["length"] + F.lit(tail)
    start = F.struct(F.lit(0).alias("at"), none.alias("starts"))

    def within(run: Column) -> Column:
        step = lambda acc, t: F.struct((acc["at"] + size(t)).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + t["head"])).alias("starts"))
        return F.aggregate(run, start, step)

    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(turns) / RUN).cast("int") - 1, F.lit(0))), lambda i: within(F.slice(turns, i * RUN + 1, F.lit(RUN))))
    before = F.aggregate(runs, start, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
    return F.flatten(F.zip_with(runs, before, lambda r, b: F.transform(r["starts"], lambda s: s + b)))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Adds turns array<struct<role, text, start, length>>; start and length say where the rendered body stands, in characters from 0."""
    read = formatted.withColumn("_read", _pieces(F.col("formatted"))).withColumn("_starts", _starts(F.col("_read")))
    whole = F.zip_with("_read", "_starts", lambda t, s: F.struct(t["role"].alias("role"), t["text"].alias("text"), s.alias("start"), t["length"].alias("length")))
    return read.withColumn("turns", whole).drop("_read", "_starts")


def loss_spans(parsed: DataFrame, role: str = "assistant") -> DataFrame:
    """Adds loss_spans array<struct<start, length>>: the rendered bodies of one role's turns, which alone count in the loss."""
    return parsed.withColumn("loss_spans", F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))))


def digests(masked: DataFrame) -> DataFrame:
    """What a formatted string says, read back from it and its loss spans alone."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return masked.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
