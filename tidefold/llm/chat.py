"""Chat formatting with Spark expressions only: sorted turn structs, merged neighbours, loss spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block is HEAD, escaped role, COLON, escaped texts parted by NEXT, END.
HEAD, COLON, NEXT, END = "### ", ": ", "<next/>", "</turn>\n"
#: Escapes: every backslash becomes \b, so any other code is a real escape and all can be undone one by one.
TEXT_CODES = (("###", "\\h"), ("<next/>", "\\m"), ("</turn>", "\\t"))
ROLE_CODES = (*TEXT_CODES, (":", "\\c"))
NULL_ROLE = "\\z"
#: Running sums over arrays go by chunks of this many turns, so a long conversation costs little more than its length.
CHUNK = 64


def escape(c: Column, codes=TEXT_CODES) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    for plain, code in codes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, codes=TEXT_CODES) -> Column:
    for plain, code in codes:
        c = F.replace(c, F.lit(code), F.lit(plain))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, x: total + x)


def _starts(lengths: str) -> Column:
    """Running sums before each element of an int array: sums of whole chunks, then of what precedes in the chunk."""
    return F.expr(
        f"""flatten(transform(sequence(0, (size({lengths}) - 1) div {CHUNK}), j -> transform(
              slice({lengths}, j * {CHUNK} + 1, {CHUNK}),
              (x, i) -> _before[j] + aggregate(slice({lengths}, j * {CHUNK} + 1, i), 0, (a, y) -> a + y))))"""
    )


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted string, loss_spans array<struct<start int, length int>>.

    Turns are sorted by turn, then role, then text (null turns and roles first; repeated rows stay, side by side).
    Adjacent turns of one role share a block: the runs' starts are found in the sorted array, and each run is joined
    from its slice. Null text is empty; a null role is kept apart from an empty one; rows of a null conv
    form one conversation. Spans are code points from 0 and cover each escaped text of the trained role, in order;
    nothing else, so reading them gives each such text once. No row gives no conversation. Other columns of the input
    are not read. A conversation is one row of the result and must fit a Spark string (2 GB).
    """
    piece = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = turns.select(F.col(conv).alias("_conv"), piece.alias("_t")).groupBy("_conv").agg(F.array_sort(F.collect_list("_t")).alias("_s"))

    def escaped(t: Column) -> Column:
        said = F.coalesce(escape(t["role"], ROLE_CODES), F.lit(NULL_ROLE))
        return F.struct(said.alias("role"), escape(t["text"]).alias("text"), (F.coalesce(t["role"], F.lit("")) == trained).alias("loss"))

    role_at = lambda i: F.get("_s", i)["role"]
    size = F.size("_s")

    def around(t: Column, i: Column) -> Column:
        """Lengths of what stands before and behind a turn's text."""
        first, last = (i == 0) | (role_at(i - 1) != t["role"]), (i == size - 1) | (role_at(i + 1) != t["role"])
        head = F.when(first, F.length(t["role"]) + len(HEAD) + len(COLON)).otherwise(F.lit(len(NEXT)))
        return F.struct(head.alias("head"), F.length(t["text"]).alias("text"), F.when(last, F.lit(len(END))).otherwise(F.lit(0)).alias("tail"), t["loss"].alias("loss"))

    def block(start: Column, k: Column) -> Column:
        run = F.slice("_s", start + 1, F.coalesce(F.get("_runs", k + 1), size) - start)
        return F.concat(F.lit(HEAD), role_at(start), F.lit(COLON), F.array_join(F.transform(run, lambda t: t["text"]), NEXT), F.lit(END))

    # each step reads the one before several times: as arrays of whole rows they're built once
    return (
        grouped.select("_conv", F.transform("_s", escaped).alias("_s"))
        .withColumn("_runs", F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (role_at(i - 1) != role_at(i))))
        .withColumn("_b", F.transform("_s", around))
        .withColumn("_n", F.transform("_b", lambda b: b["head"] + b["text"] + b["tail"]))
        .withColumn("_total", F.expr(f"transform(sequence(0, (size(_n) - 1) div {CHUNK}), j -> aggregate(slice(_n, j * {CHUNK} + 1, {CHUNK}), 0, (a, x) -> a + x))"))
        .withColumn("_before", F.transform("_total", lambda x, j: _sum(F.slice("_total", 1, j))))
        .withColumn("_at", _starts("_n"))
        .select(
            F.col("_conv").alias(conv),
            F.array_join(F.transform("_runs", block), "").alias("formatted"),
            F.transform(F.filter(F.arrays_zip("_b", "_at"), lambda x: x["_b"]["loss"]), lambda x: F.struct((x["_at"] + x["_b"]["head"]).alias("start"), x["_b"]["text"].alias("length"))).alias("loss_spans"),
        )
    )


def parse_chat(formatted: str = "formatted") -> Column:
    """The turns of a formatted conversation: array<struct<role string, text string>>, unescaped."""
    blocks = F.split(F.regexp_replace(formatted, r"\Q" + END + r"\E\z", ""), r"\Q" + END + r"\E", -1)

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substr(b, F.lit(len(HEAD) + 1)), COLON, 1)
        body = F.substr(b, F.length(role) + len(HEAD) + len(COLON) + 1)
        own = F.when(role != NULL_ROLE, unescape(role, ROLE_CODES))
        return F.transform(F.split(body, NEXT, -1), lambda x: F.struct(own.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), s["start"] + 1, s["length"]))), "")


def chat_digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What is read back from formatted conversations: counts and digests."""
    read = formatted.select(conv, "formatted", parse_chat().alias("_turns"), loss_text().alias("_loss"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
