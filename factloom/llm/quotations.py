"""Quotation linking: messages that quote others become reply-ordered conversations.

A line's quote level is the number of ``>`` it begins with. Lines of one level that
follow each other are a passage; passages are normalised, hashed, and joined to the
messages whose own text (or a paragraph, line, or run of lines of it) has that hash; a
passage without such a message goes by its own paragraphs and lines. The first message
of the conversation with the passage is its original. The original of a message's
outermost quote is its parent; parents give each message its thread and depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.llm.common import BLANKS, ascii_lower, joined
from factloom.staging import stage

MARKS = r"^((?:\x20{0,3}>)+\x20?)"
# A line that only says who wrote what follows.
ATTRIBUTION = r"^On .* wrote:\s*$"


def normalised(text: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    spaced = F.translate(ascii_lower(text), BLANKS, " " * len(BLANKS))
    return F.trim(F.regexp_replace(spaced, " +", " "))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(normalised(text)))


def levelled(text: Column) -> Column:
    """``array<struct<level, line>>``: each line without its quote marks."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 1)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(level.alias("level"), F.substring(line, F.length(marks) + 1, F.length(line)).alias("line"))

    return F.transform(F.split(text, "\n", -1), one)


def passages(lines: Column) -> Column:
    """``array<struct<level, text>>`` of the quoted passages, in order."""

    def begins(line: Column, k: Column) -> Column:
        return F.coalesce(F.get(lines, k - 1)["level"] != line["level"], F.lit(True))

    places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda k: begins(F.get(lines, k), k))

    def cut(starts: Column) -> Column:
        def one(k: Column, i: Column) -> Column:
            upto = F.coalesce(F.get(starts, i + 1), F.size(lines))
            part = F.slice(lines, k + 1, upto - k)
            return F.struct(
                F.get(lines, k)["level"].alias("level"),
                F.array_join(F.transform(part, lambda x: x["line"]), "\n").alias("text"),
            )

        return F.filter(F.transform(starts, one), lambda p: p["level"] > 0)

    return let(places, cut)


def own_text(lines: Column) -> Column:
    """What is not quoted, without attributions and without blank lines at the ends."""
    own = F.filter(lines, lambda x: (x["level"] == 0) & ~F.rlike(x["line"], F.lit(ATTRIBUTION)))
    text = F.array_join(F.transform(own, lambda x: x["line"]), "\n")
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def parsed(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``own`` and ``_passages`` of the messages."""
    return messages.select(
        "conv_id",
        "turn",
        "role",
        let(
            levelled(F.coalesce(F.col("text"), F.lit(""))),
            lambda lines: F.struct(own_text(lines).alias("own"), passages(lines).alias("passages")),
        ).alias("_p"),
    ).select("conv_id", "turn", "role", F.col("_p.own").alias("own"), F.col("_p.passages").alias("_passages"))


def full_lines(text: Column) -> Column:
    """The lines of a text that are not blank, normalised."""
    return F.filter(F.transform(F.split(text, "\n", -1), normalised), lambda x: x != "")


def pieces(text: Column) -> Column:
    """Hashes of the paragraphs and lines of a text."""
    paragraphs = F.transform(F.split(text, r"\n\x20*\n"), digest)
    return F.array_distinct(F.concat(paragraphs, F.transform(F.split(text, "\n"), digest)))


def runs(messages: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(conv_id, turn, _hash)`` of all runs of lines that are as long as a quotation of
    the conversation: ``lengths`` has (``conv_id``, ``_lengths``)."""
    lines = messages.select("conv_id", "turn", full_lines(F.col("own")).alias("_lines"))
    rows = joined(lines.filter(F.size("_lines") > 1), lengths, ["conv_id"])
    rows = rows.select("conv_id", "turn", "_lines", F.explode("_lengths").alias("_n"))
    run = F.transform(
        F.sequence(F.lit(1), F.size("_lines") - F.col("_n") + 1),
        lambda k: F.unhex(F.md5(F.array_join(F.slice("_lines", k, F.col("_n")), " "))),
    )
    rows = rows.filter(F.col("_n") <= F.size("_lines"))
    return rows.select("conv_id", "turn", F.explode(F.array_distinct(run)).alias("_hash"))


def originals(messages: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(conv_id, _hash, _original)``: the first turn that has a text, paragraph, line,
    or run of lines of one of the ``lengths``."""
    whole = F.array(digest(F.col("own")))
    held = messages.filter("own <> ''")
    rows = held.select(
        "conv_id",
        "turn",
        F.explode(F.array_distinct(F.concat(whole, pieces(F.col("own"))))).alias("_hash"),
    ).unionAll(runs(held, lengths))
    return rows.filter(F.col("_hash") != digest(F.lit(""))).groupBy("conv_id", "_hash").agg(
        F.min("turn").alias("_original")
    )


def linked(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, n_linked, parent_turn)`` of the messages with a linked quote.

    A passage that nobody wrote as it stands is linked by its paragraphs and lines.
    """
    quotes = messages.select("conv_id", "turn", F.posexplode("_passages").alias("_at", "_q"))
    text = F.col("_q.text")
    lengths = quotes.select("conv_id", F.size(full_lines(text)).alias("_n")).filter("_n > 1")
    lengths = stage(lengths.groupBy("conv_id").agg(F.collect_set("_n").alias("_lengths")), "lengths")
    parts = F.transform(pieces(text), lambda h: F.struct(F.lit(1).alias("rank"), h.alias("hash")))
    whole = F.array(F.struct(F.lit(0).alias("rank"), digest(text).alias("hash")))
    quotes = quotes.select(
        "conv_id", "turn", "_at", F.col("_q.level").alias("_level"), digest(text).alias("_whole"),
        F.explode(F.concat(whole, parts)).alias("_p"),
    ).select("conv_id", "turn", "_at", "_level", "_whole", F.col("_p.rank").alias("_rank"), F.col("_p.hash").alias("_hash"))
    quotes = quotes.filter(F.col("_hash") != digest(F.lit("")))
    found = quotes.join(originals(messages, lengths), ["conv_id", "_hash"]).filter("_original < turn")
    found = found.groupBy("conv_id", "turn", "_at", "_level", "_whole").agg(
        F.min(F.struct("_rank", -F.col("_original"))).getField("col2").alias("_late")
    )
    # The outermost quote, and of several the latest original.
    return found.groupBy("conv_id", "turn").agg(
        F.countDistinct("_level", "_whole").alias("n_linked"),
        F.min(F.struct("_level", "_late")).alias("_best"),
    ).select("conv_id", "turn", "n_linked", (-F.col("_best").getField("_late")).alias("parent_turn"))


def threads(links: DataFrame) -> DataFrame:
    """``(conv_id, turn, root_turn, depth)`` of the messages with a parent.

    Every message jumps to where its parent has got; the jumps double, so a thread of
    any depth takes the logarithm of its depth in rounds.
    """
    at = stage(links.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")), "threads")
    while True:
        on = at.select(
            "conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("_next"), F.col("depth").alias("_more")
        )
        step = at.join(on, ["conv_id", "root_turn"], "left")
        step = stage(
            step.select(
                "conv_id", "turn", F.coalesce("_next", "root_turn").alias("root_turn"),
                (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"),
                F.col("_next").isNotNull().alias("_moved"),
            ),
            "threads",
        )
        at = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            return at


def link_quotations(messages: DataFrame) -> DataFrame:
    """Reply-ordered conversations: one row per message, sorted by conversation, thread,
    depth and turn.

    ``conv_id``, ``turn``, ``role``, ``n_quotes`` (passages), ``n_linked`` (different
    passages with an original), ``parent_turn`` (null without one), ``root_turn``,
    ``depth`` and ``own`` (the text without quotes). Null and empty texts have no quotes
    and nothing to be quoted; messages with a null conversation or turn are never linked;
    a passage that several messages have comes from the first of them; rows that repeat
    a conversation and turn share their links; other columns are not looked at; an
    empty table gives an empty result.
    """
    messages = stage(parsed(messages), "messages")
    links = stage(linked(messages), "links")
    rows = messages.join(links, ["conv_id", "turn"], "left").join(
        threads(links), ["conv_id", "turn"], "left"
    )
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        F.size("_passages").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "own",
    )
    return rows.orderBy("conv_id", "root_turn", "depth", "turn")


def as_mail(messages: DataFrame) -> DataFrame:
    """Conversations the way mail shows them: each message quotes the one before it, and
    from the third on also what that one quoted, one level deeper."""

    def before(steps: int, name: str) -> DataFrame:
        return messages.select(
            "conv_id", (F.col("turn") + steps).alias("turn"), F.col("text").alias(name)
        )

    def quoted(text: str, mark: str) -> Column:
        return F.regexp_replace(F.col(text), r"(?m)^", mark)

    rows = messages.join(before(1, "_one"), ["conv_id", "turn"], "left")
    rows = rows.join(before(2, "_two"), ["conv_id", "turn"], "left")
    text = F.concat_ws("\n", quoted("_two", ">> "), quoted("_one", "> "), F.col("text"))
    return rows.select("conv_id", "turn", "role", text.alias("text"))
