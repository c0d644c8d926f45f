"""Chat formatting with a grammar round trip.

``conversation := turn*``, ``turn := <|im_start|> role \\n text <|im_end|> \\n``. Every rendered turn is parsed again;
where the parser doesn't give back the source, the turn is rendered anew with its content escaped, and parsed again.
Escaping puts one more backslash between ``<`` and ``|``, so a control string can't survive in content, and taking one
away restores any content. In roles, ``%`` and line breaks are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountscope.llm.common import let, or_empty

START, END = "<|im_start|>", "<|im_end|>"
_START_PATTERN = r"<\|im_start\|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _segments(role: Column, text: Column, learned: Column) -> Column:
    """A turn as head, text and tail; the loss mask is set on learned texts."""
    def part(value: Column, mask: Column) -> Column:
        return F.struct(value.alias("value"), mask.alias("loss"))

    no = F.lit(False)
    return F.array(part(F.concat(F.lit(START), role, F.lit("\n")), no), part(text, learned), part(F.lit(END + "\n"), no))


def joined(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["value"]), "")


def parse(formatted: Column) -> Column:
    """The turns of formatted text, ``array<struct<role, text>>``; NULL where it isn't in the grammar."""
    pieces = F.split(formatted, _START_PATTERN)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        rest = F.substring(piece, F.length(head) + 2, F.lit(2**31 - 1))
        text = F.substring_index(rest, END, 1)
        tail = F.substring(rest, F.length(text) + 1, F.lit(2**31 - 1))
        ok = (tail == END + "\n") & (F.length(head) < F.length(piece))
        return F.when(ok, F.struct(unescape_role(head).alias("role"), unescape(text).alias("text")))

    def turns(ps: Column) -> Column:
        found = F.transform(F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0))), turn)
        good = (F.get(ps, F.lit(0)) == "") & ~F.exists(found, lambda t: t.isNull())
        return F.when(good, found)

    return let(pieces, turns)


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, segments`` per row, verified by the parser. NULL role and text count as empty.

    The work is per row, so a conversation of any length is spread like any other rows.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), or_empty(role).alias("role"), or_empty(text).alias("text"))
    source = F.array(F.struct("role", "text"))
    learned = F.col("role") == LOSS_ROLE
    plain = _segments(F.col("role"), F.col("text"), learned)
    escaped = _segments(escape_role(F.col("role")), escape(F.col("text")), learned)
    # Only turns with a control character can fail to come back; all others skip the second attempt.
    first = F.coalesce(parse(joined(plain)) == source, F.lit(False))
    second = F.coalesce(parse(joined(escaped)) == source, F.lit(False))
    failed = F.raise_error(F.concat(F.lit("turn doesn't come back from its rendering: "), F.col("conv").cast("string")))
    return rows.withColumn("segments", F.when(first, plain).when(second, escaped).otherwise(failed.cast(rows.select(plain).schema[0].dataType)))


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, formatted, segments``: one row per conversation, turns in order.

    Equal turn numbers are ordered by role, then text; NULL numbers come first; NULL conversation ids are one
    conversation. Joined segments are the formatted text; those with ``loss`` are what is learned. A conversation is
    one value here; ``render`` is the form that keeps a huge one spread.
    """
    rows = render(turns, conv, turn, role, text)
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "segments")))
    grouped = rows.groupBy("conv").agg(ordered.alias("turns"))
    out = grouped.select("conv", F.flatten(F.transform("turns", lambda t: t["segments"])).alias("segments"))
    return out.select(F.col("conv").alias(conv), joined(F.col("segments")).alias("formatted"), "segments")


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted text gives back: turns by the parser, learned text by the loss mask. Text that has no turns is an error."""
    def learned(segments: Column) -> Column:
        return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["value"])), "")

    parsed = parse(F.col("formatted"))
    failed = F.raise_error(F.concat(F.lit("not a formatted conversation: "), F.coalesce(F.col(conv).cast("string"), F.lit("NULL"))))
    read = formatted.select(conv, F.length("formatted").cast("bigint").alias("formatted_chars"), parsed.alias("turns"),
                            learned(F.col("segments")).alias("learned"))
    read = read.withColumn("turns", F.coalesce("turns", failed.cast(read.schema["turns"].dataType)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv, F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
