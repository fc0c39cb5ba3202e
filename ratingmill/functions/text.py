"""Scalar functions on model output, messages and attributes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the two sides of a signed attribute
FOLLOW, AVOID = "follow", "avoid"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def parse_rating(c: Column) -> Column:
    """The last whole number from 1 to 10 in a text; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(strip(c), F.lit(r"(?U)\b(10|[1-9])\b"), F.lit(1)), F.lit(-1)).cast("int")


def split_reasoning(raw: Column) -> Column:
    """struct(reasoning, content): what stands after the marker of a final answer, or after a closed think block, is the content.

    The marker comes first; the reasoning before it starts after its eight-letter heading. Without either all is content, as it is.
    """
    final = F.instr(raw, "assistantfinal")
    opened = F.instr(raw, "<think>")
    closed = F.instr(raw, "</think>")
    by_mark = F.struct(
        strip(F.substring(raw, F.lit(9), F.greatest(final - 9, F.lit(0)))).alias("reasoning"), strip(F.substring(raw, final + 14, F.length(raw))).alias("content")
    )
    by_block = F.struct(
        strip(F.substring(raw, opened + 7, F.greatest(closed - opened - 7, F.lit(0)))).alias("reasoning"), strip(F.substring(raw, closed + 8, F.length(raw))).alias("content")
    )
    whole = F.struct(F.lit(None).cast("string").alias("reasoning"), raw.alias("content"))
    return F.when(final > 0, by_mark).when((opened > 0) & (closed > opened), by_block).otherwise(whole)


def _tag(m: Column) -> Column:
    return F.concat(F.lit("<message role='"), m["role"], F.lit("'>"), m["content"], F.lit("</message>"))


def render_messages(messages: Column) -> Column:
    """Each message as a tag on a line of its own."""
    return F.array_join(F.transform(messages, lambda m: F.concat(_tag(m), F.lit("\n"))), "")


def render_history(history: Column) -> Column:
    """Each conversation of a history in a block of its own."""
    block = lambda c: F.concat(F.lit("<conversation>\n"), render_messages(c), F.lit("</conversation>\n"))
    return F.array_join(F.transform(history, block), "")


def join_messages(messages: Column) -> Column:
    """Each message as a tag, newlines between them only."""
    return F.array_join(F.transform(messages, _tag), "\n")


def fill(template: str, **values: Column) -> Column:
    """The template with {name} replaced in one pass; what values bring in is not looked at again."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(parts)])


def style_phrase(attributes: Column) -> Column:
    """What to follow and what to avoid, a line each; a side without attributes has no line."""

    def line(head: str, side: str) -> Column:
        own = F.transform(F.filter(attributes, lambda a: a["side"] == side), lambda a: a["attribute"])
        return F.when(F.size(own) > 0, F.concat(F.lit(head), F.array_join(own, ", ")))

    return F.concat_ws("\n", line("VERY: ", FOLLOW), line("NOT AT ALL: ", AVOID))


def signed_name(attribute: Column, side: Column) -> Column:
    return F.when(side == AVOID, F.concat(F.lit("not "), attribute)).otherwise(attribute)


def encode_label(ordinal: Column, score: Column, attributes: int) -> Column:
    """One class per attribute and side; a score of zero follows."""
    return (ordinal + F.when(score >= 0, F.lit(attributes)).otherwise(0)).cast("int")


def decode_label(label: Column, attributes: int) -> Column:
    """struct(ordinal, side)."""
    side = F.when(F.floor(label / attributes) == 1, FOLLOW).otherwise(AVOID)
    return F.struct(F.pmod(label, F.lit(attributes)).cast("int").alias("ordinal"), side.alias("side"))


def persona(*parts: Column) -> Column:
    """Non-empty parts, trimmed, joined by a blank; null if there is none."""
    kept = F.filter(F.array(*[strip(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def any_prefix(c: Column, prefixes) -> Column:
    """Whether c starts with one of the prefixes; None: always."""
    if prefixes is None:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes], F.lit(False))


def display_name(key: Column, names: dict[str, str]) -> Column:
    """The key's name, or the key itself."""
    if not names:
        return key
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), key)


def file_safe(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))
