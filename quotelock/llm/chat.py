"""Chat formatting with relational expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of one role
become one block, and the blocks are joined to a training text. The text is kept as
pieces with a loss flag; joined, they are the formatted conversation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around blocks. A role without marks of its own is written into ``other``.

    No mark may contain another one or the escape character.
    """

    roles: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>"),
            "user": ("[INST]", "[/INST]"),
            "assistant": ("<s>", "</s>"),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    following: str = "[NEXT]"
    loss_roles: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> list[str]:
        return [*(mark for pair in self.roles.values() for mark in pair), *self.other, self.following]


def escape(text: Column, template: ChatTemplate) -> Column:
    """Break every mark inside ``text`` after its first character; reversible."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for mark in template.marks:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + ESCAPE + mark[1:]))
    return out


def unescape(text: Column, template: ChatTemplate) -> Column:
    out = text
    for mark in template.marks:
        out = F.replace(out, F.lit(mark[0] + ESCAPE + mark[1:]), F.lit(mark))
    return F.replace(out, F.lit(ESCAPE * 2), F.lit(ESCAPE))


def _opening(role: Column, template: ChatTemplate) -> Column:
    out = F.concat(F.lit(template.other[0]), escape(role, template), F.lit(template.other[1]))
    for name, (opening, _) in template.roles.items():
        out = F.when(role == name, F.lit(opening)).otherwise(out)
    return out


def _closing(role: Column, template: ChatTemplate) -> Column:
    out = F.lit(template.other[2])
    for name, (_, closing) in template.roles.items():
        out = F.when(role == name, F.lit(closing)).otherwise(out)
    return out


def merged_blocks(turns: Column) -> Column:
    """Adjacent turns of one role as ``array<struct<role, texts>>``, in linear time."""
    starts = F.filter(
        F.sequence(F.lit(1), F.size(turns)),
        lambda i: (i == 1) | (F.get(turns, i - 2)["role"] != F.get(turns, i - 1)["role"]),
    )
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns) + 1))
    return F.transform(
        F.arrays_zip(starts.alias("start"), ends.alias("end")),
        lambda span: F.struct(
            F.get(turns, span["start"] - 1)["role"].alias("role"),
            F.transform(
                F.slice(turns, span["start"], span["end"] - span["start"]), lambda turn: turn["text"]
            ).alias("texts"),
        ),
    )


def format_chats(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: key, ``pieces`` (text, loss) and ``formatted``.

    NULL role and NULL text count as empty, a NULL key is a conversation of its own. Turns
    are ordered by (order, role, text), NULL order first; repeated rows are all kept. An
    empty table gives no rows, and other columns are ignored. A conversation is one output
    value, so it must fit a row; Spark combines no further than that.
    """
    template = template or ChatTemplate()
    turn = F.struct(
        F.col(order).alias("order"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    collected = turns.groupBy(F.col(key).alias(key)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = collected.select(key, merged_blocks(F.col("turns")).alias("blocks"))

    def block_pieces(block: Column) -> Column:
        loss = block["role"].isin(*template.loss_roles)
        plain = lambda value: F.array(F.struct(value.alias("text"), F.lit(False).alias("loss")))
        texts = F.flatten(
            F.transform(
                block["texts"],
                lambda value, at: F.array(
                    F.struct(
                        F.when(at > 0, F.lit(template.following)).otherwise(F.lit("")).alias("text"),
                        F.lit(False).alias("loss"),
                    ),
                    F.struct(escape(value, template).alias("text"), loss.alias("loss")),
                ),
            )
        )
        return F.concat(plain(_opening(block["role"], template)), texts, plain(_closing(block["role"], template)))

    pieces = blocks.select(
        key,
        F.filter(
            F.flatten(F.transform("blocks", block_pieces)), lambda piece: piece["loss"] | (piece["text"] != "")
        ).alias("pieces"),
    )
    return pieces.withColumn("formatted", F.array_join(F.transform("pieces", lambda piece: piece["text"]), ""))


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns of a formatted conversation, as ``array<struct<role, text>>``."""
    template = template or ChatTemplate()
    shapes = [f"{re.escape(a)}.*?{re.escape(b)}" for a, b in template.roles.values()]
    shapes.append(f"{re.escape(template.other[0])}.*?{re.escape(template.other[2])}")
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(shapes)), F.lit(0))

    def read_block(block: Column) -> Column:
        opening, middle, closing = template.other
        role = unescape(
            F.substring(F.substring_index(block, middle, 1), F.lit(len(opening) + 1), F.char_length(block)), template
        )
        body = F.substring(
            block,
            F.char_length(F.substring_index(block, middle, 1)) + len(middle) + 1,
            F.char_length(block),
        )
        body = F.substring(body, F.lit(1), F.char_length(body) - len(closing))
        for name, (start, end) in template.roles.items():
            own = F.startswith(block, F.lit(start))
            role = F.when(own, F.lit(name)).otherwise(role)
            inner = F.substring(block, F.lit(len(start) + 1), F.char_length(block) - len(start) - len(end))
            body = F.when(own, inner).otherwise(body)
        return F.transform(
            F.split(body, re.escape(template.following), -1),
            lambda value: F.struct(role.alias("role"), unescape(value, template).alias("text")),
        )

    return F.flatten(F.transform(found, read_block))


def read_loss(pieces: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, in order, unescaped."""
    template = template or ChatTemplate()
    return F.array_join(
        F.transform(F.filter(pieces, lambda piece: piece["loss"]), lambda piece: unescape(piece["text"], template)),
        "",
    )
