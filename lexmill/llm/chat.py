"""Chat formatting: a declarative template, a state machine over roles, loss flags per segment. Native columns only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``open + role + mid`` before each text and ``close`` after it; control strings are escaped in texts.

    An escape is a backslash and one letter; a backslash itself is doubled. ``moves`` lists what role
    may follow in which state, as ``state>role: next state``.
    """

    open: str = "### "
    mid: str = ":\n"
    close: str = "</turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("###", "\\h"), ("</turn>", "\\t"))
    role_escapes: tuple[tuple[str, str], ...] = (("\n", "\\n"),)
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, str] = field(default_factory=lambda: {
        "start>system": "system", "start>user": "user", "system>user": "user", "user>assistant": "assistant", "assistant>user": "user"})
    accept: tuple[str, ...] = ("assistant", "user")


def escape(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, mark in pairs:
        c = F.replace(c, F.lit(raw), F.lit(mark))
    return c


def unescape(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Pieces between doubled backslashes hold only marks, so each can be read on its own."""

    def piece(p: Column) -> Column:
        for raw, mark in pairs:
            p = F.replace(p, F.lit(mark), F.lit(raw))
        return p

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), piece), "\\")


def format_chats(
    turns: DataFrame, template: Template = Template(), *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_id, segments, formatted, valid``.

    ``segments`` is an array of (text, loss) whose texts joined are ``formatted``; only the text of a
    loss role carries loss. ``valid`` says whether the machine accepts the order of roles; other
    conversations are formatted all the same. Null texts and roles are empty; turns that tie go by
    role, then text; rows that repeat are all kept; a null conversation id is a conversation of its
    own. Turns are formatted before the shuffle; a conversation is one output value, so its turns
    meet in one group, as the result requires. Other columns are not read.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    no = F.lit(False)
    head = F.concat(F.lit(template.open), escape(role, template.escapes + template.role_escapes), F.lit(template.mid))
    pieces = F.array(
        F.struct(head.alias("text"), no.alias("loss")),
        F.struct(escape(text, template.escapes).alias("text"), role.isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(template.close).alias("text"), no.alias("loss")),
    )
    one = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("raw"), pieces.alias("pieces"))
    moves = F.create_map(*[F.lit(x) for kv in template.moves.items() for x in kv])
    grouped = turns.select(F.col(conv_col).alias("conv"), one.alias("one")).groupBy("conv").agg(F.array_sort(F.collect_list("one")).alias("all"))
    state = F.aggregate("all", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), t["role"])), F.lit("invalid")))
    return grouped.select(
        F.col("conv").alias(conv_col), F.flatten(F.transform("all", lambda t: t["pieces"])).alias("segments"),
        state.isin(*template.accept).alias("valid"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(chats: DataFrame, template: Template = Template(), *, conv_col: str = "conv_id") -> DataFrame:
    """Digests taken from the formatted output alone, as the turns and loss texts it holds.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid``.
    """
    import re

    quoted = lambda s: re.sub(r"([^\w\s])", r"\\\1", s)
    parts = F.split(F.col("formatted"), quoted(template.close), -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def turn(t: Column) -> Column:
        body = F.substring(t, len(template.open) + 1, 1 << 30)
        cut = F.instr(body, template.mid)
        return F.struct(
            unescape(body.substr(F.lit(1), cut - 1), template.escapes + template.role_escapes).alias("role"),
            unescape(body.substr(cut + len(template.mid), F.length(body)), template.escapes).alias("text"),
        )

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template.escapes)), "")
    nl = F.lit("\n")
    return (
        chats.select(F.col(conv_col), F.transform(turns, turn).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
        .select(
            conv_col, F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid",
        )
    )
