"""Perspective rotation of dialogues with several parties. Built-in functions only.

For every participant a dialogue is rendered once, with that speaker as the assistant, all
others as named users, and the assistant's turns marked for training. Dialogues longer than
part_turns are rendered in parts, so no task gathers more than one part; each later part
opens with the dialogue's first turn, if that is a system turn, and with the last turns of
the part before, none of which are marked again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import Scratch, number_rows


@dataclass(frozen=True)
class Template:
    """Heads of turns ({name} is the speaker, unnamed is for a null role) and the tail of each. Roles in system aren't participants.

    part_turns: turns of a part; context_turns: turns of the part before that a part repeats.
    """

    assistant: str = "<|assistant|>\n"
    user: str = "<|user:{name}|>\n"
    unnamed: str = "<|user|>\n"
    system_head: str = "<|system|>\n"
    tail: str = "<|end|>\n"
    system: tuple[str, ...] = ("system",)
    part_turns: int = 64
    context_turns: int = 8

    def __post_init__(self):
        if not 0 <= self.context_turns < self.part_turns:
            raise ValueError("context_turns must be below part_turns")

    def head(self, role: Column, speaker: Column) -> Column:
        before, _, after = self.user.partition("{name}")
        user = F.when(role.isNull(), F.lit(self.unnamed)).otherwise(F.concat(F.lit(before), F.replace(plain(role), F.lit("|>"), F.lit("| >")), F.lit(after)))
        return F.when(role.eqNullSafe(speaker), F.lit(self.assistant)).when(self.is_system(role), F.lit(self.system_head)).otherwise(user)

    def is_system(self, role: Column) -> Column:
        return F.coalesce(role.isin(*self.system), F.lit(False))


def plain(text: Column) -> Column:
    """A turn's text without anything that could pass for a head or tail: "<|" becomes "< |"."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def rotations(df: DataFrame, t: Template = Template(), scratch: Scratch | None = None, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, speaker, part, n_turns long, text, spans array<struct<begin, end>>) for each conversation, participant and part.

    Turns are in order of turn, then role, then text, nulls first; rows that repeat are
    turns of their own. part counts from 0, by part_turns turns; n_turns counts a part's own,
    without what it repeats as context. spans are the characters of a part's text that are
    trained on: each of its own turns of the speaker, with its tail but without its head. A
    null role is a participant without a name, a null text is empty; rows without
    conversation are in no dialogue. Names and texts can't forge a head: "<|" becomes "< |"
    in both and "|>" becomes "| >" in names. A dialogue without participants (system turns
    only) and an empty df give no rows. Other columns are ignored.
    """
    scratch = scratch or Scratch(df.sparkSession, "chat")
    turns = df.where(F.col(conversation).isNotNull()).select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), plain(F.col(text)).alias("text"))
    numbered, _ = number_rows(turns, ["conv_id", "turn", "role", "text"], scratch, "row")
    numbered = scratch.save(numbered, "numbered")
    first = scratch.save(numbered.groupBy("conv_id").agg(F.min("row").alias("first")), "first")
    placed = numbered.join(first, "conv_id").select("conv_id", "role", "text", (F.col("row") - F.col("first")).alias("at"))
    placed = scratch.save(placed, "placed")
    place = F.expr(f"cast(at div {t.part_turns} as int)")
    repeated = F.when(F.expr(f"at % {t.part_turns} >= {t.part_turns - t.context_turns}"), F.struct((place + 1).alias("part"), F.lit(False).alias("own")))
    dealt = placed.withColumn("to", F.explode(F.array_compact(F.array(F.struct(place.alias("part"), F.lit(True).alias("own")), repeated))))
    parts = dealt.groupBy("conv_id", "to.part").agg(F.array_sort(F.collect_list(F.struct("at", "to.own", "role", "text"))).alias("turns"), F.sum(F.col("to.own").cast("long")).alias("n_turns"))
    parts = parts.where("n_turns > 0")
    people = placed.where(~t.is_system(F.col("role"))).select("conv_id", F.col("role").alias("speaker")).distinct()
    opening = placed.where((F.col("at") == 0) & t.is_system(F.col("role"))).select("conv_id", F.array(F.struct("at", F.lit(False).alias("own"), "role", "text")).alias("opening"))
    both = scratch.save(parts, "parts").join(scratch.save(people.join(opening, "conv_id", "left"), "people"), "conv_id")
    both = both.withColumn("turns", F.when((F.col("part") > 0) & F.col("opening").isNotNull(), F.concat("opening", "turns")).otherwise(F.col("turns")))

    def add(done: Column, x: Column) -> Column:
        begin = done["end"] + F.length(t.head(x["role"], F.col("speaker")))
        end = begin + F.length(x["text"]) + len(t.tail)
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(end.alias("end"), F.when(x["own"] & x["role"].eqNullSafe(F.col("speaker")), F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<struct<begin: int, end: int>>)").alias("spans"))
    rendered = F.array_join(F.transform("turns", lambda x: F.concat(t.head(x["role"], F.col("speaker")), x["text"], F.lit(t.tail))), "")
    return both.select("conv_id", "speaker", "part", "n_turns", rendered.alias("text"), F.reduce("turns", start, add, lambda s: s["spans"]).alias("spans"))
