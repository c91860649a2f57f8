"""Chat formatting in budgeted windows.

A conversation's turns are packed into windows of at most ``budget`` tokens, cut between turns only. Each window
starts with the system turn, then repeats a limited part of the turns before it as context, then brings new
turns. Prefix sums of the turns' tokens choose the spans. Loss falls on assistant turns that are new in their
window; the repeated ones are masked, so every target is learnt once.

The template encloses each turn in marks. Control strings inside a text get a ``~`` after their first character
(one more if they have some already), which makes them different from every mark and can be undone.

Defined results: a null text or role is an empty one; turns of equal number are ordered by role and text; a turn
larger than the budget has a window of its own, whole; repeated rows are turns of their own; rows without
``conv_id`` form a conversation of their own; an empty table gives an empty table. Only the four columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS

_SPECIAL = set("\\^$.|?*+()[]{}/-&")


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in _SPECIAL else c for c in text)


@dataclass(frozen=True)
class Template:
    """Marks around the role and the text of a turn. ``control`` has every string that texts may not contain."""

    opening: str = "<s>[INST] "
    middle: str = " [/INST]"
    closing: str = "</s>"
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def escape(self, text: Column) -> Column:
        places = "|".join(f"(?<={_quoted(c[0])})(?=~*{_quoted(c[1:])})" for c in self.control)
        return F.regexp_replace(text, places, "~")

    def unescape(self, text: Column) -> Column:
        places = "|".join(f"(?<={_quoted(c[0])})~(?=~*{_quoted(c[1:])})" for c in self.control)
        return F.regexp_replace(text, places, "")


def estimated_tokens(text: Column) -> Column:
    """A count without a vocabulary: a token for each started four characters, one for each word at least."""
    words = F.size(F.filter(F.split(text, BLANKS), lambda w: w != ""))
    return F.greatest(F.ceil(F.length(text) / 4), words.cast("long")).cast("long")


def conversations(rows: DataFrame, template: Template) -> DataFrame:
    """One row per conversation: its formatted turns in order.

    Each has its number ``i``, ``tokens``, the tokens of all turns before (``before``), ``lead`` (a system turn),
    ``target`` (an assistant turn), ``formatted``, and where its text stands in that (``skip``, ``chars``).
    """
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = own.withColumns({"tokens": estimated_tokens(F.col("text")), "e_role": template.escape(F.col("role")), "e_text": template.escape(F.col("text"))})
    turns = turns.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("i"), "tokens",
        (F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("before"),
        (F.col("role") == "system").alias("lead"), (F.col("role") == "assistant").alias("target"),
        F.concat(F.lit(template.opening), "e_role", F.lit(template.middle), "e_text", F.lit(template.closing)).alias("formatted"),
        (F.length("e_role") + len(template.opening) + len(template.middle)).alias("skip"), F.length("e_text").alias("chars"),
    )
    parts = F.struct("i", "tokens", "before", "lead", "target", "formatted", "skip", "chars")
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(parts)).alias("turns"))


def windows(rows: DataFrame, budget: int = 512, history: int = 128, template: Template = Template()) -> DataFrame:
    """``conv_id``, ``window``, ``n_context`` (leading turns that are repeated), ``formatted`` and ``loss``.

    ``loss`` has start and length, in code points, of every part of ``formatted`` that is a target. Windows hold at
    most ``budget`` tokens of turns, system turn and up to ``history`` tokens of repeated turns included, unless one
    new turn (with the system turn) has more.
    """
    # The system turn is the first one, if it has that role. It leads every window and is new in the first.
    found = conversations(rows, template).withColumn("system", F.when(F.get("turns", F.lit(0)).lead, 1).otherwise(0))
    found = found.withColumn("room", F.lit(budget) - F.when(F.col("system") == 1, F.get("turns", F.lit(0)).tokens).otherwise(0))
    span = "struct<context:int,first:int,end:int>"

    # A span is [context, first, end): repeated from context, new from first on. It ends before the turn that
    # would take it over the budget, by the difference of two prefix sums.
    def step(state: Column, turn: Column) -> Column:
        current = state.current
        fits = turn.before + turn.tokens - F.get("turns", current.context).before <= F.col("room")
        grown = F.struct(current.context.alias("context"), current["first"].alias("first"), (turn.i + 1).alias("end"))
        limit = F.least(F.lit(history), F.col("room") - turn.tokens)
        back = F.filter(
            F.slice("turns", current["first"] + 1, turn.i - current["first"]), lambda t: turn.before - t.before <= limit
        )
        fresh = F.struct(F.coalesce(F.get(back, F.lit(0)).i, turn.i).alias("context"), turn.i.alias("first"), (turn.i + 1).alias("end"))
        return F.when(fits, F.struct(state.done.alias("done"), grown.alias("current"))).otherwise(
            F.struct(F.concat(state.done, F.array(current)).alias("done"), fresh.alias("current")))

    first = F.least(F.col("system"), F.size("turns") - 1)
    begin = F.struct(
        F.array().cast(f"array<{span}>").alias("done"),
        F.struct(first.alias("context"), first.alias("first"), (first + 1).alias("end")).alias("current"),
    )
    later = F.slice("turns", first + 2, F.size("turns"))
    spans = F.aggregate(later, begin, step, lambda a: F.concat(a.done, F.array(a.current)))

    def parts(s: Column, number: Column) -> Column:
        """The turns of one window, each with whether it is new there; the system turn is new in window 0."""
        own = F.transform(
            F.slice("turns", s.context + 1, s.end - s.context), lambda t: F.struct(t.alias("turn"), (t.i >= s["first"]).alias("new"))
        )
        lead = F.transform(F.slice("turns", 1, F.least(F.col("system"), s.context)), lambda t: F.struct(t.alias("turn"), (number == 0).alias("new")))
        return F.concat(lead, own)

    each = found.withColumn("spans", spans).select("conv_id", F.posexplode(F.transform("spans", parts)).alias("window", "parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    loss = F.aggregate(
        "parts", start,
        lambda a, p: F.struct(
            (a.at + F.length(p.turn.formatted)).alias("at"),
            F.when(p.new & p.turn.target, F.concat(a.loss, F.array(F.struct((a.at + p.turn.skip).alias("start"), p.turn.chars.alias("length")))))
            .otherwise(a.loss).alias("loss"),
        ),
        lambda a: a.loss,
    )
    return each.select(
        "conv_id", "window",
        F.size(F.filter("parts", lambda p: ~p.new)).alias("n_context"),
        F.array_join(F.transform("parts", lambda p: p.turn.formatted), "").alias("formatted"),
        loss.alias("loss"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns and targets, read from formatted windows alone: ``conv_id``, ``turns`` (role, text) and ``targets`` (texts)."""
    enclosed = F.filter(F.split("formatted", _quoted(template.closing)), lambda x: x != "")
    new = F.slice(enclosed, F.col("n_context") + 1, F.greatest(F.size(enclosed), F.lit(1)))

    def parse(turn: Column) -> Column:
        inner = F.substring(turn, len(template.opening) + 1, F.length(turn))
        at = F.instr(inner, template.middle)
        role, text = F.substring(inner, F.lit(1), at - 1), F.substring(inner, at + len(template.middle), F.length(inner))
        return F.struct(template.unescape(role).alias("role"), template.unescape(text).alias("text"))

    targets = F.transform("loss", lambda x: template.unescape(F.substring("formatted", x.start + 1, x["length"])))
    parsed = formatted.select("conv_id", "window", F.transform(new, parse).alias("turns"), targets.alias("targets"), F.length("formatted").alias("chars"))
    whole = parsed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("windows"), F.sum("chars").alias("formatted_chars")
    )
    return whole.select(
        "conv_id", F.flatten(F.transform("windows", lambda w: w.turns)).alias("turns"),
        F.flatten(F.transform("windows", lambda w: w.targets)).alias("targets"), F.col("formatted_chars").cast("long"),
    )


def digests(parsed: DataFrame) -> DataFrame:
    """Counts and hashes of what was read back."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learnt = F.array_join("targets", "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars",
    )
