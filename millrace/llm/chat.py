"""Chat formatting in budgeted windows.

A conversation's turns, in order, are cut into windows of whole turns by their
tokens' prefix sums.  A window opens with the system turn and a limited
history, both repeated and masked, and goes on with its own turns as long as
the budget lasts; a turn that alone exceeds the budget has a window to itself.
The loss mask covers the text of a window's own assistant turns, so each target
counts once.

Template: ``<|turn|>role\\ntext<|end|>\\n``, with ``<|past|>`` for a repeated
turn.  Inside roles and texts a backslash is doubled and a control string is
broken by a backslash after its first character, which unescape() undoes.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET = 512
#: Tokens and turns of history that a window may repeat.
HISTORY_TOKENS = 128
HISTORY_TURNS = 2
#: Tokens counted for a turn's marks.
MARKS = 4
TURN, PAST, END = "<|turn|>", "<|past|>", "<|end|>"
# Control strings of common templates begin with "<" or "[", followed by one of these.
_CONTROL = r"\||/?s>|</?SYS>>"
_SQUARE = r"/?INST\]"
#: Counted as one token, much as subword vocabularies cut text: up to six letters, up to three digits, or one other sign.
TOKEN = r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]"
#: Turns whose windows one inner pass finds, so that the list of all windows is copied once a block only.
_TURNS = 256


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"<(?={_CONTROL})|\[(?={_SQUARE})", r"$0\\")


def unescape(text: Column) -> Column:
    joined = F.regexp_replace(text, rf"(<)\\(?={_CONTROL})|(\[)\\(?={_SQUARE})", "$1$2")
    return F.replace(joined, F.lit("\\\\"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|nl|>"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|nl|>"), F.lit("\n")))


def windows(turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row per window: conv_id, window (from 0), first_turn and own_turns (positions), formatted, loss_spans.

    turns needs conv_id, turn, role and text; a null role or text is empty, a
    null turn comes first, and rows that share a turn are ordered by role and
    text.  loss_spans holds start (from 0) and length, in code points of
    formatted.  Every turn is one window's own exactly once.  Rows of a null
    conv_id are one conversation.  An empty table gives an empty result.  A
    conversation is one row here, as its digest needs all of it, and a window
    takes only its own turns and those it repeats along, so memory and time
    grow with a conversation's text.  Other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long") + MARKS)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("upto", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "upto"))).alias("t"))
    whole = whole.withColumn("n", F.size("t")).withColumn("system", F.when(F.get("t", F.lit(0))["role"] == "system", 1).otherwise(0))
    upto = lambda i: F.when(i > 0, F.get("t", i - 1)["upto"]).otherwise(F.lit(0).cast("long"))  # noqa: E731  tokens of the turns before i

    def history(i: Column) -> Column:
        """The first turn that a window opening at turn i repeats as history."""
        start = i
        for k in range(1, history_turns + 1):
            start = F.when((i - k >= F.col("system")) & (upto(i) - upto(i - k) <= history_tokens), i - k).otherwise(start)
        return start

    def step(s: Column, i: Column) -> Column:
        fits = upto(i + 1) - s["base"] <= budget
        base = upto(history(i)) - upto(F.col("system"))
        opened = F.struct(base.alias("base"), F.concat(s["starts"], F.array(i)).alias("starts"))
        return F.when((i <= F.col("system")) | fits, s).otherwise(opened)

    ints = "array<int>"
    state = lambda base, starts: F.struct(base.alias("base"), starts.alias("starts"))

    def block(s: Column, b: Column) -> Column:
        turns_of = F.sequence(b, F.least(b + _TURNS, F.col("n")) - 1)
        inner = F.aggregate(turns_of, state(s["base"], F.array().cast(ints)), step)
        return F.get(F.transform(F.array(inner), lambda x: state(x["base"], F.concat(s["starts"], x["starts"]))), F.lit(0))

    blocks = F.sequence(F.lit(0), F.col("n") - 1, F.lit(_TURNS))
    whole = whole.withColumn("starts", F.aggregate(blocks, state(F.lit(0).cast("long"), F.array(F.lit(0))), block, lambda s: s["starts"]))
    show = lambda mark: lambda t: F.struct(F.concat(F.lit(mark), _role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (F.lit(mark == TURN) & (t["role"] == "assistant")).alias("loss"))
    none = F.slice("t", F.lit(1), F.lit(0))

    def window(first: Column, w: Column) -> Column:
        """A window's own turns and those that it repeats, cut out of the conversation before windows become rows."""
        own = F.slice("t", first + 1, F.coalesce(F.get("starts", w + 1), F.col("n")) - first)
        again = F.when(w > 0, F.concat(F.slice("t", F.lit(1), F.col("system")), F.slice("t", history(first) + 1, first - history(first)))).otherwise(none)
        return F.struct(w.alias("window"), first.alias("first_turn"), F.size(own).alias("own_turns"), F.concat(F.transform(again, show(PAST)), F.transform(own, show(TURN))).alias("pieces"))

    each = whole.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")

    end = F.lit(f"{END}\n")
    line = lambda p: F.concat(p["head"], p["body"], end)
    spans = F.array().cast("array<struct<start:int,length:int>>")

    def mark(s: Column, p: Column) -> Column:
        span = F.struct((s["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((s["at"] + F.length(line(p))).alias("at"), F.when(p["loss"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    found = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), spans.alias("spans")), mark, lambda s: s["spans"])
    return each.select("conv_id", "window", "first_turn", "own_turns", F.array_join(F.transform("pieces", line), "").alias("formatted"), found.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from windows() alone: conv_id, turns (role, text in order), loss_text, formatted_chars, n_windows."""
    pattern = F.lit(r"(?s)<\|turn\|>(.*?)\n(.*?)<\|end\|>")
    roles, texts = F.regexp_extract_all("formatted", pattern, F.lit(1)), F.regexp_extract_all("formatted", pattern, F.lit(2))
    own = F.zip_with(roles, texts, lambda r, t: F.struct(_unrole(r).alias("role"), unescape(t).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    rows = formatted.select("conv_id", "window", own.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss", "chars"))).alias("w"))
    return whole.select(
        "conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss_text"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("formatted_chars"), F.size("w").alias("n_windows"),
    )
