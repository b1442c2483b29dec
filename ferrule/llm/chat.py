"""Chat formatting into budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens over a conversation cut it into turn-aligned spans.  Every window shows the leading
system turn again, then at most ``history`` tokens of the turns before it, then its own turns.  Only its own
assistant turns are targets: what a window repeats is masked, so each target is learned once.

Template: ``<|role|>text<|end|>`` and a line feed per turn.  Texts and roles are escaped so that no marker, of
this template or of the bracketed kind, can come from them; ``unescape`` gives the very text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.columns import pick, text_of

OPEN, SHUT, END = "<|", "|>", "<|end|>\n"
#: Characters that can begin a marker, and the escape character, which goes first out and last back.
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("|", "%7C"))
#: Tokens that the markers of one turn take.
TURN_TOKENS = 4


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 256, tokens: str | None = None) -> DataFrame:
    """Windows of the conversations in ``turns`` (conv_id, turn, role, text).

    Returns conv_id, window_no (from 0), text, loss (array of start, length in code points of ``text``: its
    targets), n_repeated (turns that it repeats, system turn included), n_turns (its own), n_tokens.

    Tokens are those that the column ``tokens`` of ``turns`` counts (null: none), or else words and punctuation marks, plus
    ``TURN_TOKENS`` a turn.  A window keeps to ``budget`` unless
    the system turn, or a turn alone in its window, is longer: turns are never cut.  Null text and null roles
    are empty; turns that tie keep the order of role, then text; a null turn comes first; repeated rows are
    repeated turns; the rows of a null conv_id are one conversation.  Extra columns are ignored, an empty table
    gives no windows.  A conversation of any length streams through its task; only windows are gathered.
    """
    size = F.coalesce(turns[f"`{tokens}`"].cast("long"), F.lit(0)) if tokens else F.lit(None).cast("long")
    t = pick(turns.withColumn(free := "n" + "_" * max(map(len, turns.columns)), size), conv_id="long", turn="long", role="string", text="string", **{free: "long"})
    t = t.select("conv_id", "turn", text_of(t["role"]).alias("role"), text_of(t["text"]).alias("text"), F.col(free).alias("size"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SHUT))
    t = t.select(
        "conv_id", "turn", "role", "text",
        F.row_number().over(in_order).alias("pos"),
        (F.coalesce("size", F.regexp_count("text", F.lit(r"\w+|[^\w\s]"))) + TURN_TOKENS).cast("long").alias("tokens"),
        F.char_length(head).alias("head_chars"),
        escape(F.col("text")).alias("body"),
        F.concat(head, escape(F.col("text")), F.lit(END)).alias("piece"),
    )
    t = t.withColumn("is_system", (F.col("pos") == 1) & (F.col("role") == "system"))
    t = t.withColumn("counted", F.when(F.col("is_system"), 0).otherwise(F.col("tokens")))
    t = t.select(
        "*",
        (F.sum("counted").over(so_far) - F.col("counted")).alias("begin"),
        (F.sum(F.char_length("piece").cast("long")).over(so_far) - F.char_length("piece")).alias("char"),
        F.first(F.when(F.col("is_system"), F.struct("piece", "tokens"))).over(so_far).alias("system"),
    )
    # a span overruns its stretch by its last turn at most, so a stretch is what the repeated turns leave but the
    # conversation's longest turn; a turn of more than half of it stands alone
    left = F.lit(budget - history) - F.coalesce(F.col("system.tokens"), F.lit(0))
    half = F.greatest(F.lit(1), F.floor(left / 2))
    t = t.withColumns({"alone": F.col("counted") > half, "left": left, "half": half})
    most = F.max(F.when(~F.col("alone"), F.col("counted"))).over(Window.partitionBy("conv_id"))
    t = t.withColumn("block", F.floor(F.col("begin") / F.greatest("half", F.col("left") - F.coalesce(most, F.lit(0)))))
    before = F.lag(F.struct("block", "alone")).over(in_order)
    cut = before.isNotNull() & ((before["block"] != F.col("block")) | before["alone"] | F.col("alone"))
    # what stands before a long turn, when only the system turn does, stays with it
    t = t.withColumn("cut", F.when(cut & ~F.lag("is_system", 1, False).over(in_order), 1).otherwise(0))
    t = t.withColumn("window_no", F.sum("cut").over(so_far).cast("int"))
    near = Window.partitionBy("conv_id").orderBy("begin").rangeBetween(-history, -1)
    t = t.withColumn("past", F.collect_list(F.when(~F.col("is_system"), F.struct("piece", "tokens"))).over(near))

    own = F.struct("pos", "char", "role", "head_chars", F.char_length("body").alias("body_chars"), "piece", "tokens", "is_system")
    w = t.groupBy("conv_id", "window_no").agg(
        F.sort_array(F.collect_list(own)).alias("own"), F.min_by("past", "pos").alias("past"), F.first("system").alias("system")
    )
    again = F.when(F.col("system").isNotNull() & ~F.col("own")[0]["is_system"], F.array("system")).otherwise(F.array().cast("array<struct<piece:string,tokens:bigint>>"))
    w = w.withColumn("repeated", F.concat(again, "past"))
    w = w.withColumn("prefix", F.array_join(F.transform("repeated", lambda x: x["piece"]), ""))
    skip = F.char_length("prefix") - F.col("own")[0]["char"]
    targets = F.filter("own", lambda x: x["role"] == "assistant")
    loss = F.transform(
        targets,
        lambda x: F.struct((skip + x["char"] + x["head_chars"]).cast("int").alias("start"), x["body_chars"].alias("length")),
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["tokens"])
    return w.select(
        "conv_id", "window_no",
        F.concat("prefix", F.array_join(F.transform("own", lambda x: x["piece"]), "")).alias("text"),
        loss.alias("loss"),
        F.size("repeated").alias("n_repeated"),
        F.size("own").alias("n_turns"),
        (total("repeated") + total("own")).alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What ``format_windows`` put in its windows, from their text: conv_id, window_no, turns (role, text), targets."""
    each = F.slice(F.split("text", r"<\|end\|>\n", -1), F.col("n_repeated") + 1, F.col("n_turns"))
    part = lambda x, k: unescape(F.regexp_extract(x, r"(?s)\A<\|(.*?)\|>(.*)\z", k))
    turns = F.transform(each, lambda x: F.struct(part(x, 1).alias("role"), part(x, 2).alias("text")))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window_no", turns.alias("turns"), targets.alias("targets"), F.char_length("text").alias("chars"))


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    w = read_back(windows).select(
        "conv_id", "window_no", F.size("turns").alias("n"), said.alias("said"), F.array_join("targets", "").alias("target"), "chars"
    )
    c = w.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window_no", "said", "target"))).alias("parts"),
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    joined = lambda name: F.array_join(F.transform("parts", lambda x: x[name]), "")
    return c.select(
        "conv_id", "n_turns",
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.char_length(joined("target")).cast("long").alias("loss_chars"),
        F.sha2(joined("target"), 256).alias("loss_sha256"),
        "formatted_chars", "n_windows",
    )
