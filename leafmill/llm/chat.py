"""Chat formatting into budgeted windows, with DataFrame functions only.

A conversation is cut into windows of whole turns. The budget holds for all of a window: the leading system turn, which
every later window repeats, and ``history_tokens`` are taken from it first, and what is left is the room of new turns.
Prefix sums of the turns' token counts choose the spans: a turn of more than half the room stands alone, and
between such turns a turn belongs to the window in whose half room it starts. So new turns never exceed the room,
and no turn is ever cut: only a turn that is over the budget alone, or together with the system turn, gives a window over it.
Every window but the first repeats the system turn and up to ``history`` of the turns before it, as far as
they have at most ``history_tokens`` tokens together and the budget has room for them. Assistant turns are targets
once: the loss mask covers them where they are new and leaves them out where they are repeated.

The template marks turns as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts, ``&`` becomes ``&amp;``
and ``<|`` becomes ``&lt;|`` (and a line feed in a role ``&#10;``), so no text holds a marker, and unescaping gives
every text back.

Defined cases: a null or empty text is an empty turn; a null role is an empty role. Rows are ordered by turn, nulls
first, then role and text, so ties and repeated rows have a defined order, and repeated rows are turns of their
own. A null conversation id is a conversation like others. Columns other than the four are not read, and an empty
table gives no windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's markers.
START, END = "<|im_start|>", "<|im_end|>"

#: Tokens of the markers around a turn, besides its role and text.
TURN_TOKENS = 4


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def estimated_tokens(text: Column) -> Column:
    """About four characters a token: a stand-in wherever no exact count is given."""
    return F.ceil(F.char_length(text) / 4).cast("long")


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 2, history_tokens: int = 256, tokens: Column | None = None) -> DataFrame:
    """One row for each window: conv_id, window, formatted, repeated (turns), tokens, loss_spans.

    ``turns`` has conv_id, turn, role and text; ``tokens`` is an expression over role and text for the tokens of a
    turn. ``loss_spans`` are (start, length) in code points of ``formatted``, from 0. One exchange by conv_id serves all
    windows and both aggregations.
    """
    if not 0 <= history_tokens < budget:
        raise ValueError("0 <= history_tokens < budget")
    whole = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    until = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = whole.rowsBetween(Window.unboundedPreceding, -1)
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("n", (estimated_tokens(F.col("text")) if tokens is None else tokens) + TURN_TOKENS)
    rows = rows.withColumn("shown", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(f"{END}\n")))

    # what the system turn leaves; of a room of r, a window's new turns start within r / 2 and have at most r / 2 each
    leads = F.first(F.when(F.col("role") == "system", F.col("n")).otherwise(F.lit(0))).over(whole)
    rows = rows.withColumn("base", leads.cast("long")).withColumn("room", F.greatest(F.lit(budget - history_tokens) - F.col("base"), F.lit(2)))
    stride = F.floor(F.col("room") / 2)

    # runs: a large turn stands alone, so a run starts at it and after it
    large = F.col("n") > F.col("room") - stride
    rows = rows.withColumn("i", F.row_number().over(whole)).withColumn("breaks", (large | F.coalesce(F.lag(large).over(whole), F.lit(False))).cast("int"))
    rows = rows.withColumn("run", F.sum("breaks").over(until)).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    in_run = Window.partitionBy("conv_id", "run").orderBy("i")
    rows = rows.withColumn("step", F.floor((F.col("before") - F.first("before").over(in_run)) / stride))

    # what a window may repeat, and where it starts
    turn = F.struct("i", "n", "shown")
    back = F.array(*(F.lag(turn, k).over(whole) for k in range(1, history + 1))) if history else F.array().cast("array<struct<i:int,n:bigint,shown:string>>")
    changes = (F.lag("run").over(whole) != F.col("run")) | (F.lag("step").over(whole) != F.col("step"))
    rows = rows.withColumn("opens", F.coalesce(changes, F.lit(True))).withColumn("system", F.first(F.when(F.col("role") == "system", turn)).over(until))
    rows = rows.withColumn("window", F.sum(F.col("opens").cast("int")).over(until) - 1).withColumn("back", F.when(F.col("opens"), back))

    grouped = rows.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("i", "n", "shown", "role", F.char_length("shown").alias("chars"), F.char_length(escape_role(F.col("role"))).alias("role_chars")))).alias("new"),
        F.max("system").alias("system"),
        F.least(F.lit(history_tokens), F.lit(budget) - F.max("base") - F.sum("n")).alias("spare"),
        F.first("back", ignorenulls=True).alias("back"),
    )
    system = F.when((F.col("window") > 0) & F.col("system").isNotNull(), F.array("system")).otherwise(F.array().cast("array<struct<i:int,n:bigint,shown:string>>"))
    # the nearest turns whose tokens together fit: each of the few is held against the sum up to it
    after = lambda k: reduce(lambda a, b: a + b, (F.coalesce(F.get("back", F.lit(j)).n, F.lit(0)) for j in range(k + 1)))
    nth = lambda k: F.get("back", F.lit(k))
    fits = F.array(*(F.when(nth(k).isNotNull() & (after(k) <= F.col("spare")) & ~nth(k).i.eqNullSafe(F.get("system", F.lit(0)).i), nth(k)) for k in range(history)))
    repeated = F.concat("system", F.reverse(F.array_compact(fits))) if history else F.col("system")
    shaped = grouped.withColumn("system", system).withColumn("old", repeated)
    old_text, new_text = F.array_join(F.transform("old", lambda t: t.shown), ""), F.array_join(F.transform("new", lambda t: t.shown), "")
    starts = F.aggregate(
        "new",
        F.struct(F.char_length(old_text).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, t: F.struct(
            (s.at + t.chars).alias("at"),
            F.when(
                t.role == "assistant",
                F.array_append(s.spans, F.struct((s.at + len(START) + t.role_chars + 1).cast("long").alias("start"), (t.chars - len(START) - t.role_chars - 1 - len(END) - 1).cast("long").alias("length"))),
            ).otherwise(s.spans).alias("spans"),
        ),
        lambda s: s.spans,
    )
    tokens_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, t: s + t.n)
    return shaped.select(
        "conv_id",
        F.col("window").cast("long").alias("window"),
        F.concat(old_text, new_text).alias("formatted"),
        F.size("old").alias("repeated"),
        (tokens_of("old") + tokens_of("new")).alias("tokens"),
        starts.alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Reads formatted windows back: conv_id, window, turns (role, text; new ones only), targets (texts under the mask)."""
    pieces = F.split(F.col("formatted"), r"<\|im_start\|>")
    bodies = F.slice(pieces, F.col("repeated") + 2, F.greatest(F.size(pieces) - F.col("repeated") - 1, F.lit(0)))
    body = lambda p: F.substring(p, F.lit(1), F.char_length(p) - (len(END) + 1))
    turn = lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.char_length(p))).alias("text"),
    )
    targets = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s.start.cast("int") + 1, s.length.cast("int"))))
    return windows.select("conv_id", "window", F.transform(F.transform(bodies, body), turn).alias("turns"), targets.alias("targets"), F.char_length("formatted").cast("long").alias("chars"))


def digest_conversations(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, from formatted windows alone."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    parts = read_windows(windows).select("conv_id", "window", F.size("turns").alias("n"), said.alias("said"), F.array_join("targets", "").alias("target"), "chars")
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "said", "target"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    target = F.array_join(F.transform("w", lambda x: x.target), "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("w", lambda x: x.said), ""), 256).alias("turns_sha256"),
        F.char_length(target).cast("long").alias("loss_chars"),
        F.sha2(target, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
