r"""Chat formatting: budgeted windows of whole turns, with the part that a model is trained on marked.

A turn becomes

    <turn ROLE>
    TEXT
    </turn>

where a backslash in ROLE or TEXT is written \b, "<" is \l and, in ROLE, ">" is \g; so no text can form a mark,
and reading back is exact. Prefix sums of turn tokens choose spans of whole turns that fit the budget; a turn
longer than the budget stands alone. Each window repeats the system turn that holds at its first turn (the last one at
or before it, so never one that is yet to come) and up to `history_turns` turns (within `history_tokens`) before
its span as context. A system turn that doesn't fit the budget beside the window's first turn is left out of that
window, and so is history that doesn't fit; so no window is over its budget but those of one turn that is. Loss spans
cover the assistant texts of the span only: a repeated assistant text is masked, so each is a target once.

DataFrame functions only. Turns are put in order by range, over all conversations, and numbered within each from the
counts of the parts; a conversation is cut into blocks of BLOCK turns by these numbers. So a conversation that holds much
of the table, or has many turns of one number, is spread over many tasks. A window never crosses a block's edge; history
does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ranged

BLOCK = 128
END = "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    for code, char in (("\\g", ">"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def header(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.replace(escaped(role), F.lit(">"), F.lit("\\g")), F.lit(">\n"))


def tokens(text: Column) -> Column:
    """An estimate that needs no vocabulary: runs of letters or digits, single other signs, and 4 for the marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 4


def numbered(turns: DataFrame) -> DataFrame:
    """turns with `no`, from 0 within a conversation: by turn (nulls first), then role, then text; equal rows in any order."""
    rows = ranged(turns.withColumn("tie", F.monotonically_increasing_id()), "conv_id", "turn", "role", "text", "tie")
    parts = rows.groupBy("conv_id", "pid").agg(F.min("idx").alias("low"), F.count("*").alias("here"))  # a conversation has a row for each part that it is in
    before = F.sum("here").over(W.partitionBy("conv_id").orderBy("pid")) - F.col("here")
    parts = parts.select(F.col("conv_id").alias("of"), F.col("pid").alias("p"), (before - F.col("low")).alias("shift"))
    return rows.join(parts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("pid") == F.col("p"))).withColumn("no", F.col("idx") + F.col("shift")).drop("of", "p", "shift", "pid", "idx", "tie")


def windows(turns: DataFrame, budget: int = 1024, history_turns: int = 2, history_tokens: int = 256) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, block, window, n_context, n_turns, tokens, text, loss (array of start, end in code points).

    Turns go by turn (nulls first), ties by role, then text; repeated rows stay. A null text or role is
    empty. Rows without conv_id form one conversation. An empty table gives no windows. Other columns are
    not looked at.
    """
    base = numbered(turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    base = base.withColumn("tok", tokens(F.col("text")))
    own = F.floor(F.col("no") / BLOCK).cast("long")
    in_block = W.partitionBy("conv_id", own).orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    base = base.withColumn("system", F.last(F.when(F.col("role") == "system", F.struct("no", "tok")), True).over(in_block))
    told = base.groupBy("conv_id", own.alias("block")).agg(F.max("system.no").alias("last"))
    told = told.withColumn("held", F.last("last", True).over(W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1))).where("held IS NOT NULL")  # a number for each block
    said = base.where(F.col("role") == "system").select(F.col("conv_id").alias("of"), F.struct("no", "role", "text", "tok").alias("before"))
    told = told.join(said, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("held") == F.col("before.no"))).select("of", F.col("block").alias("in_block"), "before")
    late = F.col("no") % BLOCK >= BLOCK - history_turns
    homes = F.array(F.struct(own.alias("block"), F.lit(False).alias("carried")))
    homes = F.when(late, F.concat(homes, F.array(F.struct((own + 1).alias("block"), F.lit(True).alias("carried"))))).otherwise(homes)
    placed = base.select("*", F.inline(homes)).groupBy("conv_id", "block")
    blocks = placed.agg(F.sort_array(F.collect_list(F.struct("no", "turn", "role", "text", "tok", "system", "carried"))).alias("ts"))
    blocks = blocks.join(told, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in_block")), "left").drop("of", "in_block")
    blocks = blocks.withColumn("n_carried", F.size(F.filter("ts", lambda x: x.carried))).where(F.col("n_carried") < F.size("ts"))
    zero = F.lit(0).cast("int")
    turn = lambda i: F.get("ts", i - 1)
    held = lambda x: (F.coalesce(x.system.no, F.col("before.no")), F.coalesce(x.system.tok, F.col("before.tok")))

    def spent_at(i: Column) -> Column:
        """What a window that begins at turn i (from 1) spends on the system turn that holds there."""
        no, tok = held(turn(i))
        return F.coalesce(F.when((no != turn(i).no) & (tok + turn(i).tok <= budget), tok), zero).cast("int")

    longs = F.array().cast("array<long>")
    ends = F.aggregate("ts", longs, lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x.tok))
    blocks = blocks.withColumn("ends", ends)  # prefix sums of tokens

    def step(acc: Column, i: Column) -> Column:
        """Turn i (from 1) opens a span if the span that is open would outgrow the room."""
        before = F.when(i > 1, F.col("ends")[i - 2]).otherwise(F.lit(0).cast("long"))
        opens = (i == F.col("n_carried") + 1) | ((F.col("ends")[i - 1] - acc.base > budget - history_tokens - acc.spent) & (before > acc.base))
        return F.struct(F.when(opens, before).otherwise(acc.base).alias("base"), F.when(opens, spent_at(i)).otherwise(acc.spent).alias("spent"), F.when(opens, F.array_append(acc.starts, i)).otherwise(acc.starts).alias("starts"))

    start = F.struct(F.lit(0).cast("long").alias("base"), zero.alias("spent"), F.array().cast("array<int>").alias("starts"))
    spans = F.aggregate(F.sequence(F.col("n_carried") + 1, F.size("ts")), start, step, lambda acc: acc.starts)
    out = blocks.withColumn("starts", spans).select("*", F.posexplode("starts").alias("window", "a"))
    out = out.withColumn("b", F.coalesce(F.try_element_at("starts", F.col("window") + 2) - 1, F.size("ts")))  # the span: turns a to b
    new = F.slice("ts", F.col("a"), F.col("b") - F.col("a") + 1)
    past = F.slice("ts", F.greatest(F.col("a") - history_turns, F.lit(1)), F.least(F.col("a") - 1, F.lit(history_turns)))
    out = out.withColumns({"system_no": held(turn(F.col("a")))[0], "system_tok": spent_at(F.col("a"))})
    whole = F.when(F.col("system_tok") > 0, F.coalesce(F.get(F.filter("ts", lambda x: x.no == F.col("system_no")).getField("text"), F.lit(0)), F.col("before.text")))
    span_tokens = F.get("ends", F.col("b") - 1) - F.when(F.col("a") > 1, F.get("ends", F.col("a") - 2)).otherwise(0)
    rest = F.least(F.lit(history_tokens).cast("long"), F.lit(budget) - F.col("system_tok") - span_tokens)
    out = out.select("conv_id", "block", "window", "system_no", "system_tok", whole.alias("system"), rest.alias("rest"), new.alias("new"), F.when(F.col("a") > 1, past).otherwise(F.slice("ts", 1, 0)).alias("past"))
    ahead_too = lambda x: F.coalesce(F.col("system").isNotNull() & (x.no == F.col("system_no")), F.lit(False))
    spent = lambda i: F.aggregate(F.slice(F.col("past"), i + 1, F.lit(history_turns)), F.lit(0), lambda s, y: s + F.when(ahead_too(y), 0).otherwise(y.tok))
    past = F.filter("past", lambda x, i: (spent(i) <= F.col("rest")) & ~ahead_too(x))
    as_turn = lambda x: F.struct(x.role.alias("role"), x.text.alias("text"), x.tok.alias("tok"))
    told_again = F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("text"), F.col("system_tok").alias("tok")))
    ahead = F.when(F.col("system").isNotNull(), told_again).otherwise(F.slice(told_again, 1, 0))
    out = out.select("conv_id", "block", "window", F.concat(ahead, F.transform(past, as_turn)).alias("context"), F.transform("new", as_turn).alias("new"))
    out = out.select("conv_id", "block", "window", F.size("context").alias("n_context"), F.size("new").alias("n_turns"), F.concat("context", "new").alias("all"))
    marked = F.transform("all", lambda x, i: F.struct(header(x.role).alias("head"), escaped(x.text).alias("body"), ((i >= F.col("n_context")) & (x.role == "assistant")).alias("target"), x.tok.alias("tok")))
    out = out.withColumn("marked", marked)

    def place(acc: Column, x: Column) -> Column:
        at = acc.at + F.length(x.head)
        end = at + F.length(x.body)
        span = F.struct(at.alias("start"), end.alias("end"))
        return F.struct((end + 1 + len(END)).alias("at"), F.when(x.target, F.array_append(acc.loss, span)).otherwise(acc.loss).alias("loss"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return out.select(
        "conv_id", "block", "window", "n_context", "n_turns",
        F.aggregate("marked", F.lit(0), lambda s, x: s + x.tok).alias("tokens"),
        F.array_join(F.transform("marked", lambda x: F.concat(x.head, x.body, F.lit("\n" + END))), "").alias("text"),
        F.aggregate("marked", zero, place, lambda acc: acc.loss).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Windows -> the same rows with `turns` (array of role, text: the span's turns without the context) and `targets` (texts under the loss spans)."""
    parts = F.split("text", END)

    def parsed(part: Column) -> Column:
        head = F.instr(part, F.lit(">\n"))
        role = F.substring(part, F.lit(len("<turn ") + 1), head - len("<turn ") - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(part, head + 2, F.length(part) - head - 2)).alias("text"))

    return formatted.withColumns({
        "turns": F.transform(F.slice(parts, F.col("n_context") + 1, F.size(parts) - 1 - F.col("n_context")), parsed),
        "targets": F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s.start + 1, s.end - s.start))),
    })


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from its windows in order."""
    back = read_back(formatted).select(
        "conv_id", "block", "window", F.size("turns").alias("n"), F.length("text").cast("long").alias("chars"),
        F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("target"),
    )
    whole = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "window", "said", "target"))).alias("w"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    target = F.array_join(F.col("w.target"), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("w.said"), ""), 256).alias("turns_sha256"), F.length(target).cast("long").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), "formatted_chars")
