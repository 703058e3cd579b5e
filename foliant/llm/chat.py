"""Chat transcripts as training windows under a token budget.

Prefix sums of turn tokens place a conversation's turns on a grid; turns that
lie inside one cell of the grid form a span, and a turn that lies across a grid
line is a span of its own. A span is a window together with the conversation's
system turn and the last turns before it, up to a history budget. Repeated
turns are masked, so each assistant text is a target once.

The sums run over ranges of all turns, and the totals of a conversation's
earlier ranges are added, so a conversation that holds most of the turns is
dealt like any other and its windows do not depend on how the ranges fell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.scan import split_ranges
from foliant.session import settle

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings begin with "<|". Inside texts one more backslash goes between the two characters.
ESCAPE = (r"<(\\*)\|", r"<$1\\|")
UNESCAPE = (r"<(\\*)\\\|", "<$1|")
TURN = r"<\|im_start\|>([^\n]*)\n((?s:.*?))<\|im_end\|>\n"
#: Characters of a text that take part in the cut points of the ranges.
_LEAD = 64
_CONV = ["_cn", "_c"]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, and four for the template of the turn."""
    return (F.ceil(F.octet_length(text) / 4) + 4).cast("long")


def format_windows(
    turns: DataFrame, budget: int = 2048, history: int = 512, id_col: str = "conv_id", tokens: Column | None = None,
) -> DataFrame:
    """``(id, span, n_turns, n_repeated, n_tokens, formatted, loss_spans)``, one row per window.

    ``span`` orders the windows of a conversation. The first ``n_repeated``
    turns of a window are the system turn and history; the others appear in no
    other window as new turns. ``loss_spans`` are ``(start, end)`` code points
    of ``formatted``, end exclusive: the texts of new assistant turns. A window
    is above ``budget`` only if its one new turn is (or the system turn takes
    more than a quarter of it).

    Null roles and texts are empty, a null id is a conversation of its own,
    null turns come first, equal turns are ordered by role and text, and
    repeated rows are kept. Turn numbers only order the turns: gaps in them
    change nothing. The system turn is the first turn if its role is
    ``system``. A very long text is one turn and so in one window (and in the
    history of none but those that begin right after it). An empty table gives
    no windows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = turns.select(
        F.col(id_col).isNull().alias("_cn"), F.coalesce(F.col(id_col), F.lit(0)).alias("_c"),
        F.col("turn").alias("_turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        text.alias("text"), (estimated_tokens(text) if tokens is None else tokens).cast("long").alias("tok"),
    )
    ranged = split_ranges(base.withColumn("_lead", F.substring("text", 1, _LEAD)), [*_CONV, "_turn", "role", "_lead"]).drop("_lead")
    # One row for each conversation and range: what comes before it, and the system turn's tokens.
    head = F.min_by(F.when(F.col("role") == "system", F.col("tok")), F.struct("_turn", "role", "text"))
    parts = ranged.groupBy(*_CONV, "_range").agg(F.count("*").alias("c"), F.sum("tok").alias("t"), head.alias("head"))
    conv = W.partitionBy(*_CONV).orderBy("_range")
    earlier = conv.rowsBetween(W.unboundedPreceding, -1)
    parts = settle(parts.select(
        *_CONV, "_range", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t"),
        F.first("head").over(conv).alias("sys_tok"),
    ))
    order = W.partitionBy(*_CONV, "_range").orderBy(F.col("_turn").asc_nulls_first(), "role", "text")
    local = ranged.withColumn("_n", F.row_number().over(order)).withColumn(
        "_p", F.coalesce(F.sum("tok").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    n, p = F.col("_n") + F.col("c"), F.col("_p") + F.col("t")
    width = F.greatest(F.lit(budget - history) - F.coalesce("sys_tok", F.lit(0)), F.lit(max(1, budget // 4)))
    cell = F.floor(F.col("p") / width)
    across = F.floor((F.col("p") + F.greatest(F.col("tok"), F.lit(1)) - 1) / width) > cell
    placed = settle(
        local.join(parts, [*_CONV, "_range"]).withColumn("n", n.cast("long")).withColumn("p", p.cast("long"))
        .withColumn("is_sys", F.col("sys_tok").isNotNull() & (F.col("n") == 1))
        .select(*_CONV, "n", "p", "tok", "role", "text", "is_sys", (2 * cell + across.cast("int")).cast("long").alias("span"))
    )
    # One row for each window, without texts: where it begins, and whether the system turn is new in it.
    spans = settle(placed.groupBy(*_CONV, "span").agg(F.min("p").alias("s"), F.max("is_sys").alias("has_sys")))
    # History on a grid of its own: what a window repeats lies in at most two cells before its first turn.
    reach = max(1, history)
    cells = F.array_distinct(F.array(F.floor((F.col("s") - history) / reach), F.floor((F.col("s") - 1) / reach)))
    asked = settle(spans.filter(F.col("s") > 0).select(*_CONV, "span", "s", F.explode(cells).alias("_h")))
    said = placed.filter(~F.col("is_sys")).select(*_CONV, F.floor(F.col("p") / reach).alias("_h"), "p", "n", "tok", "role", "text")
    near = asked.join(said, [*_CONV, "_h"]).filter((F.col("p") >= F.col("s") - history) & (F.col("p") < F.col("s")))
    heads = spans.filter(~F.col("has_sys")).join(placed.filter("is_sys").select(*_CONV, "n", "tok", "role", "text"), _CONV)
    # All turns of a window in one place: the system turn, its history, and its new turns.
    part = lambda df, kind: df.select(*_CONV, "span", F.lit(kind).alias("kind"), "n", "tok", "role", "text")
    spans = part(heads, 0).unionByName(part(near, 1)).unionByName(part(placed, 2)).groupBy(*_CONV, "span").agg(
        F.array_sort(F.collect_list(F.struct("kind", "n", "role", "text"))).alias("all"),
        F.sum(F.when(F.col("kind") == 2, F.col("tok"))).alias("n_tokens"),
    )

    def turn(t: Column, loss: Column) -> Column:
        return F.struct(_role_out(t["role"]).alias("role"), escape(t["text"]).alias("text"), loss.alias("loss"))

    out = spans.select(
        *_CONV, "span", "n_tokens", F.size(F.filter("all", lambda t: t["kind"] < 2)).alias("n_repeated"),
        F.transform("all", lambda t: turn(t, (t["kind"] == 2) & (t["role"] == "assistant"))).alias("turns"),
    )
    piece = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))
    ahead = lambda t: F.length(t["role"]) + len(OPEN) + 1
    none_yet = F.array().cast("array<struct<start:int,end:int>>")

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + ahead(t)
        here = F.array(F.struct(begin.alias("start"), (begin + F.length(t["text"])).alias("end")))
        return F.struct(
            (begin + F.length(t["text"]) + len(CLOSE)).alias("at"),
            F.when(t["loss"], F.concat(s["spans"], here)).otherwise(s["spans"]).alias("spans"),
        )

    loss = F.aggregate("turns", F.struct(F.lit(0).alias("at"), none_yet.alias("spans")), step)["spans"]
    return out.select(
        F.when(~F.col("_cn"), F.col("_c")).alias(id_col), "span",
        F.size("turns").alias("n_turns"), "n_repeated", "n_tokens",
        F.array_join(F.transform("turns", piece), "").alias("formatted"), loss.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The ``(role, text)`` turns of a formatted window."""
    return F.zip_with(
        F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)), F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2)),
        lambda r, t: F.struct(_role_in(r).alias("role"), unescape(t).alias("text")),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def digests(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation: what can be read back from its windows.

    The digest of a conversation needs its whole text in one cell; only this
    report does that, the windows do not.
    """
    new = F.slice(read_turns(F.col("formatted")), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    said = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = windows.select(
        id_col, F.struct("span", said.alias("said"), F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss")).alias("w"),
        (F.col("n_turns") - F.col("n_repeated")).cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"),
    )
    whole = part.groupBy(id_col).agg(
        F.array_sort(F.collect_list("w")).alias("ws"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars")
    )
    loss = F.array_join(F.col("ws.loss"), "")
    return whole.select(
        id_col, "n_turns", F.sha2(F.array_join(F.col("ws.said"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
