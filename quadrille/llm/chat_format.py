"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Template of one turn: ``<s>[INST] role [/INST]text</s>``; a null role gives ``<s>[INST][/INST]text</s>``. Control
strings inside roles and texts get one more backslash after their first character, so none is left in the open and
taking one backslash away restores the text exactly.

Every assistant turn becomes an example: all turns before it and its own header are context, and only its reply is
under the loss mask. An example refers to its context by its length in the formatted conversation, of which it is a
prefix; that keeps the output linear in the input, where written contexts grow with the square of a conversation.
``with_text`` writes them out where that is wanted, and ``digest`` reads its figures from written examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

TARGET_ROLE = "assistant"
#: The control strings of the template.
OPEN, HEAD, BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
TURN = r"(?s)^<s>\[INST\](?: (.*?) )?\[/INST\](.*)$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per turn with its place: conv, position, head, body, target, at (where it begins in the conversation).

    The running sums stream through the sorted rows of a conversation, so a long one needs no memory here. conv is a
    struct of the id: it is never null, so plain equality serves and nulls form one conversation.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(F.struct(F.col(conv).alias("conv_id")).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), whole.alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    head = F.coalesce(F.concat(F.lit(f"{OPEN}{HEAD} "), escape(F.col("role")), F.lit(f" {BODY}")), F.lit(f"{OPEN}{HEAD}{BODY}"))
    placed = rows.select("conv", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"), F.coalesce(F.col("role") == TARGET_ROLE, F.lit(False)).alias("target"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "conv", (F.row_number().over(order) - 1).alias("position"), "head", "body", "target",
        F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0).cast("long")).alias("at"),
        F.coalesce(F.sum(F.col("target").cast("int")).over(before), F.lit(0)).cast("int").alias("example_no"),
    )


def _example() -> list[Column]:
    start = F.col("at") + F.length("head")
    return [
        F.col("example_no"), F.col("position").alias("target_turn"), F.col("at").alias("turn_start"), start.alias("context_chars"),
        start.alias("loss_start"), (start + F.length("body")).alias("loss_end"),
    ]


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per assistant turn: conv_id, example_no and target_turn (from 0), turn_start, context_chars, loss_start,
    loss_end (code points of the formatted conversation) and reply (the formatted text under the loss mask).

    Rows go by turn (null first; ties by role, then text, so repeated rows stay beside each other and all are kept); a
    null text is empty; rows with a null conv_id form one conversation. A conversation without assistant turns has no
    example. Other columns are not read. The output grows with the turns, not with the sum of all contexts.
    """
    return _turns(turns, conv, turn, role, text).where("target").select("conv.conv_id", *_example(), F.col("body").alias("reply"))


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, and examples (an array of structs, as of ``examples`` without the
    reply)."""
    return _formatted(turns, conv, turn, role, text).select("conv.conv_id", "formatted", "examples")


def _formatted(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conversations`` by conv. The grouping keeps the partitioning of the running sums."""
    piece = F.struct("position", F.concat("head", "body", F.lit(CLOSE)).alias("piece"))
    example = F.when(F.col("target"), F.struct(*_example()))
    grouped = _turns(turns, conv, turn, role, text).groupBy("conv").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.array_sort(F.collect_list(example)).alias("examples"))
    return grouped.select("conv", F.array_join("pieces.piece", "").alias("formatted"), "examples")


def with_text(formatted: DataFrame) -> DataFrame:
    """One row per example of ``conversations`` with column text: its whole context and the reply. The size is the sum
    of all prefixes, which for a conversation of n turns is about n / 4 times the conversation."""
    rows = formatted.select("conv_id", "formatted", F.explode("examples").alias("e"))
    return rows.select("conv_id", "e.*", _written(F.col("e.loss_end")).alias("text"))


def _written(end: Column) -> Column:
    """The text of an example: the conversation up to ``end``."""
    return F.substring("formatted", F.lit(1), end.cast("int"))


def _turn(part: Column) -> Column:
    """struct(role, text) of one formatted turn without its end."""
    named = ~part.startswith(f"{OPEN}{HEAD}{BODY}")
    return F.struct(F.when(named, unescape(F.regexp_extract(part, TURN, 1))).alias("role"), unescape(F.regexp_extract(part, TURN, 2)).alias("text"))


def _parts(formatted: Column) -> Column:
    parts = F.split(formatted, CLOSE, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def read_turns(formatted: Column) -> Column:
    """Array of struct(role, text) read back from a formatted conversation."""
    return F.transform(_parts(formatted), _turn)


def digest(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Digests read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Every example is written out with its whole context, as by ``with_text``, and so is the whole conversation, as one
    more without a reply. The text under a loss mask is cut from its example, and each turn is read from the first
    example that holds it. Written texts pass one at a time and are not shuffled; the work grows with their sum. A null
    role reads back as null and adds nothing to the digest but its line end.
    """
    done = _formatted(turns, conv, turn, role, text)
    ends = F.transform("examples", lambda e: e["loss_end"])
    #: new: where the turns begin that no example before holds.
    new = lambda i: F.when(i > 0, F.get(ends, i - 1) + len(CLOSE)).otherwise(F.lit(0).cast("long"))
    each = F.transform("examples", lambda e, i: F.struct(i.alias("no"), new(i).alias("new"), e["loss_start"].alias("start"), e["loss_end"].alias("end")))
    n, size = F.size("examples"), F.length("formatted").cast("long")
    rest = F.struct(n.alias("no"), new(n).alias("new"), F.lit(None).cast("long").alias("start"), size.alias("end"))
    rows = done.select("conv", "formatted", F.explode(F.concat(each, F.array(rest))).alias("e")).select("conv", "e.*", _written(F.col("e.end")).alias("text"))

    def cut(start: Column) -> Column:
        return F.substring("text", (start + 1).cast("int"), (F.col("end") - start).cast("int"))

    is_example = F.col("start").isNotNull()
    line = lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))
    parts = _parts(F.concat(cut(F.col("new")), F.when(is_example, CLOSE).otherwise("")))
    read = rows.select("conv", "no", parts.alias("parts"), F.when(is_example, unescape(cut(F.col("start")))).otherwise("").alias("reply"), F.length("text").alias("chars"))
    piece = F.struct("no", F.array_join(F.transform("parts", lambda p: line(_turn(p))), "").alias("lines"), "reply")
    whole = read.groupBy("conv").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum(F.size("parts")).alias("n"), F.max("chars").alias("chars"))
    joined = whole.select("conv", "n", "chars", F.array_join("pieces.lines", "").alias("lines"), F.array_join("pieces.reply", "").alias("loss"))
    return joined.select(
        "conv.conv_id",
        F.col("n").cast("long").alias("n_turns"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )
