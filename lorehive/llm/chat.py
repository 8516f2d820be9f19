"""Chat formatting with a grammar round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template. None holds a line break, and the template puts a line break
# between them and a text, so no control string can form across that border.
CONTROL = r"(<s>|</s>|\[INST\]|\[/INST\])"
ESCAPE = r"(\\*)" + CONTROL
UNESCAPE = r"\\(\\*)" + CONTROL
OPEN = r"(?<!\\)(?:<s>|</s>|\[INST\]|\[/INST\])"
# One turn: from an opening control string to the next closing one.
TURN = r"(?s)(?<!\\)(<s>|\[INST\])(.*?)\n(</s>|\[/INST\])"


def escape(text: Column) -> Column:
    """One more backslash in front of each control string, behind which there may be others."""
    return F.regexp_replace(text, ESCAPE, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def render_turn(role: Column, text: Column, escaped: bool = True) -> Column:
    """A turn of the template: users and others between [INST] and [/INST], with their role on the
    first line; the assistant between <s> and </s>."""
    body = escape(text) if escaped else text
    asked = F.concat(F.lit("[INST]"), _role_out(role), F.lit("\n"), body, F.lit("\n[/INST]"))
    return F.when(role == "assistant", F.concat(F.lit("<s>\n"), body, F.lit("\n</s>"))).otherwise(asked)


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text, loss). Deterministic: control
    strings without a backslash in front alternate between opening and closing ones. Null if
    anything is left over, or a turn holds another control string."""
    whole = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    kinds = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    inner = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    ends = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(3))

    def turn(x: Column) -> Column:
        at = F.instr(x["inner"], "\n")
        loss = x["kind"] == "<s>"
        role = F.when(loss, F.lit("assistant")).otherwise(_role_in(F.substring(x["inner"], F.lit(1), at - 1)))
        raw = F.substring(x["inner"], at + 1, F.length(x["inner"]))
        good = (at > 0) & (F.when(loss, x["end"] == "</s>").otherwise(x["end"] == "[/INST]")) & ~raw.rlike(OPEN)
        return F.struct(role.alias("role"), unescape(raw).alias("text"), loss.alias("loss"), good.alias("good"))

    turns = F.transform(F.arrays_zip(whole.alias("whole"), kinds.alias("kind"), inner.alias("inner"), ends.alias("end")), turn)
    clean = F.forall(turns, lambda t: t["good"]) & (F.array_join(whole, "") == formatted)
    return F.when(clean, F.transform(turns, lambda t: F.struct(t["role"], t["text"], t["loss"])))


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (read back), escaped.

    Each conversation is rendered plainly and parsed again; where the turns that come back differ
    from the source, its texts are rendered with control strings escaped, and parsed again.
    `turns` is what the parser read from `formatted`; it is null only if even that differs.

    Turns are ordered by turn, then role and text; repeated rows stay. Null role or text: empty;
    null turn: first; null conversation: one conversation of its own. Empty table: no rows. Other
    columns are not read. Very long texts are formatted whole. A conversation's text is one string, so its turns meet in one task;
    what is hashed over it can't be split.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), one.alias("one"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("source"))
    conv = conv.withColumn("plain", F.array_join(F.transform("source", lambda t: render_turn(t["role"], t["text"], False)), ""))
    wanted = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["role"] == "assistant").alias("loss")))
    conv = conv.withColumn("wanted", wanted).withColumn("read", parse(F.col("plain")))
    same = F.coalesce(F.col("read") == F.col("wanted"), F.lit(False))
    conv = conv.withColumn("same", same)
    conv = conv.withColumn("formatted", F.when(F.col("same"), F.col("plain")).otherwise(F.array_join(F.transform("source", lambda t: render_turn(t["role"], t["text"])), "")))
    conv = conv.withColumn("read", F.when(F.col("same"), F.col("read")).otherwise(parse(F.col("formatted"))))
    checked = F.when(F.col("read") == F.col("wanted"), F.col("read"))
    return conv.select("conv_id", "formatted", checked.alias("turns"), (~F.col("same")).alias("escaped"))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what format_conversations() read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
