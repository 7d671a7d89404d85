"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example: all turns before it are context, and only that reply is trainable. An
example is a row with the formatted text and the code points where the trainable part starts and ends. A
conversation that does not end with an assistant turn gets one row more, without trainable part, that holds all its
turns, so that the output loses nothing; leave it out where only targets are wanted.

Template: a user turn is `[INST] text [/INST]`, an assistant turn `<s>text</s>`, any other `[TURN role] text [/TURN]`,
one after the other. Inside texts and roles a control string gets a backslash behind its first character, and a
backslash is doubled, so `unescape` gives back the very text.

A conversation is one unit: its longest example is a string that holds all of it, so its segments are gathered once
per conversation. Examples are cut from them one row at a time; no row holds more than one formatted text.

Defined results: a null text or role counts as empty; turns are ordered by turn (a missing one first), then role and
text; repeated rows are turns of their own; rows without conv_id form one conversation; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "[TURN", "[/TURN]")
TURN = r"(?s)\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|\[TURN (.*?)\] (.*?) \[/TURN\]"

#: The closing sign of a role is the first bracket that no backslash precedes. Possessive, so that matching takes no
#: stack however long the role is.
OTHER_TURN = r"(?s)^\[TURN ([^\]\\]*+(?:\\.[^\]\\]*+)*+)\] (.*) \[/TURN\]$"


def escape(text: Column, role: bool = False) -> Column:
    """A role also has its closing bracket escaped, which ends it in the template."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return F.replace(text, F.lit("]"), F.lit("\\]")) if role else text


def unescape(text: Column) -> Column:
    # An escaped bracket is a backslash too, so one rule undoes all: a backslash goes, a doubled one stays once.
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, and its turns in order as an array of formatted segments (`before`, `body`, `behind`, `target`)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def segment(t: Column) -> Column:
        before = F.when(t.role == "user", "[INST] ").when(t.role == "assistant", "<s>").otherwise(
            F.concat(F.lit("[TURN "), escape(t.role, role=True), F.lit("] ")))
        behind = F.when(t.role == "user", " [/INST]").when(t.role == "assistant", "</s>").otherwise(" [/TURN]")
        return F.struct(before.alias("before"), escape(t.text).alias("body"), behind.alias("behind"),
                        (t.role == "assistant").alias("target"))

    return ordered.select("conv_id", F.transform("turns", segment).alias("segments"))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, turn_no (place of the last turn, from 1), text, target_start and target_end (from 0, end exclusive).

    Both ends are null in a row without trainable part.
    """
    parts = segments(turns).withColumn("n", F.size("segments"))
    picks = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("segments", i.cast("int")).target | (i == F.col("n")))
    rows = parts.select("conv_id", "segments", F.explode(picks).alias("turn_no"))
    last = F.element_at("segments", F.col("turn_no"))
    context = F.array_join(F.transform(F.slice("segments", 1, F.col("turn_no") - 1), lambda s: F.concat(s.before, s.body, s.behind)), "")
    cut = rows.select("conv_id", "turn_no", context.alias("context"), last.alias("last"))
    start = F.when(F.col("last.target"), F.length("context") + F.length("last.before"))
    return cut.select("conv_id", "turn_no", F.concat("context", "last.before", "last.body", "last.behind").alias("text"),
                      start.alias("target_start"), (start + F.length("last.body")).alias("target_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id with n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the output alone.

    Turns are parsed from the longest example of a conversation; the loss text is what the examples' trainable
    parts hold, in order.
    """
    target = unescape(F.substring("text", F.col("target_start") + 1, F.col("target_end") - F.col("target_start")))
    rows = formatted.select("conv_id", "turn_no", "text", F.when(F.col("target_start").isNotNull(), target).alias("target"))
    by_conv = rows.groupBy("conv_id").agg(
        F.max_by("text", "turn_no").alias("longest"), F.sum(F.length("text")).cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("turn_no", "target")))).alias("targets"))
    found = F.regexp_extract_all("longest", F.lit(TURN), F.lit(0))

    def turn(s: Column) -> Column:
        other = F.regexp_extract(s, OTHER_TURN, 1)
        role = F.when(s.startswith("<s>"), "assistant").when(s.startswith("[INST]"), "user").otherwise(unescape(other))
        body = F.when(s.startswith("<s>"), F.substring(s, F.lit(4), F.length(s) - 7)).when(
            s.startswith("[INST]"), F.substring(s, F.lit(8), F.length(s) - 15)).otherwise(
            F.regexp_extract(s, OTHER_TURN, 2))
        return F.concat(role, F.lit("\n"), unescape(body), F.lit("\n"))

    loss = F.array_join(F.transform("targets", lambda t: t.target), "")
    return by_conv.select("conv_id", F.size(found).cast("long").alias("n_turns"),
                          F.sha2(F.array_join(F.transform(found, turn), "").cast("binary"), 256).alias("turns_sha256"),
                          F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
                          "formatted_chars")


#: Replaced step by step, as `escape` does.
_SQL_TEXT = "replace(t, '\\', '\\\\')"
for _control in CONTROLS:
    _SQL_TEXT = f"replace({_SQL_TEXT}, '{_control}', '{_control[0]}\\{_control[1:]}')"
_SQL_ROLE = f"replace({_SQL_TEXT.replace('replace(t,', 'replace(r,')}, ']', '\\]')"

ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v
), numbered AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length(CASE r WHEN 'user' THEN '[INST]  [/INST]' WHEN 'assistant' THEN '<s></s>'
      ELSE '[TURN ]  [/TURN]' || {_SQL_ROLE} END) + length({_SQL_TEXT}) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM numbered
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN r = 'assistant' THEN length(t) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum(CASE WHEN r = 'assistant' OR k = n THEN upto END) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id"""
