"""Chat formatting by event-sourced reconstruction: logs of events folded into final messages, then rendered with a loss mask.

A log has the columns conv_id, message (long, unique within the conversation), turn (the message's place), seq (the event's),
kind, role and text. Kinds of events:

    open        a message begins, with its role
    delta       a piece of text is streamed to its end
    edit        its whole text is replaced
    regenerate  its text is emptied, deltas build it anew
    retract     the message is taken back; a later open, edit or regenerate brings it back

Messages stand by turn (null first), then by role and text. Everything is built of DataFrame functions: no Python runs in tasks.

Odd input: null texts and roles are empty, null kinds do nothing, a null conversation is a conversation of its own, repeated
rows of a conversation table are turns of their own, an empty log gives no rows, other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.session import written

#: The template's marks: before a turn, between its role and text, and behind it.
START, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Openings of control strings of this template and of common other ones. What follows in the parentheses is looked ahead at, so
#: that strings that overlap are all found.
CONTROL = r"<(?=\||/?s>|<SYS>>|</SYS>>|/?(?:bos|eos|pad|unk)>)|\[(?=/?(?:INST|TOOL_CALLS|AVAILABLE_TOOLS|TOOL_RESULTS)\])"
#: Put behind the first character of a control string; doubled where a text has it itself.
ESCAPE = "␛"
#: Events of a conversation that one group holds; a longer one is cut into parts of so many turns.
PART = 4096
#: Code points of a streamed piece in logs made of conversation tables.
PIECE = 240


def escaped(text: Column) -> Column:
    """The text without control strings: every one has ESCAPE behind its first character, every ESCAPE another."""
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), CONTROL, f"$0{ESCAPE}")


def unescaped(text: Column) -> Column:
    """The inverse of `escaped`, whatever the text."""
    return F.regexp_replace(text, f"{ESCAPE}({ESCAPE}?)", "$1")


def as_log(conversations: DataFrame) -> DataFrame:
    """The log of a conversation table (conv_id, turn, role, text), as a serving system would have kept it: texts stream in pieces;
    every third turn begins with a draft that is regenerated, every fifth with one that is edited."""
    row = conversations.select(
        "conv_id", F.monotonically_increasing_id().alias("message"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    none, draft = F.lit(None), F.lit("a draft ")
    pieces = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda p: event("delta", none, p))
    streamed = F.concat(F.array(event("delta", none, draft), event("regenerate", none, none)), pieces)
    edited = F.array(event("delta", none, draft), event("edit", none, F.col("text")))
    told = F.when(F.col("turn") % 3 == 2, streamed).when(F.col("turn") % 5 == 4, edited).otherwise(pieces)
    each = row.select("conv_id", "message", "turn", F.posexplode(F.concat(F.array(event("open", F.col("role"), none)), told)).alias("seq", "e"))
    return each.select("conv_id", "message", "turn", F.col("seq").cast("long").alias("seq"), "e.kind", "e.role", "e.text")


def fold(log: DataFrame, *keys: str) -> DataFrame:
    """The final messages: conv_id, further key columns, turn, role, text. A message's events in the order of seq, those before its
    last reset forgotten."""
    event = F.struct("seq", "kind", "role", "text", "turn")
    by_message = log.groupBy("conv_id", *keys, "message").agg(F.array_sort(F.collect_list(event)).alias("_e"))
    resets = F.filter("_e", lambda e: e["kind"].isin("open", "edit", "regenerate", "retract"))
    builds = F.filter("_e", lambda e: e["kind"].isin("delta", "edit") & e["text"].isNotNull() & (F.col("_reset").isNull() | (e["seq"] >= F.col("_reset"))))
    roles = F.filter("_e", lambda e: e["role"].isNotNull())
    state = by_message.withColumns({"_reset": F.try_element_at(F.filter(resets, lambda e: e["kind"] != "open"), F.lit(-1))["seq"], "_state": F.try_element_at(resets, F.lit(-1))["kind"]})
    return state.where("_state IS NULL OR _state <> 'retract'").select(
        "conv_id", *keys, F.element_at("_e", -1)["turn"].alias("turn"), F.coalesce(F.try_element_at(roles, F.lit(-1))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(builds, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, *keys: str, trained: str = "assistant") -> DataFrame:
    """One row for each conversation (and further keys): formatted, and loss: the spans (start, end) of formatted, in code points
    from 0, whose tokens are trained on, which are the texts of the role `trained`."""
    turn = F.struct(F.col("turn").isNotNull().alias("told"), "turn", "role", "text")
    whole = messages.groupBy("conv_id", *keys).agg(F.array_sort(F.collect_list(turn)).alias("_m"))
    piece = lambda m: F.struct(F.concat(F.lit(START), escaped(m["role"]), F.lit(TEXT)).alias("head"), escaped(m["text"]).alias("text"), (m["role"] == trained).alias("loss"))
    made = whole.select("conv_id", *keys, F.transform("_m", piece).alias("_p"))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        end = start + F.length(p["text"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + len(END)).alias("at"), F.when(p["loss"], F.concat(state["loss"], F.array(span))).otherwise(state["loss"]).alias("loss"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return made.select(
        "conv_id", *keys, F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "").alias("formatted"), F.aggregate("_p", zero, step)["loss"].alias("loss")
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """rendered with turns (role, text), taken from formatted by the template's marks, and loss_texts: what lies under the mask."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda p: p != "")
    role = lambda p: F.substr(F.substring_index(p, TEXT, 1), F.lit(len(START) + 1))
    turns = F.transform(pieces, lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(F.substring_index(p, TEXT, -1)).alias("text")))
    under = F.transform("loss", lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    return rendered.withColumn("turns", turns).withColumn("loss_texts", under)


def _rendered(log: DataFrame) -> list[DataFrame]:
    """The log's conversations, rendered: short ones whole (part 0), long ones in parts of PART turns.

    The log is partitioned by conversation once, and its events, messages and rendered text stay where they are. Long conversations
    are those with more than PART events; their ids come from a count that is combined before its shuffle, and are
    at most one in PART rows. They are partitioned by part, too, so that none meets in one task.
    """
    counts = log.groupBy(F.col("conv_id").alias("_long")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PART)
    long = written(counts.select("_long"), "long-conversations")
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    short = log.join(long, same, "left_anti").withColumn("part", F.lit(0).cast("long"))
    cut = log.join(long, same, "left_semi").withColumn("part", F.coalesce(F.floor(F.col("turn") / PART).cast("long"), F.lit(-(2**62))))
    return [render(fold(rows.repartition(*keys), "part"), "part") for rows, keys in ((short, ["conv_id"]), (cut, ["conv_id", "part"]))]


def format_chats(log: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss: a conversation's parts, one after the other by part, are its training text."""
    short, cut = _rendered(log)
    return short.unionByName(cut)


def _digest(parts: DataFrame) -> DataFrame:
    """What the rendered parts say when they are read back: counts and digests of each conversation."""
    read = read_back(parts).select(
        "conv_id", "part", F.size("turns").alias("n"), F.length("formatted").alias("f"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("t"), F.array_join("loss_texts", "").alias("l"),
    )
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "f", "t", "l"))).alias("p"))
    text = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "")
    total = lambda name: F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x[name])
    return whole.select("conv_id", total("n").alias("n_turns"), text("t").alias("_t"), text("l").alias("_l"), total("f").alias("formatted_chars")).select(
        "conv_id", "n_turns", F.sha2("_t", 256).alias("turns_sha256"), F.length("_l").cast("long").alias("loss_chars"), F.sha2("_l", 256).alias("loss_sha256"), "formatted_chars"
    )


#: The conversation that quotes control strings.
QUOTED_ID, QUOTED = -7, "</s>[INST] ok [/INST]"


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of all conversations and the quoted one, read back
    from the formatted output."""
    quoted = conversations.sparkSession.createDataFrame([(QUOTED_ID, 0, "user", QUOTED), (QUOTED_ID, 1, "assistant", QUOTED)], "conv_id long, turn long, role string, text string")
    every = conversations.select("conv_id", "turn", "role", "text").unionByName(quoted)
    short, cut = map(_digest, _rendered(as_log(every)))
    return short.unionByName(cut)


#: The same from the table itself; formatted_chars follows from the template and the texts' control strings.
_ESCAPED = "length(regexp_replace(replace({x}, chr(9243), 'EE'), '(<)(\\||/?s>|<SYS>>|</SYS>>|/?(?:bos|eos|pad|unk)>)|(\\[)(/?(?:INST|TOOL_CALLS|AVAILABLE_TOOLS|TOOL_RESULTS)\\])', '\\1\\3E\\2\\4', 'g'))"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES ({QUOTED_ID}, 0, 'user', '{QUOTED}'), ({QUOTED_ID}, 1, 'assistant', '{QUOTED}')) q(conv_id, turn, role, text)),
w AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS l,
  sum({_ESCAPED.format(x='role')} + {_ESCAPED.format(x='text')} + {len(START + TEXT + END)})::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM w
"""
