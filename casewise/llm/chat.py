"""Chat formatting from a declarative template; DataFrame functions only.

``TEMPLATE`` gives each role the strings around its text and whether the text counts for the loss;
``ORDER`` is the finite-state machine over roles. A conversation becomes segments (text, loss) whose
concatenation is the formatted text. Control strings within a text are escaped: a backslash goes
in after their first character, and a backslash is doubled, so a formatted text holds a control
string only where the template put it, and ``read_back`` returns the turns exactly. Between a control
string and a text stands a space, so none can arise across the border.

The machine says of each conversation whether it is ``complete`` (ends with an answer), ``open`` (ends
with a question, or with the system text) or ``bad`` (an order or role it does not know), and at which
turn; all are formatted.

Turns are put in order by turn, then role, then text, nulls first; null texts and roles count as
empty, and a null conv_id is a conversation. A role the template does not name is written with its name.
Repeated rows are turns. An empty table gives no rows. Other columns are not read. A conversation is one
value of the result, so its turns come together in one row; nothing else is gathered.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import prepare

BEGIN = "<s>"
# Role: what goes before the text, what goes after it, and whether the text is learned.
TEMPLATE = {
    "system": ("<<SYS>> ", " <</SYS>>", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<a> ", " </s>", True),
}
# Any other role: its name stands between the first two.
OTHER = ("<r> ", " </r> ", " </t>", False)
CONTROL = [BEGIN, *[s.strip() for t in TEMPLATE.values() for s in t[:2]], *[s.strip() for s in OTHER[:3]]]

# State and role to state; what is not here is "bad" and stays so.
ORDER = {
    ("start", "system"): "told",
    ("start", "user"): "asked",
    ("told", "user"): "asked",
    ("asked", "assistant"): "answered",
    ("answered", "user"): "asked",
}
STATUS = {"start": "open", "told": "open", "asked": "open", "answered": "complete", "bad": "bad"}


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(turn: Column) -> Column:
    """The segments of a turn: text and loss flag."""
    role, text = turn["role"], escaped(turn["text"])
    plain = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))
    said = lambda loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    out = F.array(plain(F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]))), said(OTHER[3]), plain(F.lit(OTHER[2])))
    for name, (before, after, loss) in TEMPLATE.items():
        out = F.when(role == name, F.array(plain(F.lit(before)), said(loss), plain(F.lit(after)))).otherwise(out)
    return out


def _next(state: Column, role: Column) -> Column:
    out = F.lit("bad")
    for (before, name), after in ORDER.items():
        out = F.when((state == before) & (role == name), F.lit(after)).otherwise(out)
    return out


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, segments (array of text and loss), formatted, status, bad_turn (place of the first turn out of order, from 0)."""
    prepare(conversations.sparkSession)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"))
    walk = F.aggregate(
        "turns",
        start,
        lambda s, t: F.struct(
            _next(s["state"], t["role"]).alias("state"),
            F.when(s["state"] == "bad", s["at"]).when(_next(s["state"], t["role"]) == "bad", s["at"]).otherwise(s["at"] + 1).alias("at"),
        ),
    )
    status = F.lit(None).cast("string")
    for state, name in STATUS.items():
        status = F.when(F.col("walk.state") == state, F.lit(name)).otherwise(status)
    begin = F.array(F.struct(F.lit(BEGIN).alias("text"), F.lit(False).alias("loss")))
    made = chats.withColumn("walk", walk).withColumn("segments", F.concat(begin, F.flatten(F.transform("turns", _segments))))
    return made.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        status.alias("status"),
        F.when(F.col("walk.state") == "bad", F.col("walk.at")).alias("bad_turn"),
    )


def _between(turn: Column, before: str, after: str) -> Column:
    return F.substring(turn, F.lit(len(before) + 1), F.length(turn) - len(before) - len(after))


def _turn_read(turn: Column) -> Column:
    name = F.substring_index(F.substring(turn, F.lit(len(OTHER[0]) + 1), F.length(turn)), OTHER[1], 1)
    head = F.length(name) + len(OTHER[0]) + len(OTHER[1])
    text = F.substring(turn, head + 1, F.length(turn) - head - len(OTHER[2]))
    read = lambda role, said, loss: F.struct(role.alias("role"), unescaped(said).alias("text"), F.lit(loss).alias("loss"))
    out = read(unescaped(name), text, OTHER[3])
    for role, (before, after, loss) in TEMPLATE.items():
        out = F.when(turn.startswith(before), read(F.lit(role), _between(turn, before, after), loss)).otherwise(out)
    return out


def read_back(formatted: Column) -> Column:
    """Array of the turns (role, text, loss) in a formatted text."""
    pairs = [*[(b, a) for b, a, _ in TEMPLATE.values()], (OTHER[0], OTHER[2])]
    pattern = "(?s)" + "|".join(f"{re.escape(b)}.*?{re.escape(a)}" for b, a in pairs)
    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), _turn_read)


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Figures of each conversation, all taken from its formatted text: see ``read_back``."""
    made = format_chats(conversations).withColumn("turns", read_back(F.col("formatted")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return made.select("conv_id", F.size("turns").cast("long").alias("n_turns"), spoken.alias("spoken"), learned.alias("learned"), "formatted", "status").select(
        "conv_id",
        "n_turns",
        F.sha2("spoken", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "status",
    )


def with_trial(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts hold the template's own control strings."""
    spark: SparkSession = conversations.sparkSession
    trial = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(trial)


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


def _around_sql() -> str:
    cases = " ".join(f"WHEN '{r}' THEN {len(b) + len(a)}" for r, (b, a, _) in TEMPLATE.items())
    return f"CASE role {cases} ELSE {len(OTHER[0]) + len(OTHER[1]) + len(OTHER[2])} + length({_escaped_sql('role')}) END"


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
chats AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS spoken,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
    {len(BEGIN)} + sum(length({_escaped_sql('text')}) + {_around_sql()}) AS formatted_chars,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, ''
      ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars,
  CASE WHEN regexp_full_match(roles, 's?(ua)+') THEN 'complete' WHEN regexp_full_match(roles, 's?(ua)*u|s') THEN 'open' ELSE 'bad' END AS status
FROM chats
"""
