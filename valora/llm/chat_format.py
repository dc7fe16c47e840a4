"""Chat formatting: a machine over roles checks the order of turns, a template writes them.

Everything is a column expression: the turns of a conversation become one array, the machine
is a fold over its roles, and the template turns each turn into three text segments (header,
text, end mark), each with a flag that says whether it counts in the loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written, which of them are learned, and which order of roles is valid.

    ``labels`` are the names of known roles in headers; another role is written as it is,
    behind ``other``. ``escapes`` replaces, in texts and roles, each character that begins a
    control string, and the escape character itself: no control string can then occur in an
    escaped text, and undoing the pairs in reverse order gives the text back.
    """

    labels: dict[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"}
    )
    other: str = "Role="
    head: str = "### "
    colon: str = ": "
    end: str = " </turn>\n"
    learned: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (
        ("\\", "\\b"),
        ("#", "\\h"),
        ("<", "\\l"),
        (":", "\\c"),
        ("=", "\\e"),
    )
    start: str = "start"
    steps: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered", "asked")


def escaped(text: Column, template: Template) -> Column:
    for plain, code in template.escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, template: Template) -> Column:
    for plain, code in reversed(template.escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _header(role: Column, template: Template) -> Column:
    label = F.concat(F.lit(template.other), escaped(role, template))
    for name, known in template.labels.items():
        label = F.when(role == name, F.lit(known)).otherwise(label)
    return F.concat(F.lit(template.head), label, F.lit(template.colon))


def _machine(roles: Column, template: Template) -> Column:
    """(state, place of the first turn that has no step or -1, turns read) after all roles."""

    def step(at: Column, role: Column) -> Column:
        target = F.lit(None).cast("string")
        for state, out in template.steps.items():
            for name, after in out.items():
                here = (at["state"] == state) & (role == name)
                target = F.when(here, F.lit(after)).otherwise(target)
        broken = (at["bad"] < 0) & target.isNull()
        return F.struct(
            F.coalesce(target, at["state"]).alias("state"),
            F.when(broken, at["read"]).otherwise(at["bad"]).alias("bad"),
            (at["read"] + 1).alias("read"),
        )

    zero = F.struct(
        F.lit(template.start).alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("read")
    )
    return F.aggregate(roles, zero, step)


def format_chats(
    turns: DataFrame,
    template: Template = Template(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation, also of those in a wrong order, which ``valid`` marks.

    Columns: ``conv_id``, ``valid``, ``bad_turn`` (place of the first turn out of order, -1
    if none), ``segments`` array of (text, loss), ``formatted`` (the segments in a row).
    Turns are ordered by turn, then role, then text, nulls first; repeated rows are repeated
    turns. Null text and null role count as empty; an empty or unknown role is out of order.
    A null conversation id is a conversation. Other columns are not read; an empty table
    gives no rows. A conversation is one training sample and so one row of the result.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )

    def pieces(t: Column) -> Column:
        learned = t["role"].isin(*template.learned)
        return F.array(
            F.struct(_header(t["role"], template).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"], template).alias("text"), learned.alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    written = grouped.select(
        "conv_id",
        _machine(F.transform("turns", lambda t: t["role"]), template).alias("machine"),
        F.flatten(F.transform("turns", pieces)).alias("segments"),
    )
    return written.select(
        "conv_id",
        ((F.col("machine.bad") < 0) & F.col("machine.state").isin(*template.final)).alias("valid"),
        F.col("machine.bad").alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns of ``formatted`` text again, as ``turns`` array of (role, text)."""

    def turn(part: Column) -> Column:
        label = F.substring_index(part, template.colon, 1)
        label = F.substring(label, len(template.head) + 1, 1 << 30)
        text = F.substring(
            part, F.length(label) + len(template.head) + len(template.colon) + 1, F.length(part)
        )
        role = unescaped(F.substring(label, len(template.other) + 1, 1 << 30), template)
        for name, known in template.labels.items():
            role = F.when(label == known, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescaped(text, template).alias("text"))

    parts = F.split(F.col("formatted"), "\\Q" + template.end + "\\E", -1)
    whole = F.slice(parts, 1, F.size(parts) - 1)
    return formatted.withColumn("turns", F.transform(whole, turn))


#: The conversation of the contract, whose texts hold control strings.
ODD_TEXT = "\\### Assistant: </turn> ok"


def chat_query(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, read back from the formatted text."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = table.select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ODD_TEXT).alias("text"),
    )
    template = Template()
    out = read_back(format_chats(rows.unionByName(odd), template), template)
    line = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))),
        "",
    )
    learned = F.array_join(
        F.transform(
            F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template)
        ),
        "",
    )
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        learned.alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


def _sql() -> str:
    t = Template()

    def coded(value: str) -> str:
        return f"(length({value}) + " + " + ".join(
            f"length({value}) - length(replace({value}, '{plain}', ''))" for plain, _ in t.escapes
        ) + ")"

    head = "CASE role " + " ".join(
        f"WHEN '{k}' THEN {len(v)}" for k, v in t.labels.items()
    ) + f" ELSE {len(t.other)} + {coded('role')} END"
    return f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{ODD_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{ODD_TEXT}'),
steps AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM turns),
checked AS (SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user')
    WHEN before = 'user' THEN role = 'assistant' ELSE role = 'user' END AS ok FROM steps)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(t.head) + len(t.colon) + len(t.end)} + {head} + {coded('text')}) AS BIGINT) AS formatted_chars,
  bool_and(ok) AND NOT (count(*) = 1 AND bool_or(role = 'system')) AS valid
FROM checked GROUP BY conv_id"""


SQL = _sql()
