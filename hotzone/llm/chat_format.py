"""Operator 3: chat formatting (DataFrame functions only).

A declarative template marks the turns; a finite-state machine over the roles
validates their order; text segments carry loss flags. Control strings inside
texts are escaped reversibly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotzone.llm.common import register, table


@dataclass(frozen=True)
class Role:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, the allowed moves between roles and the roles that may
    end a conversation. Any other role is written out between ``other`` marks."""

    roles: dict[str, Role] = field(default_factory=lambda: {
        "system": Role("<<SYS>>", "<</SYS>>"),
        "user": Role("[INST]", "[/INST]"),
        "assistant": Role("<s>", "</s>", loss=True),
    })
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    })
    ends: tuple[str, ...] = ("assistant",)
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")

    def controls(self) -> list[str]:
        marks = [m for r in self.roles.values() for m in (r.opens, r.closes)] + list(self.other)
        return sorted(set(marks), key=lambda m: (-len(m), m))


LLAMA = Template()
BLOCK_TURNS = 64
ENTITY = {"<": "&lt;", "[": "&lsqb;"}


def escape(text: Column, t: Template) -> Column:
    """No control string is left: '&' becomes an entity, and so does the first
    character of every control string."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c in t.controls():
        out = F.replace(out, F.lit(c), F.lit(ENTITY[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for char, entity in ENTITY.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _case(role: Column, t: Template, of, default: Column) -> Column:
    out = None
    for name, r in t.roles.items():
        out = F.when(role == name, of(r)) if out is None else out.when(role == name, of(r))
    return out.otherwise(default)


def _move_ok(before: Column, after: Column, t: Template) -> Column:
    out = F.lit(False)
    for a, bs in t.moves.items():
        out = out | ((before == a) & after.isin(*bs))
    return out


def format_chats(turns: DataFrame, template: Template = LLAMA, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv, n_turns, valid, segments, formatted, loss_chars``.

    ``segments`` is an array of (text, loss) whose texts joined are
    ``formatted``; ``valid`` tells whether the roles follow the template's
    moves from its start to one of its ends (an invalid conversation is still
    formatted). Turns are ordered by (turn, role, text), nulls first, so ties
    and repeated rows have one order. Null role or text reads as ''; rows with
    a null id form one conversation; other columns are ignored.

    Turns are first put together in blocks of 64 turn numbers, so a hot
    conversation is spread over many tasks; only its finished blocks meet in
    its one output row.
    """
    t = template
    r, x = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    esc = escape(F.col("x"), t)
    opens = _case(F.col("r"), t, lambda z: F.lit(z.opens),
                  F.concat(F.lit(t.other[0]), escape(F.col("r"), t), F.lit(t.other[1])))
    closes = _case(F.col("r"), t, lambda z: F.lit(z.closes), F.lit(t.other[2]))
    loss = _case(F.col("r"), t, lambda z: F.lit(z.loss), F.lit(False))
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).alias("n"), r.alias("r"), x.alias("x"))
    rows = rows.select("c", F.floor(F.col("n") / BLOCK_TURNS).alias("b"), "n", "r", "x", F.struct(
        F.array(F.struct(opens.alias("text"), F.lit(False).alias("loss")),
                F.struct(esc.alias("text"), loss.alias("loss")),
                F.struct(closes.alias("text"), F.lit(False).alias("loss"))).alias("s")).alias("o"))
    blocks = rows.groupBy("c", "b").agg(F.sort_array(F.collect_list(F.struct("n", "r", "x", "o"))).alias("t"))
    inner_ok = F.forall(F.sequence(F.lit(1), F.size("t")), lambda i: (i == F.size("t")) | _move_ok(
        F.get(F.col("t"), i - 1)["r"], F.get(F.col("t"), i)["r"], t))
    blocks = blocks.select(
        "c", "b", F.size("t").alias("k"), inner_ok.alias("ok"),
        F.get("t", F.lit(0))["r"].alias("first"), F.element_at("t", -1)["r"].alias("last"),
        F.flatten(F.transform("t", lambda z: z["o"]["s"])).alias("s"))
    conv_rows = blocks.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("b", "k", "ok", "first", "last", "s"))).alias("p"))
    p = F.col("p")
    joined = F.forall(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(p, i)["ok"] & _move_ok(
        F.when(i == 0, F.lit("")).otherwise(F.get(p, i - 1)["last"]), F.get(p, i)["first"], t))
    out = conv_rows.select(
        F.col("c").alias(conv), F.aggregate(p, F.lit(0).cast("long"), lambda a, z: a + z["k"]).alias("n_turns"),
        (joined & F.element_at(p, -1)["last"].isin(*t.ends)).alias("valid"),
        F.flatten(F.transform(p, lambda z: z["s"])).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda z: z["text"]), ""))


def read_turns(formatted: Column, template: Template = LLAMA) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    t = template
    closers = sorted({r.closes for r in t.roles.values()} | {t.other[2]})
    pattern = "|".join(r"\Q" + c + r"\E" for c in closers)
    parts = F.split(formatted, pattern, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def read(seg: Column) -> Column:
        head = F.substring_index(seg, t.other[1], 1)
        out = None
        for name, r in t.roles.items():
            body = F.struct(F.lit(name).alias("role"), unescape(seg.substr(F.lit(len(r.opens) + 1), F.length(seg))).alias("text"))
            out = F.when(F.startswith(seg, F.lit(r.opens)), body) if out is None else out.when(F.startswith(seg, F.lit(r.opens)), body)
        return out.otherwise(F.struct(
            unescape(head.substr(F.lit(len(t.other[0]) + 1), F.length(head))).alias("role"),
            unescape(seg.substr(F.length(head) + len(t.other[1]) + 1, F.length(seg))).alias("text")))

    return F.transform(parts, read)


PROBE = "</s>[INST] ok [/INST]"


@register("op3_chat_format", sql=r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'),
    '<</SYS>>', '&lt;</SYS>>'), '<|role|>', '&lt;|role|>'), '<|text|>', '&lt;|text|>'), '<<SYS>>', '&lt;<SYS>>'),
    '<|end|>', '&lt;|end|>'), '[/INST]', '&lsqb;/INST]'), '[INST]', '&lsqb;INST]'), '</s>', '&lt;/s>'), '<s>', '&lt;s>') AS esc FROM c),
a AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE 23 + length(role) END) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT * FROM a
""")
def op3_chat_format(spark, sf_dir):
    """All conversations formatted, then read back from the formatted text and the segments."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        f"SELECT bigint(-1) AS conv_id, bigint(t) AS turn, r AS role, '{PROBE}' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    out = format_chats(turns.unionByName(probe))
    back = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), unescape(F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")).alias("learnt"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda z: F.concat(z["role"], F.lit("\n"), z["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
