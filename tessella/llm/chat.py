"""Chat formatting with a role automaton and per-segment loss flags.

Only built-in expressions are used. A template is plain data: the control strings
around each turn, what the loss covers, the escapes that keep control strings out of
texts, and the automaton that says which role may follow which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ``{role}`` in ``open`` stands for the turn's role. Escapes are applied in order and
#: undone in reverse; after them a text holds no "<", and every control string starts
#: with one, so control strings inside texts can't be taken for real ones.
TURNS = {
    "open": "<|{role}|>\n",
    "close": "<|end|>\n",
    "read": r"<\|([^|<]*)\|>\n([^<]*)<\|end\|>\n",
    "escapes": (("&", "&amp;"), ("<", "&lt;")),
    "role_escapes": (("|", "&#124;"),),
    "loss_on": ("assistant",),
    "start": "start",
    "moves": {
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    "ends": ("assistant",),
}


def _escaped(c: Column, pairs) -> Column:
    for plain, safe in pairs:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def _unescaped(c: Column, pairs) -> Column:
    for plain, safe in reversed(pairs):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def _next_state(state: Column, role: Column, template: dict) -> Column:
    out = F.lit("error")
    for (now, seen), then in template["moves"].items():
        out = F.when((state == now) & (role == seen), F.lit(then)).otherwise(out)
    return out


def format_chat(rows: DataFrame, template: dict = TURNS) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` -> one row per conversation:
    ``conv_id, n_turns, segments array<struct<content, loss>>, valid, error_turn``.

    Turns are ordered by (turn, role, text), nulls first; a repeated row is a turn of its
    own. A null text or role is the empty string. A null conv_id makes one conversation.
    ``valid`` says whether the automaton accepts the roles; ``error_turn`` is the position
    from 0 of the first turn that it doesn't allow, the number of turns if only the end is
    wrong, else null. Conversations that aren't valid are formatted all the same. Other
    columns are ignored; no rows give no rows.
    """
    turns = (
        rows.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    before, after = template["open"].split("{role}")

    def parts(t: Column) -> Column:
        role = _escaped(_escaped(t["role"], template["escapes"]), template["role_escapes"])
        learn = t["role"].isin(*template["loss_on"])
        seg = lambda content, loss: F.struct(content.alias("content"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(
            seg(F.concat(F.lit(before), role, F.lit(after)), no),
            seg(_escaped(t["text"], template["escapes"]), learn),
            seg(F.lit(template["close"]), no),
        )

    start = F.struct(F.lit(template["start"]).alias("s"), F.lit(0).cast("long").alias("n"))
    run = F.aggregate(
        "turns",
        start,
        lambda acc, t: F.when(acc["s"] == "error", acc).otherwise(
            F.struct(_next_state(acc["s"], t["role"], template).alias("s"), (acc["n"] + F.when(_next_state(acc["s"], t["role"], template) == "error", 0).otherwise(1)).alias("n"))
        ),
    )
    out = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", parts)).alias("segments"), run.alias("run"))
    valid = F.col("run.s").isin(*template["ends"])
    return out.select("conv_id", "n_turns", "segments", valid.alias("valid"), F.when(~valid, F.col("run.n")).alias("error_turn"))


def formatted(segments: Column | str) -> Column:
    """The text that a model is given."""
    return F.array_join(F.transform(segments, lambda s: s["content"]), "")


def read_turns(text: Column, template: dict = TURNS) -> Column:
    """Undo the formatting: array of struct(role, text)."""
    roles = F.regexp_extract_all(text, F.lit(template["read"]), F.lit(1))
    texts = F.regexp_extract_all(text, F.lit(template["read"]), F.lit(2))
    plain_role = lambda r: _unescaped(_unescaped(r, template["role_escapes"]), template["escapes"])
    return F.zip_with(roles, texts, lambda r, t: F.struct(plain_role(r).alias("role"), _unescaped(t, template["escapes"]).alias("text")))


def loss_text(segments: Column | str, template: dict = TURNS) -> Column:
    """All text under the loss, unescaped, in order."""
    return _unescaped(formatted(F.filter(segments, lambda s: s["loss"])), template["escapes"])
