"""Chat formatting from a declarative template, with DataFrame operations only.

A finite-state machine over roles judges the order of turns; the text comes out as segments, each with a
loss flag.  Marks all begin with ``<`` or ``[``.  Inside texts every ``<``, ``[`` and backslash is followed
by a backslash, so no mark can occur there, and one pass takes the escapes out again.

Turns of a conversation are gathered, since its digest is of all of them in order: memory is bounded by one
conversation.  Defined cases: null texts are empty, null roles are the empty role; roles without a rule in
the template get a generic mark and make the order invalid; equal turn numbers are ordered by role, then
text, and repeated rows stay; null conv_ids form one conversation; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    opens: str
    closes: str
    loss: bool
    after: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """``after`` of a role names the states it may follow; ``start`` is the empty conversation. ``final``: where one may end."""

    begin: str = "<s>"
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("[SYS] ", "[/SYS]\n", False, ("start",)),
            "user": Role("[INST] ", "[/INST]", False, ("start", "system", "assistant")),
            "assistant": Role("[REPLY] ", "</s>", True, ("user",)),
        }
    )
    other: tuple[str, str, str] = ("[ROLE] ", "[/ROLE]", "[/TURN]")
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        for mark in (self.begin, *self.other, *(m for r in self.roles.values() for m in (r.opens, r.closes))):
            if not mark or mark[0] not in "<[" or any(c in "<[\\" for c in mark[1:]) or "'" in mark:
                raise ValueError(f"{mark!r} must begin with < or [ and hold no other such character, backslash or quote")


DEFAULT = Template()


def _q(text: str) -> str:
    return "'" + text.replace("\n", "\\n") + "'"


def escape_sql(text: str) -> str:
    return rf"regexp_replace({text}, '([<\\[\\\\])', '$1\\\\')"


def unescape_sql(text: str) -> str:
    return rf"regexp_replace({text}, '([<\\[\\\\])\\\\', '$1')"


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted, segments (array of text, loss; joined they are ``formatted``), valid, first_error (turn place or null)."""
    gathered = (
        turns.select("conv_id", F.struct("turn", F.expr("coalesce(role, '')").alias("role"), F.expr("coalesce(text, '')").alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
    )
    text = escape_sql("x.text")
    cases = " ".join(
        f"WHEN x.role = {_q(name)} THEN array(struct({_q(r.opens)} AS text, false AS loss), struct({text} AS text, {str(r.loss).lower()} AS loss), struct({_q(r.closes)} AS text, false AS loss))"
        for name, r in template.roles.items()
    )
    a, b, c = map(_q, template.other)
    other = f"array(struct({a} AS text, false AS loss), struct({escape_sql('x.role')} AS text, false AS loss), struct({b} AS text, false AS loss), struct({text} AS text, false AS loss), struct({c} AS text, false AS loss))"
    moves = ", ".join(f"'{prev}>{name}'" for name, r in template.roles.items() for prev in r.after)
    made = gathered.select(
        "conv_id", "t",
        F.expr(f"concat(array(struct({_q(template.begin)} AS text, false AS loss)), flatten(transform(t, x -> CASE {cases} ELSE {other} END)))").alias("segments"),
        F.expr(f"""array_min(transform(filter(transform(t, (x, i) -> struct(i AS i, array_contains(array({moves}),
                   concat(CASE WHEN i = 0 THEN 'start' ELSE coalesce(get(t, i - 1).role, '') END, '>', x.role)) AS ok)), y -> NOT y.ok), y -> y.i))""").alias("first_error"),
        F.expr(f"array_contains(array({', '.join(map(_q, template.final))}), element_at(t, -1).role)").alias("ended"),
    )
    return made.select(
        "conv_id",
        F.expr("array_join(transform(segments, x -> x.text), '')").alias("formatted"),
        "segments",
        F.expr("first_error IS NULL AND ended").alias("valid"),
        "first_error",
    )


def read_turns_sql(formatted: str, template: Template = DEFAULT) -> str:
    """Array of (role, text) read from formatted text alone: it is cut before each mark, and the mark tells the role."""
    pieces = rf"split({formatted}, '(?=[<\\[](?!\\\\))')"
    a, b, _ = template.other
    opened = " ".join(
        f"WHEN startswith(p, {_q(r.opens)}) THEN struct({_q(name)} AS role, {unescape_sql(f'substring(p, {len(r.opens) + 1})')} AS text)" for name, r in template.roles.items()
    )
    named = f"struct({unescape_sql(f'substring(get(ps, i - 1), {len(a) + 1})')} AS role, {unescape_sql(f'substring(p, {len(b) + 1})')} AS text)"
    # ``ps`` is bound by a one-element array, as SQL has no let
    return f"""filter(flatten(transform(array({pieces}), ps -> transform(ps, (p, i) -> CASE {opened} WHEN startswith(p, {_q(b)}) THEN {named} END))), r -> r IS NOT NULL)"""


def digest_chats(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Digests read back from the output of :func:`format_chats`."""
    read = formatted.select(
        "conv_id", "formatted", "valid",
        F.expr(read_turns_sql("formatted", template)).alias("turns"),
        F.expr("array_join(transform(filter(segments, x -> x.loss), x -> " + unescape_sql("x.text") + "), '')").alias("loss_text"),
    )
    return read.select(
        "conv_id",
        F.expr("size(turns)").cast("long").alias("n_turns"),
        F.expr(r"sha2(array_join(transform(turns, x -> concat(x.role, '\n', x.text, '\n')), ''), 256)").alias("turns_sha256"),
        F.expr("length(loss_text)").cast("long").alias("loss_chars"),
        F.expr("sha2(loss_text, 256)").alias("loss_sha256"),
        F.expr("length(formatted)").cast("long").alias("formatted_chars"),
        "valid",
    )
