"""Line-first quality rules, built from SQL expressions only.

Every line of a text is judged on its own (punctuation, shouting, navigation bars, symbol noise,
boilerplate phrases).  Failing lines are taken out, and a document goes when too few of its word
characters are left, or when the text-wide rules (too short, too many repeated five-word windows) fail.
All of it is row-local: no shuffle, and memory is bounded by one text.

Defined cases: a null text counts as an empty one (no words, so ``base_failed``); repeated rows and
ties are judged row by row; an empty table gives an empty result; other columns pass through untouched,
and an existing column named like the output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WS = r" \t\n\u000b\u000c\r"

#: Phrases of page furniture, matched in lower-cased lines of at most ``boilerplate_chars`` characters.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in",
    "privacy policy",
    "sign up",
    "skip to content",
    "subscribe to",
    "terms of use",
)


@dataclass(frozen=True)
class QualityRules:
    """Thresholds; shares are of the line (or of the document's word characters for ``min_left``)."""

    window: int = 5
    min_words: int = 10
    max_repeat_percent: int = 20
    min_left: float = 0.5
    max_separators: int = 2
    max_symbol_share: float = 0.1
    max_shouts: int = 2
    unpunctuated_words: int = 40
    boilerplate_chars: int = 160


def words_sql(text: str) -> str:
    """Array of the words of ``text``: runs of anything but the six ASCII white-space characters."""
    trimmed = f"trim(BOTH '{_WS}' FROM {text})"
    return f"CASE WHEN {trimmed} = '' THEN CAST(array() AS array<string>) ELSE split({trimmed}, '[ \\\\t-\\\\r]+') END"


def line_fails_sql(line: str, rules: QualityRules) -> str:
    """True for a line that a reader of the main text would not miss."""
    phrases = "|".join(BOILERPLATE)
    return f"""(
        regexp_count({line}, '[|»›·•]') > {rules.max_separators}
        OR regexp_count({line}, '[!?]{{2,}}') > {rules.max_shouts}
        OR regexp_count({line}, '[#*$%&<>{{}}~^=_\\\\\\\\]') > {rules.max_symbol_share} * length({line})
        OR (length({line}) <= {rules.boilerplate_chars} AND lower({line}) rlike '{phrases}')
        OR (NOT {line} rlike '[\\\\p{{Punct}}…»”’。！？]' AND regexp_count({line}, '[^ \\\\t-\\\\r]+') > {rules.unpunctuated_words})
    )"""


def assess(docs: DataFrame, text_col: str = "text", out: str = "quality", rules: QualityRules = QualityRules()) -> DataFrame:
    """``docs`` and a struct column ``out``: counts, the cleaned text and the verdicts.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines,
    left_share, clean_text, base_failed, kept.
    """
    w = rules.window
    text = f"`{text_col}`"
    names = docs.columns
    base = docs.select(
        *(F.col(f"`{c}`") for c in names if c != out),
        F.expr(f"coalesce({text}, '')").alias("__t"),
        F.expr(words_sql(f"coalesce({text}, '')")).alias("__w"),
    )
    carried = [F.col(f"`{c}`") for c in names if c != out]
    gets = ", ".join(f"get(__w, __i + {k})" for k in range(w))
    hashed = base.select(
        *carried, "__t", "__w",
        F.expr(f"CASE WHEN size(__w) > {w} THEN transform(sequence(0, size(__w) - {w}), __i -> xxhash64({gets})) END").alias("__h"),
    )
    # Only a text in which some window comes twice pays for the ordering of (hash, place).
    paired = hashed.select(
        *carried, "__t", "__w",
        F.expr("""CASE WHEN size(array_distinct(__h)) < size(__h)
                  THEN sort_array(transform(__h, (__x, __i) -> named_struct('h', __x, 'i', __i))) END""").alias("__p"),
        F.expr("filter(split(__t, '\\n'), __l -> __l rlike '[^ \\\\t-\\\\r]')").alias("__lines"),
    )
    placed = paired.select(
        *carried, "__t", "__w", "__lines",
        F.expr("""sort_array(transform(filter(__p, (__x, __i) -> coalesce(__x.h = get(__p, __i - 1).h, false)
                  OR coalesce(__x.h = get(__p, __i + 1).h, false)), __x -> __x.i))""").alias("__at"),
        F.expr(f"transform(__lines, __l -> named_struct('l', __l, 'bad', {line_fails_sql('__l', rules)}))").alias("__judged"),
    )
    chars = "length(regexp_replace(array_join({}, ''), '[ \\\\t-\\\\r]', ''))"
    counted = placed.select(
        *carried,
        F.expr("size(__w)").cast("long").alias("__n"),
        F.expr("length(array_join(__w, ''))").cast("long").alias("__wc"),
        F.expr("regexp_count(__t, '[#*$%&|<>]')").cast("long").alias("__sym"),
        F.expr("size(__lines) - size(array_distinct(__lines))").cast("long").alias("__dup"),
        F.expr(f"""coalesce(aggregate(transform(__at, (__x, __i) -> least({w}, coalesce(get(__at, __i + 1), __x + {w}) - __x)),
                   0L, (a, x) -> a + x), 0L)""").alias("__rep"),
        F.expr("size(__judged)").cast("long").alias("__nl"),
        F.expr("size(filter(__judged, __x -> __x.bad))").cast("long").alias("__nbad"),
        F.expr("transform(filter(__judged, __x -> NOT __x.bad), __x -> __x.l)").alias("__good"),
    )
    weighed = counted.select(
        *carried, "__n", "__wc", "__sym", "__dup", "__rep", "__nl", "__nbad",
        F.expr("array_join(__good, '\\n')").alias("__clean"),
        F.expr(f"CASE WHEN __nbad = 0 THEN __wc ELSE {chars.format('__good')} END").cast("long").alias("__left"),
        F.expr(f"__n < {rules.min_words} OR 100 * __rep > {rules.max_repeat_percent} * __n").alias("__base"),
    )
    return weighed.select(
        *carried,
        F.struct(
            F.col("__n").alias("n_words"),
            F.col("__wc").alias("word_chars"),
            F.col("__sym").alias("n_symbols"),
            F.col("__dup").alias("n_dup_lines"),
            F.col("__rep").alias("n_repeat_words"),
            F.col("__nl").alias("n_lines"),
            F.col("__nbad").alias("n_failed_lines"),
            F.expr("CASE WHEN __wc = 0 THEN 0D ELSE __left / CAST(__wc AS double) END").alias("left_share"),
            F.col("__clean").alias("clean_text"),
            F.col("__base").alias("base_failed"),
            F.expr(f"NOT __base AND 1D * __left >= {rules.min_left} * __wc").alias("kept"),
        ).alias(out),
    )


def quality_filter(docs: DataFrame, text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns and texts as they came."""
    # A filter moved below the projections would carry a copy of all their expressions, each copy of copies; it can't
    # pass one with a field that isn't deterministic, such as the row number that it asks for here.
    judged = assess(docs, text_col, "__quality", rules).withColumn("__row", F.monotonically_increasing_id())
    return judged.filter("__quality.kept AND __row >= 0").drop("__quality", "__row")
