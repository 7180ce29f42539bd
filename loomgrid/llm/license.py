"""License scan by diagonal voting, with DataFrame operations only.

Every rolling word k-gram of every text is hashed and joined to the places it has in the license
templates.  A match at word ``pos`` of the text and ``tpos`` of the template votes for the diagonal
``pos - tpos``.  Votes are summed per (document, template, diagonal) as a bit mask over the template's
grams, neighbouring diagonals are merged (a word put in or left out shifts the rest of a license), and a
span stands when enough of its template's grams voted and its words lie close together.  Where so many
diagonals lie side by side that the words merged don't lie close together, each stretch of ``REACH`` diagonals is
verified by itself.  The join also compares the words themselves, so a hash collision never votes.

The templates are a fixed list in code (checked against ``MAX_GRAMS``), which bounds what is broadcast.
Everything after the join is keyed by row, so a hot source or phrase loads no single task.

Defined cases: a null or empty text has no words and no labels; each row is a document of its own, also where
ids repeat or are null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Grams of a template: one bit each in a long.
MAX_GRAMS = 62
K = 2
#: Diagonals that one span may take up where many lie close together.
REACH = 6


@dataclass(frozen=True)
class Template:
    """A license text or name; ``need`` is the share of its grams that must vote, ``band`` how far apart diagonals merge."""

    label: str
    words: str
    need: float = 0.75
    band: int = 3
    base: bool = False


#: The phrases whose every exact place counts.
BASE = (
    Template("gpl", "gnu general public license", 1.0, 0, True),
    Template("apache", "apache license", 1.0, 0, True),
    Template("cc-by", "cc by", 1.0, 0, True),
    Template("mit", "mit license", 1.0, 0, True),
)

#: Notices and titles that the method finds besides, also when words are changed, put in or left out.
NOTICES = (
    Template("agpl", "gnu affero general public license"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", 0.9),
    Template("cc0", "creative commons zero universal public domain dedication"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "released under the mit license"),
    Template("mpl", "mozilla public license version 2 0"),
    Template("unlicense", "free and unencumbered software released into the public domain"),
)
TEMPLATES = BASE + NOTICES

#: Everything below U+0080 that is no part of a word once A-Z are lower-cased.
SEPARATORS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_column(text: F.Column) -> F.Column:
    """The words of a text; ``lower`` moves no character across the word boundary."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPLIT))


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(gram hash, words, template number, place, number of grams, need, band): a few hundred rows."""
    rows = []
    for t, x in enumerate(templates):
        words = x.words.split()
        grams = len(words) - K + 1
        if not 1 <= grams <= MAX_GRAMS:
            raise ValueError(f"template {x.label!r} must have {K} to {MAX_GRAMS + K - 1} words")
        rows += [f"('{words[i]}', '{words[i + 1]}', {t}, {i}, {grams}, CAST({x.need} AS double), {x.band})" for i in range(grams)]
    return spark.sql(
        f"SELECT xxhash64(a, b) AS g, a AS ta, b AS tb, t, tpos, grams, need, band FROM VALUES {', '.join(rows)} AS v(a, b, t, tpos, grams, need, band)"
    )


def scan_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(row, id, t, start, end, share): the verified spans of template number ``t``, and one row with t = -1 and ``end`` = words of the text."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), words_column(F.col(f"`{text_col}`")).alias("w"))
    rolled = words.select("row", "id", F.posexplode_outer(F.expr("arrays_zip(w, slice(w, 2, size(w)))")).alias("pos", "z"))
    grams = rolled.select("row", "id", "pos", F.col("z").getField("w").alias("a"), F.col("z").getField("1").alias("b"))
    places = F.broadcast(template_grams(docs.sparkSession, templates))
    # The last word of a text (the only row without a second word) stays whatever it matches: it carries the count.
    hit = (F.xxhash64("a", "b") == places["g"]) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb"))
    votes = grams.join(places, hit, "left").filter("t IS NOT NULL OR b IS NULL").select(
        "row", "id",
        F.expr("coalesce(t, -1)").alias("t"),
        F.expr("coalesce(pos - tpos, 0)").alias("diagonal"),
        F.expr("coalesce(pos, -1)").cast("long").alias("lo"),
        F.expr("CASE WHEN t IS NULL THEN coalesce(pos, -1) + 1 ELSE pos + 2 END").cast("long").alias("hi"),
        F.expr("shiftleft(1L, coalesce(tpos, 0))").alias("bits"),
        "grams", "need", "band",
    )
    by_document = votes.repartition(F.col("row"))
    diagonals = by_document.groupBy("row", "id", "t", "diagonal").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("bits").alias("bits"),
        F.first("grams").alias("grams"), F.first("need").alias("need"), F.first("band").alias("band"),
    )
    along = Window.partitionBy("row", "t").orderBy("diagonal")
    ahead, around = along.rangeBetween(0, REACH), along.rangeBetween(-REACH, REACH)
    opens = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= F.col("band"), 0).otherwise(1)
    marked = diagonals.withColumn("opens", opens)
    marked = marked.withColumn("island", F.sum("opens").over(along)).withColumn("w_bits", F.bit_or("bits").over(ahead)).withColumn("w_lo", F.min("lo").over(ahead)).withColumn("w_hi", F.max("hi").over(ahead))
    marked = marked.withColumn("w_best", F.max(F.struct(F.bit_count("w_bits"), -F.col("diagonal"))).over(around))
    island = Window.partitionBy("row", "t", "island")
    whole = marked.withColumn("start", F.min("lo").over(island)).withColumn("end", F.max("hi").over(island)).withColumn("all_bits", F.bit_or("bits").over(island))
    # an island is one span, unless it is too long; then each stretch of diagonals within REACH is verified by itself
    short = "t = -1 OR end - start <= 2 * (grams + 1)"
    return whole.selectExpr(
        "row", "id", "t", f"{short} AS short", "opens", "w_best.col2 = -diagonal AS best", "need",
        f"CASE WHEN {short} THEN start ELSE w_lo END AS start", f"CASE WHEN {short} THEN end ELSE w_hi END AS end",
        f"bit_count(CASE WHEN {short} THEN all_bits ELSE w_bits END) / CAST(grams AS double) AS share",
    ).filter("t = -1 OR (share >= need AND CASE WHEN short THEN opens = 1 ELSE best END)").select("row", "id", "t", "start", "end", "share")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """One row per document: n_words, base places, labels and a score (the best share of a template found)."""
    templates = BASE + notices
    spans = scan_spans(docs, id_col, text_col, templates)
    n_base = len(BASE)
    label = "element_at(array({}), t + 1)".format(", ".join(f"'{x.label}'" for x in templates))
    base, any_ = f"t BETWEEN 0 AND {n_base - 1}", "t >= 0"
    return spans.groupBy("row", "id").agg(
        F.expr("max(CASE WHEN t = -1 THEN end END)").alias("n_words"),
        F.expr(f"count_if({base})").alias("n_base"),
        F.expr(f"min(CASE WHEN {base} THEN start END)").alias("first_word"),
        F.expr(f"max(CASE WHEN {base} THEN start END)").alias("last_word"),
        F.expr(f"array_join(sort_array(collect_set(CASE WHEN {base} THEN {label} END)), ',')").alias("base_labels"),
        F.expr(f"array_join(sort_array(collect_set(CASE WHEN {any_} THEN {label} END)), ',')").alias("labels"),
        F.expr(f"coalesce(max(CASE WHEN {any_} THEN share END), 0D)").alias("score"),
    ).drop("row").withColumnRenamed("id", id_col)
