"""Near-duplicate documents from bottom-k sketches of one hash function.

A text's set is its distinct word shingles, as 64-bit hashes; its sketch is the k smallest of them, ``RETAINED``
at first.

1. Equal sets (by size and two 64-bit digests of the whole set) form a class; one representative goes on.
2. Leaders: every representative meets, in the inverted lists of its ``LED`` smallest values, only the leader of
   the list (the class with most copies), and then ``LEADERS`` others.  So a group of n near copies costs a few n
   pairs, not n squared.  Verified links merge into components; this is only a head start, and loses nothing.
3. Inverted lists of all retained values that occur in several components.  Two sketches of a link have at
   least c common values (``least_common``), so that, with the values of each sketch ordered by the number of
   components in their list, the rarest ``all - c + 1`` of both must have one in common.  Only these are listed,
   and of a text with fewer than c such values none.  Every pair of representatives of *different* components
   that meet in a list is a candidate, in the first such list alone.  Of whole sets the smaller one of a link has a
   greater share in common than the larger one, so each text lists values in either role, and a smaller one meets
   larger ones only.
4. A list of more than ``CROWD`` components is a passage that many unlike texts share.  A text that still lists
   such a value after step 3 consists of it for the greater part.  Where both sets are whole, every pair that meets
   there is formed at once.  The other texts, and those that are large enough to be linked with one of them, go
   through step 3 once more among themselves with sketches ``FINER`` times as large, where c is a greater share,
   until the sketches are the whole sets and c is exact.  What then still meets in a crowded list has all but a
   fifth of its shingles there, and as the smaller set all but a ninth.  Crowded values are few (each is in over
   ``CROWD`` sketches), so they are sent to where the sketches are; a join looks up the others only.
5. Candidates must agree in size and in two digests that are compared where lists meet: the parity digest of the
   whole set, in which two sets differ in at most as many bits as the sets do in members (so no link is lost),
   and a bit map of the sketch.  They are then filtered by the Jaccard of the union sketch, then verified on the
   full sets.

Whole sets are treated exactly.  Where a sketch is a sample, ``DEVIATIONS`` standard deviations are allowed for: a
link at the threshold itself is missed in step 3 with a chance of about 1e-6, and again in step 5; nothing is
capped or sampled, and nothing depends on what the shared passage is.

Pairs inside one component need no verification: they can't change it.

Defined cases: null, empty and wordless texts have the empty set and are linked with nothing; a text of fewer
words than a shingle is one shingle; rows that share an id are one node, with the links of all their texts; rows
with a null id are linked with nothing and have a null component; ties go to the smaller id; an empty table gives
an empty result; other columns are ignored, whatever their names; ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm import _text
from loomgrid.llm._spark import components, cut, dealt_join, discard, shares, small

RETAINED = 32
FINER = 16
LED = 4
LEADERS = 4
CROWD = 256
DEVIATIONS = 5
#: Longs of the parity digest, and of the bit map of the sketch.
PARITY = 16
MAP = 2
MARKS = [f"d{i}" for i in range(PARITY + MAP)]


def _sampled(size: str, percent: int) -> str:
    """SQL: the common values to expect at least of ``size`` values drawn from a union with ``percent`` common."""
    q = percent / 100
    return f"greatest(1L, CAST(floor({q!r}D * {size} - {DEVIATIONS * (q * (1 - q)) ** 0.5!r}D * sqrt({size})) AS long))"


def least_common(n: str, held: str, percent: int, k: int, smaller: bool) -> str:
    """SQL: the least number of common values in the sketches of a link, for its smaller or larger set, of ``n`` of which ``held`` are retained.

    Where both sets are whole it is exact: those common are ``percent`` of the larger set at least, and of the smaller
    one, since the union is no less than the larger, ``2 percent / (100 + percent)``.
    """
    if smaller:
        exact, whole = f"({2 * percent} * {n} + {99 + percent}) DIV {100 + percent}", f"100 * {n} <= {percent * k}"
    else:
        exact, whole = f"({percent} * {n} + 99) DIV 100", f"{n} <= {k}"
    return f"CASE WHEN {whole} THEN {exact} ELSE {_sampled(held, percent)} END"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (63 bits, as int64) of each text of a chunk."""
    words = _text.split_words(data, offsets)
    h, first = words.hashes, words.first
    factors = _text.mix(np.arange(1, k + 1, dtype=np.uint64))
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        rolled += h[j : j + len(rolled)] * factors[j]
    rolled = (_text.mix(rolled) >> np.uint64(1)).astype(np.int64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            whole = np.sum(h[a:b] * factors[: b - a], dtype=np.uint64) + np.uint64(b - a)
            yield (_text.mix(np.array([whole], np.uint64)) >> np.uint64(1)).astype(np.int64)
        else:
            yield np.zeros(0, np.int64)


def digest(s: np.ndarray) -> np.ndarray:
    """Parity of the members that fall on each bit, and which bits the sketch falls on."""
    bits = 64 * PARITY
    parity = np.bincount((s >> 7) & (bits - 1), minlength=bits) & 1
    low = np.zeros(64 * MAP, np.uint8)
    low[s[:RETAINED] & (64 * MAP - 1)] = 1
    return np.packbits(np.concatenate([parity.astype(np.uint8), low])).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _rows(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame | None = None) -> DataFrame:
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"ids must be integers, not {docs.schema[id_col].dataType.simpleString()}")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows if ids is None else rows.join(small(ids), "id", "left_semi")


def sketches(rows: DataFrame, k: int, retained: int = RETAINED) -> DataFrame:
    """(id, n, f1, f2, sketch, digest): size, digests and bottom values of the set of each row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in _text.chunks(batch.column(1)):
                n, f1, f2, low, marks = [], [], [], [], []
                for s in shingle_sets(data, offsets, k):
                    u = s.astype(np.uint64)
                    n.append(len(s))
                    f1.append(np.sum(_text.mix(u + np.uint64(1)), dtype=np.uint64))
                    f2.append(np.sum(_text.mix(u ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
                    low.append(s[:retained])
                    marks.append(digest(s))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), _lists(low), _lists(marks)],
                    names=["id", "n", "f1", "f2", "sketch", "digest"],
                )

    return rows.mapInArrow(_text.releasing(run), "id long, n long, f1 long, f2 long, sketch array<long>, digest array<long>")


def full_sets(rows: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of each row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in _text.chunks(batch.column(1)):
                sets = list(shingle_sets(data, offsets, k))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), _lists(sets)], names=["id", "shingles"])

    return rows.mapInArrow(_text.releasing(run), "id long, shingles array<long>")


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(c if c == "v" else F.col(c).alias(side if c == "rep" else f"{side}_{c}") for c in df.columns))


def _near(percent: int) -> str:
    """SQL: whether sizes and digests of ``a`` and ``b`` allow a link."""
    # 100 i >= p u bounds the members in only one of the sets by (100 - p) / (100 + p) of the sum of sizes
    apart = " + ".join(f"bit_count(a_{d} ^ b_{d})" for d in MARKS[:PARITY])
    shared = " + ".join(f"bit_count(a_{d} & b_{d})" for d in MARKS[PARITY:])
    larger = f"greatest({' + '.join(f'bit_count(a_{d})' for d in MARKS[PARITY:])}, {' + '.join(f'bit_count(b_{d})' for d in MARKS[PARITY:])})"
    # the map has a bit for each value of a sketch of RETAINED, fewer where values fall on one
    q = percent / 100
    part = q - DEVIATIONS * (q * (1 - q) / RETAINED) ** 0.5
    return f"""100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n) AND {100 + percent} * ({apart}) <= {100 - percent} * (a_n + b_n)
               AND {shared} >= {0.9 * part!r}D * {larger}"""


def _marked(df: DataFrame) -> DataFrame:
    """The digest as columns, so that comparing two needs no loop."""
    return df.select(*(c for c in df.columns if c != "digest"), *(F.get("digest", F.lit(i)).alias(d) for i, d in enumerate(MARKS)))


def crowded(held: DataFrame, values: np.ndarray) -> DataFrame:
    """``held`` and, as ``crowd``, which of ``values`` each sketch has, in their order."""
    if not len(values):
        return held.withColumn("crowd", F.array().cast("array<long>"))
    place = np.argsort(values)
    ascending = values[place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = batch.column(batch.schema.get_field_index("sketch"))
            flat = sketch.flatten().to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(sketch)), sketch.value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(ascending, flat), len(ascending) - 1)
            hit = ascending[at] == flat
            text, at = text[hit], place[at[hit]]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(sketch)))]).astype(np.int32)
            met = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[at[np.lexsort((at, text))]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, met], names=[*batch.schema.names, "crowd"])

    return held.mapInArrow(run, T.StructType([*held.schema.fields, T.StructField("crowd", T.ArrayType(T.LongType()))]))


class Search:
    """Candidates and links among the rows of one table."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> None:
        self.docs, self.id_col, self.text_col, self.k, self.percent = docs, id_col, text_col, k, percent
        #: Whether some id has several rows.
        self.repeats = False

    def rows(self, ids: DataFrame | None = None) -> DataFrame:
        rows = _rows(self.docs, self.id_col, self.text_col, ids)
        return rows.dropDuplicates() if ids is not None and self.repeats else rows

    def verified(self, pairs: DataFrame, held: DataFrame, retained: int) -> DataFrame:
        """(a, b), written: the pairs that are links; ``held`` has (rep, sketch) of ``retained`` values."""
        pairs = cut(pairs)
        if pairs.isEmpty():
            return pairs
        heavy = shares(pairs)
        sketch = held.select("rep", "sketch")
        one = dealt_join(pairs, "a", sketch.toDF("a", "sa"), heavy)
        both = dealt_join(one, "b", sketch.toDF("b", "sb"), heavy).withColumn("low", F.slice(F.sort_array(F.array_union("sa", "sb")), 1, retained))
        enough = _sampled("size(low)", self.percent)
        likely = cut(both.filter(f"size(array_intersect(low, array_intersect(sa, sb))) >= {enough}").select("a", "b").distinct())
        wanted = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = cut(full_sets(self.rows(wanted), self.k))
        one = dealt_join(likely, "a", sets.toDF("a", "sa"), heavy)
        exact = dealt_join(one, "b", sets.toDF("b", "sb"), heavy)
        links = cut(exact.withColumn("common", F.size(F.array_intersect("sa", "sb"))).filter(f"100 * common >= {self.percent} * (size(sa) + size(sb) - common)").select("a", "b").distinct())
        discard(pairs, likely, sets, *([heavy] if heavy is not None else []))
        return links

    def meet_leaders(self, reps: DataFrame, leaders: DataFrame) -> DataFrame:
        """Links of the representatives with the leaders (v, l: rep and component) of the lists they are in."""
        postings = reps.select("rep", "component", F.explode(F.slice("sketch", 1, LED)).alias("v"))
        of = _named(_marked(reps.select("rep", "n", "digest")), "b")
        # a leader has few lists, so its digest meets them there and not at its many followers
        led = cut(leaders.select("v", F.col("l.rep").alias("b"), F.col("l.component").alias("b_component")).join(of, "b"))
        met = postings.select("v", F.col("rep").alias("a"), "component").join(led, "v").filter("a <> b AND component <> b_component").drop("v", "component", "b_component").distinct()
        pairs = met.join(_named(_marked(reps.select("rep", "n", "digest")), "a"), "a").filter(_near(self.percent))
        links = self.verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), reps, RETAINED)
        discard(led)
        return links

    def candidates(self, held: DataFrame, retained: int) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) of different components in one list, and the ids of texts to be compared by finer sketches.

        ``held`` has (rep, f1, n, component, sketch, digest); both results read a written table, given third.
        """
        values = held.select("rep", "f1", "component", F.explode("sketch").alias("v"))
        # written, so that the join below is of two plain sides
        lists = cut(values.select("v", "component").distinct().groupBy("v").agg(F.count("*").alias("in_list")).filter("in_list > 1"))
        # a crowded value is one of few, so it is found where the sketch is; only the others are looked up by a join
        rare = values.join(lists.filter(f"in_list <= {CROWD}"), "v").groupBy("rep", "f1").agg(F.sort_array(F.collect_list(F.struct("in_list", "v"))).getField("v").alias("rare"))
        crowd = lists.filter(f"in_list > {CROWD}").toArrow()
        found = crowded(held, crowd.column("v").to_numpy()[np.lexsort((crowd.column("v").to_numpy(), crowd.column("in_list").to_numpy()))])
        # all - c + 1 of the rarest, of which those that are in no other component come first and needn't be listed
        first = [f"greatest(0L, n_shared - ({least_common('n', 'held', self.percent, retained, smaller)}) + 1)" for smaller in (True, False)]
        texts = cut(
            found.join(rare, ["rep", "f1"], "left")
            .withColumns({"rare": F.coalesce("rare", F.array().cast("array<long>")), "held": F.size("sketch").cast("long")})
            .withColumns({"order": F.concat("rare", "crowd"), "n_rare": F.size("rare").cast("long")})
            .withColumn("n_shared", F.size("order").cast("long"))
            .selectExpr("rep", "f1", "n", "component", "digest", "order", "n_rare", f"least(n_shared, {first[0]}) AS smaller", f"least(n_shared, {first[1]}) AS larger")
            .filter("greatest(smaller, larger) > 0")
            .withColumn("order", F.expr("slice(order, 1, CAST(greatest(smaller, larger) AS int))"))
        )
        discard(lists)

        def side(role: str, name: str) -> DataFrame:
            # both whole: such a pair lists the first value they share, however crowded, so it needs no finer sketch
            ends = f"CAST(CASE WHEN n <= {retained} THEN {role} ELSE least({role}, n_rare) END AS int)"
            listed = _marked(texts).select("*", F.posexplode(F.expr(f"slice(order, 1, {ends})")).alias("nth", "v"))
            return _named(listed.withColumn("before", F.expr("slice(order, 1, nth)")).drop("f1", "order", "nth", "n_rare", "smaller", "larger"), name)

        # a pair is made where the rarest value that both list is, and nowhere else
        met = side("smaller", "a").join(side("larger", "b"), "v").filter(
            f"(a_n < b_n OR a_n = b_n AND a < b) AND a_component <> b_component AND {_near(self.percent)} AND NOT arrays_overlap(a_before, b_before)"
        )
        # what is left has a set that is not whole on one side; the other side may be whole, but then it is the smaller, and not much so
        least = texts.filter(f"n > {retained} AND greatest(smaller, larger) > n_rare").agg(F.min("n")).first()[0]
        again = "false" if least is None else f"CASE WHEN n > {retained} THEN greatest(smaller, larger) > n_rare ELSE smaller > n_rare AND 100 * n >= {self.percent * least} END"
        finer = texts.filter(again).select(F.col("rep").alias("id")).distinct()
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), finer, texts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row; links are pairs with 100 * intersection >= percent * union."""
    search = Search(docs, id_col, text_col, k, percent)
    base = cut(sketches(search.rows(), k))
    full = base.filter("n > 0 AND id IS NOT NULL")
    classes = cut(full.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("digest").alias("digest")))
    # an id with several texts links their classes
    again = cut(full.groupBy("id").agg(F.count("*").alias("c"), F.min("f1").alias("lo"), F.max("f1").alias("hi")).filter("c > 1").select("id", (F.col("lo") < F.col("hi")).alias("differ")))
    search.repeats = not again.isEmpty()
    found = []
    if search.repeats:
        of_again = full.select("id", "n", "f1", "f2").join(small(again.filter("differ")), "id", "left_semi")
        found.append(cut(of_again.join(classes, ["n", "f1", "f2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()))

    def merged() -> DataFrame:
        """(node, component) by the links found so far."""
        edges = found[0]
        for more in found[1:]:
            edges = edges.union(more)
        return components(edges)

    def placed(reps: DataFrame, joined: DataFrame) -> DataFrame:
        return reps.drop("component").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    reps = cut(placed(classes, merged())) if found else classes.withColumn("component", F.col("rep"))
    postings = reps.select("rep", "copies", "component", F.explode(F.slice("sketch", 1, LED)).alias("v"))
    lists = postings.groupBy("v").agg(F.count("*").alias("c"), F.max(F.struct("copies", (-F.col("rep")).alias("r"), "component")).alias("m")).filter("c > 1")
    found.append(search.meet_leaders(reps, lists.select("v", F.struct((-F.col("m.r")).alias("rep"), "m.component").alias("l"))))

    before, reps = reps, cut(placed(reps, merged()))
    discard(before)
    postings = reps.select("rep", "component", F.explode(F.slice("sketch", 1, LED)).alias("v"))
    lists = postings.groupBy("v").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.array(*(F.min(F.struct(F.xxhash64("rep", "v", F.lit(i)).alias("h"), "rep", "component")) for i in range(LEADERS))).alias("m"),
    ).filter("lo <> hi")
    found.append(search.meet_leaders(reps, lists.select("v", F.explode(F.array_distinct(F.transform("m", lambda x: F.struct(x["rep"].alias("rep"), x["component"].alias("component"))))).alias("l"))))

    before, reps = reps, cut(placed(reps, merged()))
    discard(before)
    held, retained = reps, RETAINED
    while True:
        pairs, finer, listed = search.candidates(held, retained)
        found.append(search.verified(pairs, held, retained))
        finer = cut(finer)
        discard(listed, held)
        joined = merged()
        if finer.isEmpty():
            break
        retained *= FINER
        sets = sketches(search.rows(finer), k, retained).withColumnRenamed("id", "rep")
        if search.repeats:  # texts of one id that differ, with the same set
            sets = sets.dropDuplicates(["rep", "f1"])
        held = cut(placed(sets, joined))
        discard(finer, joined)

    of_class = classes.select("n", "f1", "f2", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    return (
        base.select("id", "n", "f1", "f2")
        .join(of_class, ["n", "f1", "f2"], "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
