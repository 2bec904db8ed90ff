"""Fuzzy line dedup by MinHash, with DataFrame functions only.

A line's shingles are its windows of ``CHARS`` characters. Lines that are equal are one node. A
signature has ``FUNCTIONS`` hash functions, each with a minimum in every eighth of the hash space; a
band is four such minima. Lines that share a band are candidates; the whole signature puts
off those that can hardly be similar; the exact Jaccard similarity of the whole shingle sets decides;
distributed union-find joins the links; the first line of each component stays, over all documents.

No band emits all of its pairs. First each member is compared with two pivots of its band. Other pairs are
needed only where a band still holds different components, and only between these: where the signatures agree, and bitmaps of the shingle sets,
compared inside the join, don't rule out the similarity, exactly. Bitmaps come from the pass that signs the lines, so that no line is taken
apart again for the bands it is in. In large groups of near copies that aren't quite similar enough, which bitmaps can't tell apart, the lines bring
their whole shingle sets into the join, so that it makes pairs that are links and few others.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.llm.common import components, discard, durable, scratch

CHARS, SIMILARITY = 5, 0.8
#: Hash functions, and parts of the hash space that each has a minimum in. Two bands of four parts each.
FUNCTIONS, PARTS = 6, 8
BANDS = 2 * FUNCTIONS
#: Bits in which the signatures of candidates may differ. A minimum that differs changes 8 of its 16 bits, about: at similarity
#: 0.8 77 bits are expected, with a standard deviation of 23.
APART = 148
#: Members of a band beyond which lines near one of its ``PIVOTS``, any members, bring their shingles into the join of pairs.
SMALL, PIVOTS = 64, 3
#: Longs of a line's bitmap: two for each part of the hash space.
WORDS = 2 * PARTS
_SEEDS = [random.Random(j).getrandbits(31) for j in range(FUNCTIONS)]


def _keys(line: str | Column) -> list[Column]:
    """Two 64-bit hashes of a line: 128 bits tell different lines apart."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def row_keys(doc_id: str, text: str) -> list[Column]:
    """Two 64-bit hashes of (doc_id, text), nulls told from values."""
    parts = [F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text)]
    return [F.xxhash64(*parts).alias("r1"), F.xxhash64(F.lit(1), *parts).alias("r2")]


def _lines(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each line that isn't blank, with its place ``at``."""
    return rows.select(*keep, F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(r"\S"))


def _signatures(distinct: DataFrame, chars: int) -> DataFrame:
    """Rows (lid, s0.., w0.., size): the bands of each line, a bitmap of its shingles' hashes, and their number, repeats included. A band is four minima of 16 bits; 0 if it has no shingle.

    Characters are cut from UTF-32, where each has four bytes; a line shorter than a shingle is one itself.
    """
    # dealt by line first: the minima are as many bytes as most lines
    data = distinct.select("lid", "line").repartition("lid").select("lid", F.encode("line", "UTF-32").alias("b"))
    places = data.select("lid", "b", F.explode(F.expr(f"sequence(1, greatest(1, octet_length(b) div 4 - {chars - 1}))")).alias("i"))
    hashed = places.select("lid", F.expr(f"xxhash64(substring(b, 4 * i - 3, {4 * chars}))").alias("h"))
    value = F.expr("cast(shiftright(h, 32) as int)")
    part = F.expr(f"cast(h & {PARTS - 1} as int)").alias("q")
    # the least of the hashes after a change of bits is an unbiased choice among them, like that of another hash
    bit = "bit_or(if(h & 512 = {}, shiftleft(1L, cast(shiftrightunsigned(h, 3) & 63 as int)), 0L))"
    maps = [F.expr(bit.format(512 * k)).alias(f"b{k}") for k in range(2)]
    least = hashed.groupBy("lid", part).agg(*(F.min(value.bitwiseXOR(F.lit(s))).alias(f"m{j}") for j, s in enumerate(_SEEDS)), *maps, F.count("*").alias("size"))
    half = PARTS // 2
    # the last 16 bits of a minimum, which the choice leaves uniform
    band = "bit_or(if(q div {half} = {h}, shiftleft(cast(m{j} & 65535 as bigint), 16 * (q % {half})), 0L))"
    words = [F.expr(f"bit_or(if(q = {n // 2}, b{n % 2}, 0L))").alias(f"w{n}") for n in range(WORDS)]
    return least.groupBy("lid").agg(*(F.expr(band.format(half=half, h=n % 2, j=n // 2)).alias(f"s{n}") for n in range(BANDS)), *words, F.sum("size").alias("size"))


def _agree(a: str, b: str) -> Column:
    """Whether two signatures differ in few bits."""
    return F.expr(f"{' + '.join(f'bit_count({a}.s{j} ^ {b}.s{j})' for j in range(BANDS))} <= {APART}")


def _shingles(line: str, chars: int) -> str:
    """SQL of the distinct shingle hashes of a line. The line's characters are a variable, so that the
    planner can't put their encoding into the loop over the windows."""
    windows = f"transform(sequence(1, greatest(1, octet_length(b) div 4 - {chars - 1})), i -> xxhash64(substring(b, 4 * i - 3, {4 * chars})))"
    return f"transform(array(encode({line}, 'UTF-32')), b -> array_distinct({windows}))[0]"


def _verified(pairs: DataFrame, distinct: DataFrame, similarity: float, chars: int) -> DataFrame:
    """The pairs (a, b, ...) of lids whose shingle sets have a Jaccard similarity of at least ``similarity``."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    texts = durable(distinct.select("lid", "line").join(wanted.hint("merge"), "lid"), "pair_texts")
    both = (
        pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("la")).hint("merge"), "a")
        .join(texts.select(F.col("lid").alias("b"), F.col("line").alias("lb")).hint("merge"), "b")
    )
    # one expression with variables: a filter on columns would be planned with the sets worked out for each mention
    sets = f"array(struct({_shingles('la', chars)} as a, {_shingles('lb', chars)} as b))"
    similar = f"exists({sets}, s -> exists(array(size(array_intersect(s.a, s.b))), n -> n >= {similarity}D * (size(s.a) + size(s.b) - n)))"
    links = durable(both.where(similar).select(*pairs.columns), "line_links")
    discard(texts)
    return links


def _near(similarity: float) -> Column:
    """Whether bitmaps x and y allow the similarity: the sets differ in at most a fixed share of their sizes.

    Bits that differ come from shingles that only one line has, so two bitmaps differ in no more bits than the sets in shingles; and
    a set is no larger than the number of its shingles with repeats.
    """
    apart = " + ".join(f"bit_count(x.w{i} ^ y.w{i})" for i in range(WORDS))
    return F.expr(f"{apart} <= {(1 - similarity) / (1 + similarity)!r}D * (x.size + y.size) + 1e-6D")


def _shared(similarity: float) -> Column:
    """Whether rows x and y are similar by their sets of shingles; true if one has none. No similar pair is ruled out."""
    return F.expr(f"x.sh is null or y.sh is null or {1 + similarity!r}D * size(array_intersect(x.sh, y.sh)) >= {similarity!r}D * (size(x.sh) + size(y.sh)) - 1e-6D")


def _with_sets(known: DataFrame, distinct: DataFrame, similarity: float, chars: int) -> DataFrame:
    """``known`` with ``sh``, the hashes of a line's shingles, for lines of large bands that are near a pivot of theirs, and null for others.

    In a band of lines that are unlike each other few are near any pivot; in a group of near copies, where bitmaps let most pairs pass, most are.
    """
    large = known.where(F.col("n") > SMALL)
    turns = [F.xxhash64(F.lit(j), "key") for j in range(PIVOTS)]
    chosen = large.groupBy("key").agg(*(F.min(F.col("lid").bitwiseXOR(t)).alias(f"p{j}") for j, t in enumerate(turns)))
    lids = chosen.select("key", F.explode(F.array_distinct(F.array(*(F.col(f"p{j}").bitwiseXOR(t) for j, t in enumerate(turns))))).alias("lid"))
    pivots = durable(large.join(lids.hint("merge"), ["key", "lid"]), "pivots")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.lid") != F.col("y.lid")) & _agree("x", "y") & _near(similarity)
    crowd = durable(large.alias("x").join(pivots.alias("y").hint("merge"), near, "left_semi").select("lid").distinct(), "crowd")
    sets = durable(distinct.join(crowd.hint("merge"), "lid").select("lid", F.expr(_shingles("line", chars)).alias("sh")), "shingle_sets")
    discard(pivots, crowd)
    return known.join(sets.hint("merge"), "lid", "left")


def _between(known: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, ca, cb) of one band and of different components ca and cb that signatures, bitmaps and sets don't rule out."""
    first = F.coalesce(*(F.expr(f"if(x.s{j} = y.s{j} and x.s{j} != 0, xxhash64({j}, x.s{j}), null)") for j in range(BANDS)))
    # all conditions are inside the join: other pairs are never made. A pair is made in its first band: two bands of a pair of different components are open both, or have compared it
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.lid") < F.col("y.lid")) & (F.col("x.c") != F.col("y.c")) & _agree("x", "y") & _near(similarity) & (first == F.col("x.key"))
    pairs = known.alias("x").hint("merge").join(known.alias("y"), meet & _shared(similarity))
    return pairs.select(F.col("x.lid").alias("a"), F.col("y.lid").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb")).distinct()


def _apart(known: DataFrame) -> DataFrame:
    """The rows of bands that hold different components."""
    keys = known.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("key")
    return durable(known.join(keys.hint("merge"), "key"), "open_bands")


def line_components(distinct: DataFrame, similarity: float = SIMILARITY, chars: int = CHARS) -> DataFrame:
    """Rows (lid, component) for the lines (lid, line) that are similar to another line."""
    with scratch() as keep:
        signed = durable(_signatures(distinct, chars), "line_signatures")
        keys = F.array_compact(F.array(*(F.when(F.col(f"s{j}") != 0, F.xxhash64(F.lit(j), f"s{j}")) for j in range(BANDS))))
        bands = signed.select("lid", F.explode(keys).alias("key"))
        # counts alone, most of which are 1: ends of bands would make twice as many bytes of the shuffle of all bands
        shared = durable(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared_bands")
        members = durable(bands.join(shared.hint("merge"), "key"), "band_members")
        pivots = members.groupBy("key").agg(F.min("lid").alias("p"), F.max("lid").alias("q"))
        met = durable(members.join(pivots.hint("merge"), "key"), "bands")
        discard(members, shared)
        sketches = durable(signed.join(met.select("lid").distinct().hint("merge"), "lid"), "sketches")
        discard(signed)

        stars = met.select("lid", F.explode(F.array("p", "q")).alias("p")).where("lid != p").select(F.least("lid", "p").alias("a"), F.greatest("lid", "p").alias("b")).distinct()
        narrow = sketches.select("lid", *(f"s{j}" for j in range(BANDS)))
        likely = stars.join(narrow.alias("x").hint("merge"), F.col("a") == F.col("x.lid")).join(narrow.alias("y").hint("merge"), (F.col("b") == F.col("y.lid")) & _agree("x", "y")).select("a", "b")
        links = _verified(durable(likely, "star_pairs"), distinct, similarity, chars)
        found = durable(components(links).select(F.col("node").alias("lid"), "component"), "star_components")
        # two pivots settle a band of three
        known = met.where("n > 3").select("key", "lid", "n").join(found.hint("merge"), "lid", "left").withColumn("c", F.coalesce("component", "lid")).drop("component")
        known = durable(_apart(durable(known, "known")).join(sketches.hint("merge"), "lid"), "open_sketches")
        discard(met, sketches)
        sets = durable(_with_sets(known, distinct, similarity, chars), "open_sets")
        more = _verified(durable(_between(sets, similarity), "open_pairs"), distinct, similarity, chars)
        # components take the place of their lines, so that only what is new is settled
        merged = durable(components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select("node", F.col("component").alias("m")), "merged_components")
        named = found.join(merged.hint("merge"), F.col("component") == F.col("node"), "left").select("lid", F.coalesce("m", "component").alias("component"))
        alone = merged.join(found.hint("merge"), F.col("node") == F.col("lid"), "left_anti").select(F.col("node").alias("lid"), F.col("m").alias("component"))
        return keep(durable(named.unionByName(alone), "similar_lines"))


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, chars: int = CHARS) -> DataFrame:
    """Rows (r1, r2, removed) for each document that loses lines.

    r1 and r2 are the ``row_keys`` of (doc_id, text); ``removed`` the places, from 0, of lines that are equal or
    similar, over links, to a line that comes before in the order (doc_id, r1, r2, place). Blank lines
    always stay. A null doc_id comes before all others. Rows that repeat both id and text have the same keys.
    """
    with scratch() as keep:
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select("doc_id", "text", *row_keys("doc_id", "text"))
        distinct = _lines(rows).groupBy("line").agg(F.count("*").alias("n"))
        # numbers, since two lines of a large corpus may share a 64-bit hash
        distinct = durable(distinct.select(F.monotonically_increasing_id().alias("lid"), "n", "line"), "distinct_lines")
        similar = line_components(distinct.select("lid", "line"), similarity, chars)

        lines = _lines(rows, "doc_id", "r1", "r2")
        places = lines.select("doc_id", "r1", "r2", "at", *_keys("line"))
        group = F.coalesce("component", "lid").alias("group")
        open_ = distinct.join(similar.hint("merge"), "lid", "left").where("n > 1 or component is not null").select(group, *_keys("line"))
        # tables, so that Spark can split a very common line or group in the joins
        at = durable(places.join(durable(open_, "open_groups").hint("merge"), ["h1", "h2"]).drop("h1", "h2"), "open_places")
        place = F.struct("doc_id", "r1", "r2", "at")
        heads = durable(at.groupBy("group").agg(F.min(place).alias("head")), "kept_places")
        lost = at.join(heads.hint("merge"), "group").where(~place.eqNullSafe(F.col("head")))
        return keep(durable(lost.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("at")).alias("removed")), "removed_lines"))


def _copies(keyed: DataFrame) -> DataFrame | None:
    """``keyed`` rows (doc, text, r1, r2) whose keys repeat, with ``later``: whether another copy stands for this one. None if there are none."""
    repeated = durable(keyed.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").select("r1", "r2"), "repeated_rows")
    if repeated.isEmpty():
        return None
    rows = durable(keyed.join(repeated.hint("merge"), ["r1", "r2"]).withColumn("task", F.spark_partition_id()), "copies")
    first = rows.groupBy("r1", "r2").agg(F.min("task").alias("first"))
    # numbered by task, so that many copies of a row don't meet in one
    order = Window.partitionBy("r1", "r2", "task").orderBy("r1")
    numbered = rows.withColumn("k", F.row_number().over(order)).join(durable(first, "first_tasks").hint("merge"), ["r1", "r2"])
    return numbered.select("doc", "text", "r1", "r2", (~((F.col("task") == F.col("first")) & (F.col("k") == 1))).alias("later"))


def mark_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, chars: int = CHARS) -> DataFrame:
    """``docs`` with removed_lines, an array of the places, from 0, of the lines that go.

    Of all equal or similar lines, over links, the first stays, in the order (doc_id, hash of the row, place). A
    null doc_id comes first; blank lines always stay; a null text has no lines. Of rows that repeat both id and text
    one, any, stands for all: the others lose all their lines that aren't blank. An empty table
    gives an empty result. Other columns pass through, whatever their names; one named removed_lines is replaced.
    """
    gone = removed_lines(docs, doc_id, text, similarity, chars)
    names = [c for c in docs.columns if c != "removed_lines"]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), F.col(text).alias("text"), *row_keys(doc_id, text))
    copies = _copies(keyed)
    places = F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].rlike(r"\S")), lambda s: s["i"])
    if copies is None:
        joined = keyed.withColumn("later", F.lit(False)).join(gone.hint("merge"), ["r1", "r2"], "left")
    else:
        once = keyed.join(copies.select("r1", "r2").distinct().hint("merge"), ["r1", "r2"], "left_anti").withColumn("later", F.lit(False))
        joined = once.unionByName(copies).join(gone.hint("merge"), ["r1", "r2"], "left")
    none = F.array().cast("array<int>")
    return joined.select("doc.*", F.when(F.col("later"), F.coalesce(places, none)).otherwise(F.coalesce("removed", none)).alias("removed_lines"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, chars: int = CHARS) -> DataFrame:
    """``docs`` with the text that ``mark_lines`` leaves, and with removed_lines.

    All rows stay; a text may become empty; a null text stays null.
    """
    marked = mark_lines(docs, doc_id, text, similarity, chars)
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains("removed_lines", i)), "\n")
    names = [c for c in docs.columns if c != "removed_lines"]
    return marked.select(*(F.when(F.size("removed_lines") > 0, left).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in names), "removed_lines")
