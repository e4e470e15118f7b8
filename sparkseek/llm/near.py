"""Near-duplicates among texts by five-word shingles, found with deletion-variant signatures of wide SimHash fingerprints.

Texts whose sets of five-word shingles are at least 0.8 similar differ in about a twelfth of the bits of a SimHash over
word pairs. A wide fingerprint is cut into few long segments, so that most such pairs differ by at most one bit in one
of them; every segment is indexed under its one-wildcard variants, and an equality join gives candidates, which the
whole fingerprint and then the shingles themselves verify. A group of like texts is joined through its least member
first; only members that this leaves apart are paired with each other, so no pair of one group is lost.

Where many texts are near in fingerprints but not similar, those pairs would be quadratic. In such a crowd a text is
told by what it lacks of, and adds to, the shingles that most of the crowd have. Counts of these show which pairs can
be similar at all, and such pairs are all tied to one member or share an addition or a lack among their rarest ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, remove, text_of, written
from .components import components

#: Words of a shingle and least similarity of two texts; words of what the fingerprint counts.
SHINGLE, SIMILAR, GRAM = 5, 0.8, 2
#: A fingerprint of three longs; its segments as (long, low bit, bits).
LONGS = 3
SEGMENTS = tuple((k, low, 28) for k in range(LONGS) for low in (0, 28))
#: Candidates differ in at most so many of the 192 bits; pairs at the least similarity differ in about 16.
WIDE_BITS = 48
#: Like texts beyond this number are a crowd; what belongs to a whole crowd comes in as many copies, one to each part of it.
CROWDED = 32
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII spaces; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _grams(words: list[bytes], width: int) -> list[bytes]:
    return [b" ".join(words)] if len(words) < width else list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def wide_fingerprint(text: str) -> tuple[int, ...]:
    """LONGS signed longs; a bit is set if it is in over half the hashes of the word pairs. Without words all are 0."""
    words = words_of(text)
    if not words:
        return (0,) * LONGS
    grams = _grams(words, GRAM)
    votes = np.zeros((LONGS, 64), dtype=np.int64)
    for at in range(0, len(grams), 1 << 16):  # long texts in blocks
        part = grams[at : at + (1 << 16)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part), dtype=np.uint64, count=len(part))
        for k in range(LONGS):
            with np.errstate(over="ignore"):
                z = h + _MIX[0] * np.uint64(k + 1)
                z = (z ^ (z >> np.uint64(30))) * _MIX[1]
                z = (z ^ (z >> np.uint64(27))) * _MIX[2]
            votes[k] += np.unpackbits((z ^ (z >> np.uint64(31))).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(grams), axis=1)
    return tuple(int.from_bytes(row.tobytes(), "big", signed=True) for row in bits)


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the sets of shingles; a text of fewer words is one shingle; two texts without words are equal."""
    one, two = (set(_grams(w, SHINGLE)) if (w := words_of(t)) else set() for t in (a, b))
    both = len(one & two)
    return both / (len(one) + len(two) - both) if one or two else 1.0


def _variants() -> Column:
    """The one-wildcard variants of all segments, each as one long: the segment's other bits, then the place of the wildcard."""
    out = []
    for n, (k, low, size) in enumerate(SEGMENTS):
        part = F.shiftrightunsigned(f"w{k}", low).bitwiseAND(F.lit((1 << size) - 1))
        out += [F.shiftleft(part.bitwiseAND(F.lit(((1 << size) - 1) ^ (1 << i))), 8).bitwiseOR(F.lit(n * size + i).cast("long")) for i in range(size)]
    return F.array(*out)


def _candidates(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of (u, v) that share a variant and are near in their whole fingerprints, as a written table."""
    w = [f"w{k}" for k in range(LONGS)]
    for side in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in w]), side)
    differ = [F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}")) for c in w]
    parts = [F.bit_count(F.shiftrightunsigned(differ[k], low).bitwiseAND(F.lit((1 << size) - 1))) for k, low, size in SEGMENTS]
    return written(pairs.filter((sum(map(F.bit_count, differ), F.lit(0)) <= WIDE_BITS) & (F.least(*parts) <= 1)).select("u", "v"), "near")


def _similar(near: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the written (u, v) that are similar. Texts are fetched for these only; the table of pairs is removed."""
    wanted = near.select(F.col("u").alias("node")).unionAll(near.select(F.col("v").alias("node"))).distinct()
    own = written(texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "near-texts")

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) >= SIMILAR for x, y in zip(a, b)], dtype=bool)

    both = near.join(own.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(own.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    out = written(both.filter(similar("a", "b")).select("u", "v"), "links")
    remove(near.sparkSession, near, own)
    return out


def _part() -> Column:
    """The part of its group that a node is in."""
    return F.pmod(F.xxhash64("node"), F.lit(CROWDED)).cast("int")


def _to_parts(table: DataFrame) -> DataFrame:
    """One copy of a row for each part of its group."""
    return table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(CROWDED - 1))))


def _crowd_links(crowd: DataFrame, nodes: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """Tables of links (u, v) that join the similar texts of each crowd: crowd (group, node), distinct.

    Let h be the shingles that over half of a group have, a(x) and r(x) the numbers of those that x adds and lacks.
    x and y are similar if |x ^ y| <= (|x| + |y|) / 9, and x ^ y is that of their additions and that of their lacks.

    * If a + r of both come to no more than that bound, they are similar; then each is similar to the pivot, the text
      of least 9 (a + r) - |x|, too. All texts are compared with the pivot, and pairs tied to it need nothing more.
    * Other similar pairs share an addition or a lack. At least (4 a + r - h) / 5 additions of x are shared if any must
      be, so one of them is among the rarest of x; without a shared addition 4 a + r <= h for both, and at least
      (4 a + 5 r - h) / 4 lacks are shared.

    An addition that more than CROWDED texts share makes a crowd of its own, at most half as large, with its own h.
    """
    spark = crowd.sparkSession

    @F.pandas_udf("array<long>")
    def shingles(text: pd.Series) -> pd.Series:
        return pd.Series([np.unique(np.fromiter((xxhash.xxh64_intdigest(g) for g in set(_grams(words_of(t), SHINGLE))), dtype=np.uint64)).view(np.int64) for t in text])

    own = written(texts.join(crowd.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "texts")
    sets = written(own.select("node", shingles("text").alias("s")), "shingles")
    out, old = [], [sets]
    while not crowd.isEmpty():
        members = crowd.join(sets, "node")
        counts = members.select("group", F.explode("s").alias("e")).groupBy("group", "e").agg(F.count("*").alias("f")).filter("f > 1")
        counts = written(counts, "counts")
        sizes = crowd.groupBy("group").agg(F.count("*").alias("n"))
        usual = counts.join(sizes, "group").filter("2 * f > n").groupBy("group").agg(F.array_sort(F.collect_list(F.struct((-F.col("f")).alias("f"), "e"))).alias("h"))
        usual = written(sizes.join(usual, "group", "left").select("group", F.coalesce("h.e", F.array().cast("array<long>")).alias("h")), "usual")
        rows = members.select("group", "node", "s", _part().alias("part")).join(_to_parts(usual), ["group", "part"])
        rows = rows.select("group", "node", "part", F.size("s").alias("size"), F.size("h").alias("h"), F.array_except("s", "h").alias("adds"), F.array_except("h", "s").alias("lacks"))
        rows = written(rows.withColumn("a", F.size("adds")).withColumn("r", F.size("lacks")), "rows")
        pivots = written(rows.groupBy("group").agg(F.min(F.struct(F.expr("9 * (a + r) - size"), "node"))["node"].alias("pivot")), "pivots")
        rows_of = rows.join(_to_parts(pivots), ["group", "part"])
        tied = _similar(written(rows_of.filter("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct(), "near"), texts)
        rows_of = rows_of.join(tied.select(F.col("u").alias("pivot"), F.col("v").alias("node"), F.lit(True).alias("t")), ["pivot", "node"], "left")
        placed = written(rows_of.withColumn("tied", F.coalesce("t", F.col("pivot") == F.col("node"))).drop("t", "pivot", "part"), "placed")

        about = ["group", "node", "size", "h", "a", "r", "tied"]
        added = placed.select(*about, F.explode("adds").alias("e")).join(counts, ["group", "e"])  # those of one text alone are its rarest
        added = added.groupBy(*about).agg(F.array_sort(F.collect_list(F.struct("f", "e")))["e"].alias("es"))
        added = added.withColumn("k", F.expr("a - greatest(1, ceil((4 * a + r - h) / 5)) + 1 - (a - size(es))").cast("int"))
        added = written(added.filter("k > 0").select(*about, F.explode(F.slice("es", F.lit(1), F.col("k"))).alias("e")), "added")
        shared = added.groupBy("group", "e").agg(F.count("*").alias("n"), F.count_if(~F.col("tied")).alias("loose"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
        shared = written(shared.filter("n > 1 and loose > 0"), "shared")
        few = added.join(shared.filter(F.col("n") <= CROWDED).select("group", "e"), ["group", "e"])
        sides = lambda rows, keys: [rows.select(*keys, *[F.col(c).alias(f"{c}{i}") for c in about if c != "group"]) for i in (1, 2)]
        one, two = sides(few, ["group", "e"])
        pairs = one.join(two, ["group", "e"]).filter("node1 < node2 and not (tied1 and tied2)")
        pairs = pairs.filter("18 * least(a1, a2) >= 9 * (a1 + a2 + abs(r1 - r2)) - size1 - size2")

        k = F.expr("r - greatest(1, ceil((4 * a + 5 * r - h) / 4)) + 1").cast("int")
        lacking = placed.filter("4 * a + r <= h").withColumn("k", k).filter("k > 0").select(*about, F.explode(F.slice("lacks", F.lit(1), F.col("k"))).alias("e"))
        lacking = written(lacking, "lacking")
        one, two = sides(lacking, ["group", "e"])
        lacks = one.filter("not tied1").join(two, ["group", "e"]).filter("node1 <> node2 and 9 * (a1 + a2 + abs(r1 - r2)) <= size1 + size2")
        both = pairs.select("node1", "node2").unionAll(lacks.select("node1", "node2"))
        links = _similar(_candidates(both.select(F.least("node1", "node2").alias("u"), F.greatest("node1", "node2").alias("v")).distinct(), nodes), texts)
        # Additions that the same texts share make one crowd.
        many = shared.filter(F.col("n") > CROWDED).select("group", "e", F.xxhash64("n", "sum").alias("next"))
        following = written(added.join(many, ["group", "e"]).select(F.col("next").alias("group"), "node").distinct(), "crowd")
        out += [tied, links]
        old += [following]
        remove(spark, counts, usual, rows, pivots, placed, added, shared, lacking)
        crowd = following
    remove(spark, own, *old)
    return out


def near_roots(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a similar text: nodes (node, w0, w1, w2) distinct, texts (node, text)."""
    spark = nodes.sparkSession
    spread = nodes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes; their variants are many
    index = spread.select("node", F.explode(_variants()).alias("key"))
    # Least members are combined before the shuffle, so a key that a large share of the nodes has is cheap.
    shared = index.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("n"))
    shared = written(shared.filter("hub < last").select("key", "hub", "n"), "keys")
    members = written(index.join(shared, "key").select("key", "node", "hub", "n"), "members")
    # A text has many keys, but few hubs: what concerns a hub and a text is one row for all the keys that they share.
    stars = written(members.filter("node <> hub").groupBy("hub", "node").agg(F.max("n").alias("n")), "stars")
    hubs = _candidates(stars.select(F.col("hub").alias("u"), F.col("node").alias("v")), nodes)
    like = written(components(hubs).select("node", F.col("root").alias("group")), "like")
    crowd = like.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("group")
    crowd = written(like.withColumn("part", _part()).join(_to_parts(crowd), ["group", "part"]).select("group", "node"), "crowd")
    first = written(hubs.join(crowd.select(F.col("node").alias("u")), "u", "left_anti"), "near")
    first = [_similar(first, texts), *_crowd_links(crowd, nodes, texts)]
    links = first[0]
    for more in first[1:]:
        links = links.unionAll(more)
    roots = written(components(links), "roots")
    # Keys whose members the first round left apart: a member is of another kind than the hub. Pairs within a crowd are done.
    kinds = roots.join(crowd, "node", "full").select("node", F.coalesce("root", "node").alias("c"), "group")
    kinds = written(kinds.withColumn("kind", F.coalesce("group", "c")), "kinds")
    stray = stars.filter("n > 2").join(kinds.select(F.col("node").alias("hub"), F.col("kind").alias("usual")), "hub", "left").join(kinds.select("node", "kind"), "node", "left")
    stray = written(stray.filter(F.coalesce("kind", "node") != F.coalesce("usual", "hub")).select("hub", "node"), "stray")
    many = members.filter("n > 2")
    apart = written(many.join(stray, ["hub", "node"], "left_semi").select("key").distinct(), "keys")
    placed = many.join(apart, "key", "left_semi").join(kinds, "node", "left")
    placed = written(placed.select("key", "node", "hub", F.coalesce("c", "node").alias("c"), "group"), "placed")
    most = written(placed.groupBy("key").agg(F.mode("group").alias("most")), "most")
    rest = written(placed.join(most, "key").withColumn("main", F.coalesce(F.col("group") == F.col("most"), F.lit(False))).drop("most"), "members")
    one = rest.filter("not main").select("key", F.col("node").alias("u"), F.col("c").alias("cu"), "hub", F.col("group").alias("gu"))
    two = rest.select("key", F.col("node").alias("v"), F.col("c").alias("cv"), F.col("group").alias("gv"), "main")
    pairs = one.join(two, "key").filter("(main or u < v) and least(u, v) <> hub and cu <> cv and not (gu <=> gv and gu is not null)")
    second = _similar(_candidates(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), nodes), texts)
    out = written(components(links.unionAll(second)), "roots")
    remove(spark, shared, members, stars, hubs, like, crowd, *first, roots, kinds, stray, apart, placed, most, rest, second)
    return out


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of near copies; all columns stay.

    Links are between texts whose five-word shingles are at least 0.8 similar; of the rows that links join, the one
    with the least doc_id (null last), then the least hash of the text, stays. Equal texts are one group, null texts
    are empty, texts without any word are near copies of each other, and of rows with one doc_id and one text one stays
    whatever their other columns. A repeated doc_id with different texts is judged by text. An empty table gives an
    empty table; extra columns may have any name but __node, __doc and __null.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    @F.pandas_udf("w0 long, w1 long, w2 long")
    def wide(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wide_fingerprint(t) for t in texts], columns=["w0", "w1", "w2"], dtype="int64")

    names = [docs[f"`{c}`"] for c in docs.columns]
    doc_id = docs["doc_id"].cast("long")
    marked = docs.select(*names, F.xxhash64(text_of(docs)).alias("__node"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("__doc"), doc_id.isNull().alias("__null"))
    texts = docs.select(F.xxhash64(text_of(docs)).alias("node"), text_of(docs).alias("text"))
    by_row = docs.select(F.xxhash64(text_of(docs)).alias("node"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc"), doc_id.isNull().alias("none"), wide(text_of(docs)).alias("w"))
    by_row = written(by_row.select("node", "doc", "none", "w.*"), "wide")
    nodes = written(by_row.groupBy("node").agg(*[F.min(f"w{k}").alias(f"w{k}") for k in range(LONGS)]), "nodes")
    roots = near_roots(nodes, texts)
    rows = by_row.groupBy("node", "doc", "none").agg(F.count("*").alias("n")).join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    rows = written(rows.select("node", "doc", "none", "n", "group"), "rows")
    order = F.struct("none", "doc", "node")
    sizes = rows.groupBy("group").agg(F.min(order).alias("first"), F.count("*").alias("k"), F.sum("n").alias("n")).filter("k > 1 or n > 1")
    sizes = written(sizes.select("group", "first"), "groups")
    gone = rows.join(sizes, "group").withColumn("stays", order == F.col("first"))
    gone = written(gone.filter("not stays or n > 1").select(F.col("node").alias("__node"), F.col("doc").alias("__doc"), F.col("none").alias("__null"), "stays"), "gone")
    remove(spark, by_row, nodes, roots, rows, sizes)
    keys = ["__node", "__doc", "__null"]
    others = marked.join(gone.select(*keys), keys, "left_anti")
    repeated = marked.join(gone.filter("stays").select(*keys), keys, "left_semi").dropDuplicates(keys)  # rows that come more than once
    return others.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
