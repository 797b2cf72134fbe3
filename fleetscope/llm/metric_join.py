"""Jaccard join of word n-grams in metric space.

A document is the set of its distinct shingles of `shingle` words; 1 - J is a metric, and two documents link when it is at
most tau = 1 - percent/100. Pivots are documents. Their cells are Voronoi regions, and the triangle inequality says which
documents of other cells must be copied into a cell: those that lie at most tau further from its pivot than its farthest
member, and at most 2 tau further from it than from their own pivot. Cells are joined again in the same way, until they
are small or hold one component only.

1. Equal texts are one. Random pivots are at distance 1 from almost all documents, where the inequality parts nothing, so
   the regions of the first level have a shingle in common: two sets that link share one of their first shingles in any
   order of all shingles, the shorter set one of even fewer. Shingles that are frequent among all documents' first
   ones come last in the order, so passages that many documents share bring few together. How many are counted as
   frequent is bounded; that changes the regions' sizes, never what is found.
2. Small regions are leaves: their pairs are counted, and those that share too few first shingles to link are gone.
   Every document is first compared with the one it shares most with, then with those that are not yet linked to it.
3. Large regions have pivots, first their least key. Everybody's exact distance to it is computed; documents within tau
   are linked to it, and of these only such are compared further that can have partners outside. What is still large
   gets several pivots, cells and copies, round by round. Cells that don't get smaller (all are equally far from each
   other) and small ones are compared pair by pair as Spark joins, after the windows of distance to the pivot, of size,
   of position, and of the counts in 64 parts of all shingles (whose differences add up to no more than the sets'
   symmetric difference). What is left is decided by the exact sizes of intersection and union.

Sets are held as 64-bit hashes of their shingles. Fewer words than a shingle: the whole sequence is one. Null, empty and
blank texts have an empty set and link with nothing, not even with each other. Rows with a null key keep a null component
and link nobody. Of rows that repeat a key with other texts, one text is compared, and all of them take its component. An
empty table gives no rows. Extra columns are ignored. Keys may have any type that has an order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .debruijn import gram_hashes
from .exprs import stored

SHINGLE, PERCENT = 5, 80
#: From how many documents on a shingle comes last in the order, and how many such shingles there are at most (8 MB).
FREQUENT_FROM, FREQUENT_MOST = 8, 1_000_000
#: Keys that are sent to every executor instead of shuffling both sides.
BROADCAST_KEYS = 500_000
#: Documents of a region that are compared pair by pair, and pivots of a larger one, about.
LEAF, PIVOTS = 48, 8
ROUNDS = 12
PARTS = 64
SLACK = 1e-9


def normal(text: str | None) -> bytes:
    """The words of a text, A-Z in lower case, with one space between them."""
    return b" ".join((text or "").encode().lower().split())  # bytes: A-Z and the six ASCII spaces only


def shingle_set(text: bytes, shingle: int = SHINGLE):
    """Sorted distinct hashes of a normal text's shingles."""
    import numpy as np
    import xxhash

    h = xxhash.xxh64_intdigest
    found = np.array([h(w) for w in text.split()], np.uint64)
    return np.unique(gram_hashes(found, min(shingle, len(found)))) if len(found) else found


def first_of(n: int, percent: int) -> int:
    """Of how many first shingles any two sets that link share one, if n is the size of one of them."""
    return n - -(-percent * n // 100) + 1


def first_of_shorter(n: int, percent: int) -> int:
    """The same for the shorter one."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _small(keys: DataFrame) -> DataFrame:
    """keys, which are stored, to be sent to every executor if they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _lists(column):
    """The arrays of a list column of 64-bit hashes."""
    import numpy as np

    values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def _as_lists(arrays):
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, arrays)])
    whole = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole, pa.int64()))


def _described(rows: DataFrame, kind: str, shingle: int, percent: int) -> DataFrame:
    """key, digest of the words, size n of the set, and the least of its hashes: somewhat more than its first shingles."""

    def batches(parts: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for b in parts:
            digests, sizes, low = [], [], []
            for t in b.column(1):
                text = normal(t.as_py())
                found = shingle_set(text, shingle)
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
                sizes.append(len(found))
                low.append(found[:5 * first_of(len(found), percent) // 4 + 8].copy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), _as_lists(low)], names=["key", "digest", "n", "low"])

    return rows.mapInArrow(batches, f"key {kind}, digest binary, n long, low array<long>")


def _counts(lists: DataFrame, column: str) -> DataFrame:
    """(z, count) of the shingles that enough documents have in their list."""
    return lists.select(F.explode(column).alias("z")).groupBy("z").count().where(F.col("count") >= FREQUENT_FROM)


def _most(counts: DataFrame):
    """Sorted hashes of the counted shingles, of the most frequent ones if they are too many."""
    import numpy as np

    steps = counts.groupBy(F.floor(4 * F.log2("count")).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least"))
    least, left = None, FREQUENT_MOST
    for r in steps.orderBy(F.desc("step")).collect():  # a few dozen rows
        if r["n"] > left:
            break
        least, left = r["least"], left - r["n"]
    if least is None:
        return np.zeros(0, np.uint64)
    return np.sort(counts.where(F.col("count") >= least).select("z").toArrow().column(0).to_numpy().view(np.uint64))


def _parted(known, hashes):
    """A set's shingles that aren't frequent, and those that are."""
    import numpy as np

    if not len(known):
        return hashes, hashes[:0]
    last = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
    return hashes[~last], hashes[last]


def _frequent(first: DataFrame, texts: DataFrame, kind: str, shingle: int, percent: int):
    """Sorted hashes of the shingles that come last in the order.

    Those that many documents have among their least ones; and of the documents whose least ones hold too few others, so
    that their first shingles lie further on, those that many have anywhere. Without the second kind the members of a
    family would meet under its shingles with higher hashes, before the ones that only one of them has.
    """
    counts = stored(_counts(first, "low"), "frequent-shingles")
    known = first.sparkSession.sparkContext.broadcast(_most(counts))

    def short(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for b in parts:
            lows, sizes = _lists(b.column(2)), b.column(1).to_pylist()
            yield b.select([0]).filter(pa.array([len(x) < n and len(_parted(known.value, x)[0]) < first_of(n, percent) for n, x in zip(sizes, lows)], pa.bool_()))

    def whole(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for b in parts:
            yield pa.RecordBatch.from_arrays([_as_lists([shingle_set(normal(t.as_py()), shingle) for t in b.column(1)])], names=["grams"])

    asked = stored(first.select("key", "n", "low").mapInArrow(short, f"key {kind}").withColumnRenamed("key", "_short"), "mostly-frequent")
    sets = texts.join(_small(asked), F.col("key") == F.col("_short"), "left_semi").mapInArrow(whole, "grams array<long>")
    both = counts.unionByName(_counts(sets, "grams")).groupBy("z").agg(F.max("count").alias("count"))
    return _most(stored(both, "frequent-in-whole-sets"))


def _firsts(first: DataFrame, texts: DataFrame, kind: str, frequent, shingle: int, percent: int) -> DataFrame:
    """key, n, the first shingles of every set in the order, and how many of them aren't frequent."""
    import numpy as np

    known = first.sparkSession.sparkContext.broadcast(frequent)

    def listed(keys, sizes, chosen, rare):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([keys, sizes, _as_lists(chosen), pa.array(rare, pa.int64())], names=["key", "n", "first", "rare"])

    def from_low(parts: Iterator) -> Iterator:
        for b in parts:
            chosen, rare = [], []
            for n, low in zip(b.column(1).to_pylist(), _lists(b.column(2))):
                few, many = _parted(known.value, low)
                need = first_of(n, percent)
                enough = len(few) >= need or len(low) == n  # else the whole set must be seen
                chosen.append(np.concatenate([few, many])[:need] if enough else low[:0])
                rare.append(min(need, len(few)))
            yield listed(b.column(0), b.column(1), chosen, rare)

    def from_text(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for b in parts:
            chosen, rare, sizes = [], [], []
            for t in b.column(1):
                few, many = _parted(known.value, shingle_set(normal(t.as_py()), shingle))
                sizes.append(len(few) + len(many))
                need = first_of(sizes[-1], percent)
                chosen.append(np.concatenate([few, many])[:need])
                rare.append(min(need, len(few)))
            yield listed(b.column(0), pa.array(sizes, pa.int64()), chosen, rare)

    schema = f"key {kind}, n long, first array<long>, rare long"
    found = stored(first.select("key", "n", "low").mapInArrow(from_low, schema), "first-shingles")
    short = stored(found.where(F.size("first") == 0).select(F.col("key").alias("_short")), "whole-sets")
    again = stored(texts.join(_small(short), F.col("key") == F.col("_short"), "left_semi").mapInArrow(from_text, schema), "first-of-whole-sets")
    return found.where(F.size("first") > 0).unionByName(again)


def _regions(firsts: DataFrame, percent: int, leaf: int) -> DataFrame:
    """(region, key, n, rest, shorter, rare, size, least): documents under a common first shingle.

    Regions of shingles that aren't frequent are small and seen as windows; the others are aggregated and joined, which
    Spark splits where one shingle has very many documents. Large regions without a possible shorter one of a pair go.
    """
    rows = firsts.select("key", "n", F.posexplode("first").alias("at", "z"), "rare")
    rows = rows.withColumns({"rest": F.col("n") - F.col("at"), "shorter": F.col("at") < F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent)) + 1})
    rare, often = rows.where("at < rare"), rows.where("at >= rare")
    whole = {"size": F.count(F.lit(1)), "least": F.min(F.when(F.col("shorter"), F.col("n")))}
    small = rare.withColumns({c: f.over(Window.partitionBy("z")) for c, f in whole.items()})
    large = often.join(often.groupBy("z").agg(*[f.alias(c) for c, f in whole.items()]), "z")
    met = small.unionByName(large).where((F.col("size") > 1) & (F.col("least").isNotNull() | (F.col("size") <= leaf)))
    return stored(met.select(F.col("z").cast("string").alias("region"), "key", "n", "rest", "shorter", "rare", "size", "least"), "regions")


def _meeting(large: DataFrame, percent: int) -> DataFrame:
    """(region, pivot, key, n, rest, shorter) of what can be met in large regions, regions with the same pivot as one.

    Rows stay whose rest behind the shingle is enough for the region's smallest possible partner. The pivot is the document
    with the fewest shingles that aren't frequent: in a family of near copies the one with the fewest edits, to which most
    others link. The copies share dozens of first shingles, hence as many regions with this one pivot; every document
    stands once in the one made of them, with the most that any of its rows there leaves behind.
    """
    able = large.where((100 + percent) * F.col("rest") >= percent * (F.col("n") + F.col("least"))).drop("size", "least")
    ends = able.groupBy("region").agg(F.min(F.struct("rare", "key")).alias("one"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = able.join(ends.select("region", F.col("one.key").alias("pivot")), "region")
    one = met.groupBy("pivot", "key").agg(F.first("n").alias("n"), F.max("rest").alias("rest"), F.bool_or("shorter").alias("shorter"))
    return stored(one.withColumn("region", F.col("pivot").cast("string")), "large-regions")


def _close(small: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """(a, b, common): pairs of small regions that can link, with the number of first shingles they share there.

    Whichever list of first shingles ends first in the order, all that the two share up to there is counted, but for
    shingles of large regions; what lies behind is bounded by the set's rest.
    """
    x, y = small.alias("x"), small.alias("y")
    total = F.col("x.n") + F.col("y.n")
    fits = ((F.col("x.region") == F.col("y.region")) & (F.struct("x.n", "x.key") < F.struct("y.n", "y.key"))
            & (100 * F.col("x.n") >= percent * F.col("y.n")))
    first = F.col("x.shorter") & ((100 + percent) * F.least("x.rest", "y.rest") >= percent * total)
    met = x.join(y, fits).groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).agg(
        F.count(F.lit(1)).alias("common"), F.bool_or(first).alias("first"))
    more = stored(large.groupBy("key").agg(F.count(F.lit(1)).alias("more")), "in-large-regions")
    side = lambda c: more.select(F.col("key").alias(c), F.col("more").alias(f"more_{c}"))
    met = met.where("first").join(side("a"), "a", "left").join(side("b"), "b", "left").fillna(0, ["more_a", "more_b"])
    behind = F.ceil(F.lit(percent) * F.greatest("n_a", "n_b") / F.lit(100)) - 1
    most = F.col("common") + F.least("more_a", "more_b") + behind
    return stored(met.where((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b", "common"), "close")


def _nearest(close: DataFrame) -> DataFrame:
    """The pair of every document with the one it shares most first shingles with."""
    both = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "common"))
    best = both.groupBy("a").agg(F.max(F.struct("common", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    # a pair may be the best one of both
    return stored(close.join(best.unionByName(best.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_semi").select("a", "b"), "nearest")


def _sets(keys: DataFrame, texts: DataFrame, kind: str, shingle: int) -> DataFrame:
    """key, grams (the set) and parts (how many of it lie in each part of all hashes) of the given keys' texts."""
    import numpy as np

    def batches(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for b in parts:
            found = [shingle_set(normal(t.as_py()), shingle) for t in b.column(1)]
            counts = [np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PARTS).astype(np.int32) for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), _as_lists(found), pa.array([c.tolist() for c in counts], pa.list_(pa.int32()))], names=["key", "grams", "parts"])

    asked = _small(keys.select(F.col("key").alias("_asked")))
    return stored(texts.join(asked, F.col("key") == F.col("_asked"), "left_semi").mapInArrow(batches, f"key {kind}, grams array<long>, parts array<int>"), "sets")


def _distances(pairs: DataFrame, sets: DataFrame, kind: str, percent: int) -> DataFrame:
    """a, b, exact distance and whether they link, for distinct pairs."""
    side = lambda c: sets.select(F.col("key").alias(c), F.col("grams").alias(f"{c}_grams"))

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in parts:
            far, near = [], []
            for x, y in zip(_lists(b.column("a_grams")), _lists(b.column("b_grams"))):
                few, many = (x, y) if len(x) < len(y) else (y, x)
                both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                union = len(x) + len(y) - both
                far.append(1 - both / union)
                near.append(100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(far, pa.float64()), pa.array(near, pa.bool_())], names=["a", "b", "d", "near"])

    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_grams", "b_grams")
    return stored(met.mapInArrow(batches, f"a {kind}, b {kind}, d double, near boolean"), "distances")


def _measured(pairs: DataFrame, sets: DataFrame, kind: str, percent: int) -> DataFrame:
    """Distances of (pivot, key) pairs; that of a pivot to itself is 0."""
    pairs = stored(pairs.select("pivot", "key").distinct(), "pivots")
    far = _distances(pairs.where("pivot != key").select(F.col("pivot").alias("a"), F.col("key").alias("b")), sets, kind, percent)
    own = pairs.where("pivot = key").select("pivot", "key", F.lit(0.0).alias("d"), F.lit(True).alias("near"))
    return far.select(F.col("a").alias("pivot"), F.col("b").alias("key"), "d", "near").unionByName(own)


def _unsettled(rows: DataFrame, links: DataFrame, tau: float) -> DataFrame:
    """Rows of the cells (region, pivot) that can still link two components, with their component.

    Of the component nearest to the pivot only those members stay that lie at most tau nearer than the nearest of all others.
    """
    cell = ["region", "pivot"]
    root = components(links).withColumnRenamed("node", "key")
    named = stored(rows.drop("part").join(root, "key", "left").withColumn("part", F.coalesce("root", "key")).drop("root"), "cells")
    groups = named.groupBy(*cell, "part").agg(F.min("d").alias("least"))
    nearest = groups.groupBy(*cell).agg(F.min(F.struct("least", "part")).alias("one"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    second = groups.join(nearest, cell).where(F.col("part") != F.col("one.part")).groupBy(*cell).agg(
        F.first("one.part").alias("first_part"), F.min("least").alias("second"))
    kept = named.join(second, cell).where((F.col("part") != F.col("first_part")) | (F.col("d") >= F.col("second") - F.lit(tau + SLACK)))
    return kept.drop("first_part", "second")


def _pairs(rows: DataFrame, sets: DataFrame, tau: float, percent: int) -> DataFrame:
    """The pairs of documents in one cell that the windows leave, one of them its own member, of different components."""
    x, y = rows.where("shorter").alias("x"), rows.alias("y")
    total = F.col("x.n") + F.col("y.n")
    fits = ((F.col("x.region") == F.col("y.region")) & (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.part") != F.col("y.part"))
            & (F.col("x.own") | F.col("y.own")) & (F.struct("x.n", "x.key") < F.struct("y.n", "y.key"))
            & (100 * F.col("x.n") >= percent * F.col("y.n")) & (F.abs(F.col("x.d") - F.col("y.d")) <= F.lit(tau + SLACK))
            & ((100 + percent) * F.least("x.rest", "y.rest") >= percent * total))
    met = x.join(y, fits).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), total.alias("total")).distinct()
    side = lambda c: sets.select(F.col("key").alias(c), F.col("parts").alias(f"parts_{c}"))
    met = stored(met, "met").join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("parts_a", "parts_b", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, v: s + v)
    return met.where((100 + percent) * apart <= (100 - percent) * F.col("total")).select("a", "b")


def _cells(rows: DataFrame, sets: DataFrame, kind: str, tau: float, percent: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Rows of large cells dealt to the Voronoi cells of new pivots, with copies at the borders; and the links to pivots.

    Every pair that was to be met in the large cell is met in the cell in which one of the two is at home.
    """
    old, draw = ["region", "pivot"], F.xxhash64("key", F.lit(turn))
    one = rows.groupBy(*old).agg(F.min(F.struct(draw.alias("h"), "key")).alias("one"))
    chosen = (F.pmod(draw, F.lit(1 << 30)).cast("double") * F.col("before") < float(PIVOTS << 30)) | (F.col("key") == F.col("one.key"))
    new = stored(rows.join(one, old).where(chosen).select(*old, F.col("key").alias("to")), "new-pivots")
    met = stored(rows.drop("d", "own").join(new, old), "cells-and-pivots")
    far = stored(_measured(met.select(F.col("to").alias("pivot"), "key"), sets, kind, percent), "measured")
    found = met.join(far.select(F.col("pivot").alias("to"), "key", "d"), ["to", "key"])
    nearest = found.groupBy(*old, "key").agg(F.min(F.struct("d", "to")).alias("nearest"))
    found = stored(found.join(nearest, [*old, "key"]).withColumn("own", F.col("to") == F.col("nearest.to")), "voronoi")
    radius = found.where("own").groupBy(*old, "to").agg(F.max("d").alias("radius"))
    inside = (F.col("d") <= F.col("radius") + F.lit(tau + SLACK)) & (F.col("d") <= F.col("nearest.d") + F.lit(2 * tau + SLACK))
    kept = found.join(radius, [*old, "to"]).where(F.col("own") | inside)
    cell = F.concat_ws("/", "region", F.col("pivot").cast("string"))
    dealt = kept.select(cell.alias("region"), F.col("to").alias("pivot"), "key", "n", "rest", "shorter", "part", "d", "own", "before")
    return dealt, far.where("near and pivot != key").select(F.col("pivot").alias("a"), F.col("key").alias("b"))


def links(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(key, n) of every row, and links (a, b) that give the same components as all links of the join."""
    kind, tau = df.schema[key].dataType.simpleString(), 1 - percent / 100
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    told = stored(_described(rows, kind, shingle, percent), "described")
    able, texts = told.where("n > 0 and key is not null"), rows.where("key is not null")
    if not able.groupBy("key").count().where("count > 1").isEmpty():
        able = stored(able.groupBy("key").agg(F.min(F.struct("digest", "n", "low")).alias("one")).select("key", "one.*"), "one-row-a-key")
        texts = _texts_of(texts, able, kind)
    same = able.groupBy("digest").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    copies = stored(able.select("key", "digest").join(same, "digest").where("key != least").select("least", "key"), "copies")
    first = able.join(_small(copies.select(F.col("key").alias("_gone"))), F.col("key") == F.col("_gone"), "left_anti")
    met = _regions(_firsts(first, texts, kind, _frequent(first, texts, kind, shingle, percent), shingle, percent), percent, leaf)
    small, large = met.where(F.col("size") <= leaf), met.where(F.col("size") > leaf)
    close = _close(small, large, percent)
    large = _meeting(large, percent)
    asked = close.select(F.explode(F.array("a", "b")).alias("key")).unionByName(large.select("key")).distinct()
    sets = _sets(stored(asked, "members"), texts, kind, shingle)
    one = _distances(_nearest(close), sets, kind, percent)
    far = stored(_measured(large, sets, kind, percent), "measured")
    found = one.where("near").select("a", "b").unionByName(far.where("near and pivot != key").select(F.col("pivot").alias("a"), F.col("key").alias("b")))
    found = stored(found, "links")
    cells = large.join(far.drop("near"), ["pivot", "key"]).withColumns({"own": F.lit(True), "part": F.col("key"), "before": F.lit(None).cast("long")})
    for turn in range(ROUNDS):
        if cells.isEmpty():
            break
        size = Window.partitionBy("region", "pivot")
        open_ = stored(_unsettled(cells, found, tau).withColumn("size", F.count(F.lit(1)).over(size)), "unsettled")
        grown = F.coalesce(4 * F.col("size") > 3 * F.col("before"), F.lit(False)) | F.lit(turn == ROUNDS - 1)
        last = (F.col("size") <= leaf) | grown
        near = _distances(stored(_pairs(open_.where(last), sets, tau, percent), "candidates"), sets, kind, percent)
        found = stored(found.unionByName(near.where("near").select("a", "b")), "links")
        rest = open_.where(~last).drop("before").withColumnRenamed("size", "before")
        if rest.isEmpty():
            break
        cells, more = _cells(rest, sets, kind, tau, percent, turn)
        cells, found = stored(cells, "dealt"), stored(found.unionByName(more), "links")
    root = stored(components(found), "components")
    side = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"part_{c}"))
    apart = close.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b"))
    apart = apart.join(one.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")
    found = found.unionByName(_distances(stored(apart, "left"), sets, kind, percent).where("near").select("a", "b"))
    return told.select("key", "n"), found.unionByName(copies.select(F.col("least").alias("a"), F.col("key").alias("b")))


def _texts_of(texts: DataFrame, one: DataFrame, kind: str) -> DataFrame:
    """One row a key: the text whose words have the digest that stands for the key."""

    def batches(parts: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for b in parts:
            digests = [hashlib.blake2b(normal(t.as_py()), digest_size=16).digest() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary())], names=["key", "text", "digest"])

    told = texts.mapInArrow(batches, f"key {kind}, text string, digest binary")
    return stored(told.join(one.select("key", "digest"), ["key", "digest"], "left_semi").dropDuplicates(["key"]).select("key", "text"), "texts")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """key, n (size of its set) and component (the least key reachable by links) of every row."""
    sizes, found = links(df, key, text, shingle, percent, leaf)
    root = stored(components(found), "components")
    return sizes.join(root, F.col("key") == F.col("node"), "left").select("key", "n", F.coalesce("root", "key").alias("component"))
