"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has 64 bits; a bit is one if it is one in over half of the hashes of the text's shingles.
Two fingerprints link when they differ in at most two bits.

The fingerprint is cut into two segments of 32 bits. Around each segment's value the Hamming ball of radius one
is enumerated while the other segment stays as it is; every member of these balls is a table key. If two
fingerprints differ in two bits or fewer, they share a key: one bit of difference at most is moved from either
side, in whichever segment it lies. The matches of a key are fetched by a window over the key. A key has 65
fingerprints at most, however large a group of near copies is, and since any two of them differ in two bits or
fewer, linking each one to the least of them keeps all components without listing pairs. The complete distance
of every link is verified. Copies meet before the balls are enumerated, so equal fingerprints cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .debruijn import gram_hashes, mix as spread
from .exprs import stored

SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of one text; zero if it has no words."""
    return segments(text, shingle, 1, 64)[0]


def segments(text: str | None, shingle: int, count: int, bits: int) -> list[int]:
    """A fingerprint of count segments of so many bits: of the shingles' hashes, and then of these mixed anew for every 64 bits more."""
    import numpy as np
    import xxhash

    none = [0] * count
    if not text:
        return none
    joined = b" ".join(text.encode().lower().split())  # bytes: A-Z and the six ASCII spaces only
    if not joined:
        return none
    raw = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    first = [0, *(gaps + 1).tolist()]
    last = [*gaps.tolist(), len(joined)]
    h = xxhash.xxh64_intdigest
    hashes = [h(joined[a:b], SEED) for a, b in zip(first, last[shingle - 1:])] or [h(joined, SEED)]
    long, total = -(-count * bits // 64), len(hashes)
    ones = np.zeros((long, 64), np.int64)
    for at in range(0, total, 65536):  # bounds the memory of very long texts
        part = np.array(hashes[at:at + 65536], np.uint64)
        for j in range(long):
            x = part if not j else spread(part + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            ones[j] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    cut = np.zeros((count, 64), bool)
    cut[:, :bits] = (2 * ones > total).reshape(-1)[:count * bits].reshape(count, bits)
    return np.packbits(cut, axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key and fp of every row; rows with a null key stay rows of their own."""
    kind = df.schema[key].dataType.simpleString()

    def batches(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for b in rows:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["key", "fp"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(batches, f"key {kind}, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) for distinct fingerprints fp that differ in one or two bits: each with the least of every ball it is in."""
    flips = [F.lit(0).cast("long")] + [F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)]
    low, high = F.array(*flips[:33]), F.array(flips[0], *flips[33:])  # balls in the lower and in the upper segment
    keys = fps.select("fp", F.explode(F.array_distinct(F.concat(low, high))).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    least = keys.select("fp", F.min("fp").over(Window.partitionBy("z")).alias("a"))
    return least.where((F.col("a") != F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= 2)).select(
        "a", F.col("fp").alias("b")).distinct()


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key, fp, component of every row; component is the least key reachable by links, the row's own included.

    Null and empty texts share fingerprint zero. Repeated rows come back as often as they came. Null keys can't
    be a component: rows with a null key take the least key of their class, or null where it has none.
    """
    fp = stored(fingerprints(df, key, text, shingle), "fingerprints")
    own = stored(fp.groupBy("fp").agg(F.min("key").alias("least")), "distinct-fingerprints")
    root = components(links(own.select("fp")))
    named = own.join(root.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = named.groupBy("root").agg(F.min("least").alias("component"))
    per_fp = named.join(whole, "root").select("fp", "component")
    return fp.join(per_fp, "fp").select("key", "fp", "component")


#: Words of a shingle, and the least share of common shingles (4 of 5), of near copies.
WORDS = 5
#: Documents, about, whose shingles tell which ones are common, and how many common ones are sent to every executor.
#: Both change only the order in which shingles are compared, never what is found.
COMMON_FROM, COMMON_MOST = 10_000, 200_000


def _normal(text: str | None) -> bytes:
    """The words of a text, A-Z in lower case, with one space between them."""
    return b" ".join((text or "").encode().lower().split())  # bytes: A-Z and the six ASCII spaces only


def shingles(text: bytes, shingle: int = WORDS):
    """Sorted distinct hashes of each so many consecutive words of a normal text, of the whole text if it has fewer; none of a blank one."""
    import numpy as np
    import xxhash

    h = xxhash.xxh64_intdigest
    found = np.array([h(w, SEED) for w in text.split()], np.uint64)
    return np.unique(gram_hashes(found, min(shingle, len(found)))) if len(found) else found


def _prefix(grams, common, times):
    """The shingles of a set of n of which two sets that are 4/5 alike share one: n - ceil(4n / 5) + 1, the rarest first."""
    import numpy as np

    seen = np.zeros(len(grams), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        seen = np.where(common[at] == grams, times[at], 0)
    order = np.lexsort((grams, seen))
    return grams[order[:len(grams) - -(-4 * len(grams) // 5) + 1]]


def _common(rows: DataFrame, shingle: int):
    """Sorted hashes of shingles that several documents of a sample have, and in how many."""
    import numpy as np

    def batches(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for b in rows:
            found = [shingles(_normal(t.as_py()), shingle) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["z"])

    few = rows.where(F.pmod(F.xxhash64("key"), F.lit(max(1, rows.count() // COMMON_FROM))) == 0).select("text")
    top = few.mapInArrow(batches, "z long").groupBy("z").count().where("count > 1").orderBy(F.desc("count"), "z").limit(COMMON_MOST).toArrow()
    z, n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(z)
    return z[order], n[order]


def _small(keys: DataFrame) -> DataFrame:
    """keys, which are stored, to be sent to every executor if they are few; else both sides of their join are shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _alike(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Those pairs (a, b) of keys whose texts have at least four fifths of their distinct shingles in common."""
    kind = pairs.schema["a"].dataType.simpleString()
    pairs = stored(pairs, "candidates")
    asked = stored(pairs.select(F.explode(F.array("a", "b")).alias("_asked")).distinct(), "asked")
    texts = rows.join(_small(asked), F.col("key") == F.col("_asked"), "left_semi")
    side = lambda c: texts.select(F.col("key").alias(c), F.col("text").alias(f"{c}_text"))

    def batches(found: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, one = None, None  # a text often comes in many rows on end
        for b in found:
            good = []
            for x, y in zip(b.column("a_text"), b.column("b_text")):
                if (x := _normal(x.as_py())) != last:
                    last, one = x, shingles(x, shingle)
                two = shingles(_normal(y.as_py()), shingle)
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(5 * both >= 4 * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")
    return stored(met.mapInArrow(batches, f"a {kind}, b {kind}"), "alike")


def families(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = WORDS) -> DataFrame:
    """key and component of every row with a key: two texts link if four fifths or more of their distinct shingles are common.

    All such links count, none is missed and no other one is made. Words are compared with A-Z in lower case; texts of
    fewer words than a shingle link to equal ones only, blank and null texts to each other.

    Two sets with a share of 4/5 or more have one of their first n - ceil(4n / 5) + 1 shingles in common, in any order of
    all shingles (prefix filtering); here common shingles come last, so passages that many texts share don't bring them
    together. Texts with the same words are one. Each text that meets others is first compared with the least key that it
    meets, which joins large groups of near copies without listing their pairs. Then, under every shingle, the texts that
    are not yet in its largest group are compared with all others but their own group. Pairs that meet in shingles that
    leave too few for a link are not compared.
    """
    import numpy as np

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    common = rows.sparkSession.sparkContext.broadcast(_common(rows, shingle))

    def batches(rows: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for b in rows:
            texts = [_normal(t.as_py()) for t in b.column(1)]
            sets = [shingles(t, shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([_prefix(s, *common.value).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))], names=["key", "digest", "n", "grams"])

    fps = stored(rows.mapInArrow(batches, f"key {kind}, digest binary, n int, grams array<long>"), "shingles")
    own = stored(fps.groupBy("digest").agg(F.min("key").alias("least")), "distinct-texts")
    copies = stored(fps.select("key", "digest").join(own, "digest").where("key != least").select("key", "digest", "least").distinct(), "copies")
    first = fps.join(_small(copies.select("key", "digest")), ["key", "digest"], "left_anti")
    grams = first.select("key", "n", F.posexplode("grams").alias("at", "z")).select("z", "key", "n", (F.col("n") - F.col("at")).alias("rest"))
    same = Window.partitionBy("z")
    met = grams.select("*", F.min("key").over(same).alias("a"), F.max("key").over(same).alias("last")).where("a != last").drop("last")
    met = stored(met, "common-shingles")
    near = _alike(met.where("a != key").groupBy("key").agg(F.min("a").alias("a")).select("a", F.col("key").alias("b")), rows, shingle)
    group = stored(components(near), "first-groups")
    named = met.drop("a").join(group, met["key"] == group["node"], "left").select("z", "key", "n", "rest", F.coalesce("root", "key").alias("group"))
    sizes = named.groupBy("z", "group").count().groupBy("z").agg(F.max_by("group", F.struct("count", "group")).alias("most"), F.count("*").alias("groups"))
    loose = stored(named.join(sizes.where("groups > 1").drop("groups"), "z"), "loose")
    x, y = loose.where("group != most").alias("x"), loose.alias("y")
    pairs = x.join(y, (F.col("x.z") == F.col("y.z")) & (F.col("x.group") != F.col("y.group"))
                   & ((F.col("y.group") == F.col("y.most")) | (F.col("x.key") < F.col("y.key")))
                   & (9 * F.least("x.rest", "y.rest") >= 4 * (F.col("x.n") + F.col("y.n"))))
    more = _alike(pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct(), rows, shingle)
    root = components(copies.select(F.col("least").alias("a"), F.col("key").alias("b")).unionByName(near).unionByName(more))
    return fps.select("key").join(root, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("component"))


#: So many keys at most are sent to every executor.
BROADCAST_KEYS = 500_000


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """df without the rows whose class (fingerprints within two bits, as `classes` links them) has a smaller key; of rows
    that repeat that key one stays.

    Rows with a null key stay. Columns are as they were.
    """
    found = stored(classes(df.where(F.col(key).isNotNull()), key, text, shingle), "classes")
    gone = stored(found.where("key != component").select(F.col("key").alias("_simhash_gone")).distinct(), "gone")
    rest = df.join(_small(gone), df[key] == gone["_simhash_gone"], "left_anti")
    again = found.groupBy("key").count().where("count > 1").select(F.col("key").alias("_simhash_again"))
    again = stored(again, "repeated-keys")
    if again.isEmpty():
        return rest
    marked = rest.join(again, rest[key] == again["_simhash_again"], "left")
    one = marked.where(F.col("_simhash_again").isNotNull()).drop("_simhash_again").dropDuplicates([key])
    return marked.where(F.col("_simhash_again").isNull()).drop("_simhash_again").unionByName(one)
