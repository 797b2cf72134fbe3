"""Removal of repeated substrings by De Bruijn compaction.

The edges of the graph are the windows of `k` consecutive words. A window counts as repeated where it occurs unless
that is its first occurrence by (key, position); every word under a repeated window is removed.

Consecutive windows that share their minimizer, the least hash among their short grams, are one path without
branches that a single row stands for (a "super-k-mer", as in published De Bruijn compactors). Equal windows have equal
minimizers, so all copies of an edge meet under one minimizer:

1. Minimizers are counted; most occur once, and their windows can't be repeated. Those that occur again go into a bit
   map of fixed size, whose false hits cost time only.
2. Paths under the other minimizers are compacted to distinct contents, with the count and the first coordinates. The
   windows of different contents under one minimizer (where the graph branches) are compared one by one, which gives
   the first coordinates of each window of a content.
3. Every occurrence of a path is joined with its content; windows whose first coordinates are elsewhere are repeated.
   Neighbouring ones merge into spans of words, which are taken out of the text.

A path is identified by the 64-bit hash of its bytes and that of its minimizer, a window by the hash of its words and
that of its minimizer; coordinates say where the first copy is. Batches are pre-aggregated before each shuffle, so a
passage in a third of all texts is one row per batch.

Null and blank texts have no words. Texts under k words lose nothing. Rows with a null key are neither changed nor
compared. Rows that repeat a key are the same document: equal positions in them are the same occurrence.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window, functions as F

from .exprs import stored

K = 20
GRAM = 5
#: Bits of the map of repeated minimizers.
MAP_BITS = 27
#: A task hands on what it has pre-aggregated once that takes about so many bytes.
FLUSH_BYTES = 16 << 20


def mix(x):
    """Spreads the bits of an array of 64-bit hashes."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words, n: int):
    """Hash of each n consecutive word hashes."""
    import numpy as np

    m, size = np.uint64(0x9E3779B97F4A7C15), len(words) - n + 1
    out = words[:size].copy()
    for j in range(1, n):
        out = out * m + words[j:j + size]
    return mix(out)


def least(values, n: int):
    """Position of the leftmost least value in each n consecutive values."""
    import numpy as np

    best, at, span = values, np.arange(len(values)), 1
    while span < n:
        step = min(span, n - span)
        a, b = best[:len(best) - step], best[step:]
        take = b < a
        at = np.where(take, at[step:], at[:len(at) - step])
        best = np.where(take, b, a)
        span += step
    return at


def paths(text: str | None, k: int, gram: int):
    """(minimizers, first windows, numbers of windows) of the paths of a text, hashes of its words, and words; None if it has no path."""
    import numpy as np
    import xxhash

    words = text.encode().split() if text else []
    if len(words) < k:
        return None
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    grams = gram_hashes(hashes, gram)
    at = least(grams, k - gram + 1)
    cut = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], cut])
    n = np.diff(np.concatenate([first, [len(at)]]))
    return grams[at[first]], first, n, hashes, words


def _contents(words: list[bytes], first, n, k: int) -> list[int]:
    """Hash of the bytes of each path."""
    import numpy as np
    import xxhash

    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[first].tolist()
    stops = (ends[first + n + k - 2] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b]) for a, b in zip(starts, stops)]


def _each(rows: Iterator, k: int, gram: int) -> Iterator:
    """(key, paths) of one text at a time; its words are free again when the next text is asked for."""
    for b in rows:
        for key, t in zip(b.column(0), b.column(1)):
            if key.is_valid and (p := paths(t.as_py(), k, gram)) is not None:
                yield key.as_py(), p


def _signed(x):
    import numpy as np

    return np.asarray(x, np.uint64).view(np.int64)


def repeated_minimizers(docs: DataFrame, k: int, gram: int) -> DataFrame:
    """Column a: the minimizers that more than one path has."""
    def scan(rows: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def counted(found):
            a, c = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(_signed(a)), pa.array(c)], names=["a", "c"])

        found, size = [], 0
        for _, p in _each(rows, k, gram):
            found.append(p[0])
            size += p[0].nbytes
            if size >= FLUSH_BYTES:
                yield counted(found)
                found, size = [], 0
        if found:
            yield counted(found)

    return docs.mapInArrow(scan, "a long, c long").groupBy("a").agg(F.sum("c").alias("c")).where("c > 1").select("a")


def bit_map(minimizers: DataFrame, bits: int = MAP_BITS):
    """Set bits for the upper bits of a, as an array of 2 ** bits / 64 numbers."""
    import numpy as np

    place = F.shiftrightunsigned("a", 64 - bits)
    rows = minimizers.select(place.alias("place")).selectExpr("int(shiftright(place, 6)) w", "shiftleft(1L, int(place & 63)) b")
    got = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def _hit(bitmap, a, bits: int):
    import numpy as np

    place = a >> np.uint64(64 - bits)
    return (bitmap.view(np.uint64)[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


class _Pool:
    """Occurrences of paths as columns; the first of each content also has its count and the hashes of its windows."""

    #: Bytes that an occurrence and a content take beside their windows, about.
    ROW, CONTENT = 100, 350

    def __init__(self):
        self.a, self.s, self.keys, self.at, self.seen, self.rows, self.size = [], [], [], [], {}, 0, 0

    def add(self, key, a, s, first, n, windows):
        self.a.append(a)
        self.s.append(s)
        self.at.append(first)
        self.keys += [key] * len(a)
        for row, (pair, i, m) in enumerate(zip(zip(a.tolist(), s.tolist()), first.tolist(), n.tolist()), self.rows):
            if (old := self.seen.get(pair)) is None:
                # a copy: a view would keep the windows of the whole text
                self.seen[pair] = [1, key, i, windows[i:i + m].copy(), row]
                self.size += self.CONTENT + 8 * m
            else:
                old[0] += 1
                if (key, i) < (old[1], old[2]):
                    old[1:] = key, i, windows[i:i + m].copy(), row
        self.rows += len(a)
        self.size += self.ROW * len(a)

    def batch(self):
        import numpy as np
        import pyarrow as pa

        count, sizes, parts = np.zeros(self.rows, np.int64), np.zeros(self.rows + 1, np.int64), []
        for c, _, _, w, row in sorted(self.seen.values(), key=lambda x: x[4]):
            count[row], sizes[row + 1] = c, len(w)
            parts.append(w)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(parts)))
        a, s, at = map(np.concatenate, (self.a, self.s, self.at))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(s), pa.array(self.keys), pa.array(at, pa.int64()), pa.array(count), lists],
                                          names=["a", "s", "doc", "at", "c", "windows"])


def occurrences(docs: DataFrame, known, k: int, gram: int) -> DataFrame:
    """(a, s, doc, at, c, windows) of every path under a repeated minimizer.

    In each flushed batch one occurrence of a content, the first one, has c > 0, the number of its occurrences in the
    batch, and the hashes of its windows; these rows are the pre-aggregated contents.
    """
    kind = docs.schema[0].dataType.simpleString()

    def scan(rows: Iterator) -> Iterator:
        import numpy as np

        bitmap, pool = known.value, _Pool()
        for key, (a, first, n, hashes, words) in _each(rows, k, gram):
            hit = np.flatnonzero(_hit(bitmap, a, MAP_BITS))
            if not len(hit):
                continue
            windows, a, first, n = gram_hashes(hashes, k).view(np.int64), _signed(a[hit]), first[hit], n[hit]
            s = _signed(np.array(_contents(words, first, n, k), np.uint64))
            for i in range(0, len(a), 1 << 16):  # a very long text fills several batches
                j = slice(i, i + (1 << 16))
                pool.add(key, a[j], s[j], first[j], n[j], windows)
                if pool.size >= FLUSH_BYTES:
                    yield pool.batch()
                    pool = _Pool()
        if pool.rows:
            yield pool.batch()

    return docs.mapInArrow(scan, f"a long, s long, doc {kind}, at long, c long, windows array<long>")


def contents(found: DataFrame) -> DataFrame:
    """(a, s, firsts): for the contents of paths with a repeated window, the first coordinates (doc, at) of each window."""
    one = found.where("c > 0").repartition("a").groupBy("a", "s").agg(F.sum("c").alias("c"), F.min(F.struct("doc", "at")).alias("first"), F.first("windows").alias("windows"))
    one = one.withColumn("m", F.count("*").over(Window.partitionBy("a"))).where("c > 1 or m > 1")
    each = one.select("a", "s", "c", "first", F.posexplode("windows").alias("o", "w"))
    own = F.struct(F.col("first.doc").alias("doc"), (F.col("first.at") + F.col("o")).alias("at"))
    each = each.select("a", "s", "c", "o", own.alias("own"), F.min(own).over(Window.partitionBy("a", "w")).alias("f"))
    back = each.groupBy("a", "s").agg(F.first("c").alias("c"), F.max(F.col("own") != F.col("f")).alias("moved"), F.sort_array(F.collect_list(F.struct("o", "f"))).alias("x"))
    return back.where("c > 1 or moved").select("a", "s", F.transform("x", lambda x: x["f"]).alias("firsts"))


def spans(docs: DataFrame, k: int = K, gram: int = GRAM) -> DataFrame:
    """(doc, hits): for documents with repeated windows, struct(at, mask): window at + o is repeated if bit o of mask is one.

    docs has the key as its first column and the text as its second.
    """
    known = docs.sparkSession.sparkContext.broadcast(bit_map(repeated_minimizers(docs, k, gram)))  # 2 ** MAP_BITS / 8 bytes
    found = stored(occurrences(docs, known, k, gram), "debruijn-paths")
    first = stored(contents(found), "debruijn-contents")
    met = found.select("a", "s", "doc", "at").join(first, ["a", "s"])
    bit = F.transform("firsts", lambda f, o: F.when((f["doc"] == F.col("doc")) & (f["at"] == F.col("at") + o), 0).otherwise(F.expr("1L")).cast("long"))
    mask = F.aggregate(F.reverse(bit), F.lit(0).cast("long"), lambda s, x: s * 2 + x)
    return met.select("doc", "at", mask.alias("mask")).where("mask != 0").groupBy("doc").agg(F.collect_set(F.struct("at", "mask")).alias("hits"))


def covered(n_words: int, hits: list[dict], k: int) -> list[bool]:
    """Which words lie under a repeated window."""
    import numpy as np

    edge = np.zeros(n_words + 1, np.int64)
    for h in hits:
        at, mask = h["at"], h["mask"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            edge[at + low] += 1
            edge[min(at + low + k, n_words)] -= 1
            mask &= mask - 1
    return (np.cumsum(edge[:-1]) > 0).tolist()


def _rebuilt(docs: DataFrame, key: str, text: str, k: int, gram: int, make: Callable, schema: str) -> DataFrame:
    """A row per document: key and what make(words, removed) gives; removed is None if no word is."""
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    hits = spans(slim, k, gram)
    met = slim.join(hits, slim["_key"] == hits["doc"], "left").select("_key", "_text", "hits")

    def scan(rows: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_type

        for b in rows:
            out = []
            for t, h in zip(b.column(1), b.column(2)):
                words = t.as_py().encode().split() if t.is_valid else []
                out.append(make(words, covered(len(words), h.as_py(), k) if h.is_valid else None))
            cols = [pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(zip(*out), kinds)] if out else [pa.array([], to_arrow_type(f.dataType)) for f in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, *[f.name for f in kinds]])

    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema).fields
    return met.mapInArrow(scan, f"{key} {docs.schema[key].dataType.simpleString()}, {schema}")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, gram: int = GRAM) -> DataFrame:
    """key, text (kept words joined by one space), n_words and n_removed of every document."""
    def make(words, removed):
        kept = words if removed is None else [w for w, r in zip(words, removed) if not r]
        return b" ".join(kept).decode(), len(words), len(words) - len(kept)

    return _rebuilt(docs, key, text, k, gram, make, f"{text} string, n_words long, n_removed long")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, gram: int = GRAM) -> DataFrame:
    """key, n_words, n_removed and kept_sha256 of every document; the texts stay in their tasks."""
    def make(words, removed):
        import hashlib

        kept = words if removed is None else [w for w, r in zip(words, removed) if not r]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return _rebuilt(docs, key, text, k, gram, make, "n_words long, n_removed long, kept_sha256 string")
