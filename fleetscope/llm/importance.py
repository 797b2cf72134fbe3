"""Importance resampling towards a target: documents whose n-grams look like those of a target corpus are drawn more often.

Words are found on the bytes of a text: one table of 256 bytes puts A-Z in lower case and blanks every byte that is no
letter, digit or part of a longer character, and `bytes.split` yields the words. A feature is a run of one to `n`
consecutive words; its CRC-32 is that of the run one word shorter, carried on as the seed. Counters reduce the features of
a task to the counts of at most `buckets` buckets before anything is shuffled.

A bucket's gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), with s of the S features of all documents
and t of the T of all target texts in it. A document's weight is the floored mean of its features' gains. Adding Gumbel
noise from its key and taking the highest scores draws without replacement in proportion to exp(weight / 1000).

The gains are one number per bucket, so they go to every task. The order of the scores is cut into ranges, so no task sees
all of them. A text is taken in pieces of 1 MB, so a very long one needs its own bytes and one piece's words.

Null and empty texts and those without a word have no features and weight 0. Rows with a null key take the noise of the
empty key and come last among equal scores; repeated rows are counted and drawn one by one. Without documents the result
is empty; without target texts every t is 0. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, functions as F

from ..operators import ordered
from .exprs import stored

#: Bytes of words as they are, A-Z in lower case, all others as a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE = 1 << 20
#: Words whose gain a task remembers at once.
REMEMBERED = 500_000


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a list for each piece of it."""
    data, at = (text or "").encode().translate(TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield (data if end - at == len(data) else data[at:end]).split()
        at = end


def longer(words: Iterator[list[bytes]], n: int) -> Iterator[list[int]]:
    """CRC-32 of every run of two to n words, a list for each piece and length."""
    tail: list[bytes] = []
    for piece in words:
        runs, known, tail = tail + piece, len(tail), (tail + piece)[-(n - 1):]
        seeds = [crc32(w) for w in runs]
        for size in range(2, n + 1):
            seeds = [crc32(b" " + w, seed) for seed, w in zip(seeds, runs[size - 1:])]
            yield seeds[max(0, known - size + 1):]  # runs that end in this piece


def bucket_counts(texts: DataFrame, text: str, n: int, buckets: int) -> list[int]:
    """How many features of all texts each bucket has."""

    def batches(rows: Iterator) -> Iterator:
        import pyarrow as pa

        found: Counter = Counter()
        for b in rows:
            words: Counter = Counter()
            for t in b.column(0):
                for piece in pieces(t.as_py()):
                    words.update(piece)
                    if len(words) > REMEMBERED:
                        _reduce(found, words, buckets)
                if n > 1:
                    for runs in longer(pieces(t.as_py()), n):
                        found.update(c % buckets for c in runs)
            _reduce(found, words, buckets)
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], names=["bucket", "n"])

    rows = texts.select(F.col(text).alias("text")).mapInArrow(batches, "bucket int, n long")
    out = [0] * buckets
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[r["bucket"]] = r["n"]
    return out


def _reduce(found: Counter, words: Counter, buckets: int) -> None:
    for w, k in words.items():
        found[crc32(w) % buckets] += k
    words.clear()


def gains(raw: list[int], target: list[int]) -> list[int]:
    """The gain of each bucket from its counts in the documents and in the target."""
    size, all_raw, all_target = len(raw), sum(raw), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(all_raw + size) / (float(s + 1) * float(all_target + size)))) for s, t in zip(raw, target)]


class _Gains(dict):
    """Gain of a word, remembered for a bounded number of words."""

    def __init__(self, per_bucket: list[int]):
        self.per_bucket = per_bucket

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        gain = self[word] = self.per_bucket[crc32(word) % len(self.per_bucket)]
        return gain


def weights(df: DataFrame, per_bucket: list[int], key: str = "doc_id", text: str = "text", n: int = 1) -> DataFrame:
    """key, n_words, n_features and weight of every row."""
    kind = df.schema[key].dataType.simpleString()

    def batches(rows: Iterator) -> Iterator:
        import pyarrow as pa

        known, size = _Gains(per_bucket), len(per_bucket)
        for b in rows:
            n_words, n_features, mean = [], [], []
            for t in b.column(1):
                words = features = total = 0
                for piece in pieces(t.as_py()):
                    words += len(piece)
                    total += sum(map(known.__getitem__, piece))
                features = words
                if n > 1:
                    for runs in longer(pieces(t.as_py()), n):
                        features += len(runs)
                        total += sum(per_bucket[c % size] for c in runs)
                n_words.append(words)
                n_features.append(features)
                mean.append(total // features if features else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, mean))],
                                             names=["key", "n_words", "n_features", "weight"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(batches, f"key {kind}, n_words long, n_features long, weight long")


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1,
             buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """key, n_words, n_features, weight, score and rank of every row; rank is null for rows that aren't drawn.

    Of the N rows with least_words words or more, floor(percent N / 100) are drawn.
    """
    per_bucket = gains(bucket_counts(df, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = (noise.cast("double") + 0.5) / F.lit(4294967296.0)
    scored = stored(weights(df, per_bucket, key, text, n).withColumn(
        "score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(noise))).cast("long")), "scores")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    placed = ordered.position(scored.where(able), [F.col("score").desc(), F.col("key").asc_nulls_last(), "n_features", "n_words"], "place")
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    return placed.withColumn("rank", rank).drop("place").unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
