"""Benchmark decontamination by pigeonhole edit matching.

An item of m words may occur in a text with up to e = floor(rate * m) words inserted, deleted or replaced. It is
split into e + 1 pieces of near equal length: e errors cannot touch all of them, so one piece occurs unchanged.
Exact hits of the pieces, found by one Aho-Corasick scan of the text, give the only windows where the item can
be; there Myers' bit-parallel algorithm computes the edit distance in words.

Words are compared in lower case with ASCII punctuation taken as space. Items without a word, or with fewer than
`min_words`, match nothing: they cannot be told from chance. Null and empty texts match nothing. Repeated items
match like one, repeated rows are matched one by one. The benchmark is scanned for in blocks of bounded size, so
it may be larger than a task's memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

RATE = 0.2
MIN_WORDS = 6
BLOCK_BYTES = 4_000_000

_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> list[bytes]:
    """The words of a text as they are compared."""
    return text.lower().encode().translate(_PLAIN).split() if text else []


def pieces(words: list[bytes], rate: float) -> list[tuple[int, list[bytes]]]:
    """(offset, words) of the e + 1 pieces of an item."""
    n = math.floor(rate * len(words)) + 1
    cuts = [len(words) * i // n for i in range(n + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Least edit distance between pattern and any part of text, and the end of the first such part."""
    m = len(pattern)
    where: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, w in enumerate(text, 1):
        eq = where.get(w, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up = minus | ~(d | plus) & full
        down = plus & d
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus = (down | ~(d | up)) & full
        minus = up & d
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Finds the items of one block in texts. items: (id, text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, min_words: int = MIN_WORDS):
        import ahocorasick

        self.rate, self.items = rate, [(k, w) for k, t in items if len(w := plain(t)) >= max(1, min_words)]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, w) in enumerate(self.items):
            for at, p in pieces(w, rate):
                found.setdefault(f" {b' '.join(p).decode('latin-1')} ", []).append((i, at))
        self.scan = ahocorasick.Automaton()
        for key, owners in found.items():
            self.scan.add_word(key, (len(key), owners))
        if found:
            self.scan.make_automaton()

    def windows(self, joined: str) -> dict[int, list[tuple[int, int]]]:
        """For each item with piece hits, the word ranges to verify, merged where they overlap."""
        import numpy as np

        out: dict[int, list[tuple[int, int]]] = {}
        starts = None
        for end, (size, owners) in self.scan.iter(joined):
            if starts is None:
                starts = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
            word = int(np.searchsorted(starts, end - size + 1))
            for i, at in owners:
                m = len(self.items[i][1])
                e = math.floor(self.rate * m)
                a, b = max(0, word - at - e), word - at + m + e
                spans = out.setdefault(i, [])
                if spans and a <= spans[-1][1] and a >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
        return out

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, first word, word after the last) of the best place of each item in the text."""
        if not self.items or not (words := plain(text)):
            return []
        best: dict[int, tuple[int, int, int]] = {}
        for i, spans in self.windows(f" {b' '.join(words).decode('latin-1')} ").items():
            key, pattern = self.items[i]
            for a, b in spans:
                part = words[a:b]
                d, end = myers(pattern, part)
                if d <= math.floor(self.rate * len(pattern)):
                    _, back = myers(pattern[::-1], part[:end][::-1])
                    best[key] = min(best.get(key, (d, a + end - back, a + end)), (d, a + end - back, a + end))
        return [(k, *v) for k, v in sorted(best.items())]

    def any(self, text: str | None) -> bool:
        return bool(self.find(text))


def blocks(items: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_bytes; null texts and ids are left out."""
    items = items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / block_bytes))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i)
        yield sorted({(r.k, r.t) for r in part.collect()})


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
            rate: float = RATE, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per document row and item found in it: key, item, distance, first_word, end_word (exclusive)."""
    kinds = f"{key} {docs.schema[key].dataType.simpleString()}, {item} {items.schema[item].dataType.simpleString()}"
    schema = f"{kinds}, distance int, first_word long, end_word long"
    slim, out = docs.select(F.col(key), F.col(text)), None
    kind = to_arrow_type(items.schema[item].dataType)
    for block in blocks(items, item, item_text):
        def scan(rows: Iterator, block=block) -> Iterator:
            import pyarrow as pa

            m = Matcher(block, rate, min_words)
            for b in rows:
                ids, found = [], []
                for i, t in enumerate(b.column(1)):
                    for hit in m.find(t.as_py()):
                        ids.append(i)
                        found.append(hit)
                cols = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(cols[0], kind), pa.array(cols[1], pa.int32()),
                                                  pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                                                 names=[key, item, "distance", "first_word", "end_word"])

        part = slim.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  rate: float = RATE, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs in whose text no item occurs, all columns as they were; one pass per block, no shuffle."""
    at = docs.columns.index(text)
    for block in blocks(items, item, item_text):
        def scan(rows: Iterator, block=block) -> Iterator:
            import pyarrow as pa

            m = Matcher(block, rate, min_words)
            for b in rows:
                yield b.filter(pa.array([not m.any(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
