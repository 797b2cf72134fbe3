"""Token ids as equal-length sequences in Arrow files.

Documents are tokenized in a given order, an end id is put behind each, and the resulting stream of ids is cut
into sequences of `length` ids. A part of the stream, one range of the order, makes two Arrow IPC files:

* tokens: record batches of `ids` (fixed-size list of the smallest unsigned integers that hold the vocabulary)
  and `mask` (fixed-size list of booleans, true where an id is real). Only the last sequence of a part is padded.
* docs: for each document its key, the place of its first id in the part's stream, and its number of ids.

Both hold nothing but fixed-width values, so sequence i of a part is a view of the mapped file at batch
i // batch, row i % batch: no copy and no parsing. The manifest lists the parts in order.

Null and empty texts are the end id alone. Repeated rows are documents of their own, null keys sort first, extra
columns are ignored, an empty table gives an empty manifest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import files
from .exprs import shared_folder, stored

END_ID = 2
LENGTH = 2048
BATCH = 128
#: Words whose ids a task remembers.
REMEMBERED = 1_000_000


class Encoder:
    """Whole texts to ids with a byte-level BPE of the tokenizers library.

    Its pre-tokenizer ends a token before every single space or line feed that stands between two other
    characters, and between Latin letters and the punctuation behind them. So the text is cut there, the ids of
    known pieces are looked up, and words not yet known go to the library's BPE model. Pieces of any other kind
    are encoded by the whole tokenizer, and so are texts with other white space around a space or with one of the
    tokenizer's added tokens (such as an end-of-text sign), which get their own ids as the library gives them; with
    added_as_text they are spelled out like any other characters. Ids come as bytes of the given numpy type.
    """

    class _Whole(Exception):
        pass

    def __init__(self, path: str, dtype: str, added_as_text: bool = False):
        import re
        from array import array

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pieces hold no added token, so none is looked for
        self.whole = Tokenizer.from_file(path)
        self.added = [] if added_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if dtype == "<u2" else "I"
        plain, tokenize, code = self.plain, self.tokenizer.model.tokenize, self.code
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = str.maketrans({c: spell(c)[0][0] for c in map(chr, range(0xC0, 0x250)) if c.isalpha()})
        word = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]{1,64}").fullmatch
        line_feed = plain("\n")

        class Known(dict):
            lead = sign = ""
            after: Known

            def __missing__(self, piece: str) -> bytes:
                if word(piece):
                    ids = array(code, [t.id for t in tokenize(self.sign + (piece if piece.isascii() else piece.translate(letters)))]).tobytes()
                elif word(bare := piece.rstrip(".,;:!?#*$%&|")):
                    ids = self[bare] + self.after[piece[len(bare):]]
                elif not piece or piece[0].isspace() or piece[-1].isspace():
                    raise Encoder._Whole
                elif "\n" in piece:
                    head, *tail = piece.split("\n")
                    return self[head] + b"".join(x for t in tail for x in (line_feed, self.after[t]))
                else:
                    ids = plain(self.lead + piece)
                if len(self) < REMEMBERED and len(piece) < 64:
                    self[piece] = ids
                return ids

        self.first, self.spaced = Known(), Known()
        self.spaced.lead, self.spaced.sign = " ", spell(" ")[0][0]
        self.first.after = self.spaced.after = self.first

    def plain(self, text: str) -> bytes:
        from array import array

        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        from array import array

        if not text:
            return b""
        for t in self.added:
            if t in text:
                return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        head, *tail = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.spaced.__getitem__, tail))
        except Encoder._Whole:
            return self.plain(text)


def id_type(size: int) -> str:
    """The numpy type of ids of a vocabulary of that size."""
    return "<u2" if size <= 1 << 16 else "<u4"


@dataclass
class TokenFiles:
    """What `write` made: the folder, the manifest (part, first, n_docs, n_tokens, tokens, docs) and the format."""

    folder: str
    manifest: DataFrame
    key: str
    key_type: str
    dtype: str
    length: int


def _writer(folder: str, part: int, tokenizer: str, dtype: str, length: int, end_id: int):
    """Returns (add(keys, texts), close()) for the two files of one part."""
    import numpy as np
    import pyarrow as pa

    one = pa.from_numpy_dtype(np.dtype(dtype))
    schema = pa.schema([("ids", pa.list_(one, length)), ("mask", pa.list_(pa.bool_(), length))])
    size = np.dtype(dtype).itemsize
    names = files.fresh("tokens", part, "arrow"), files.fresh("docs", part, "arrow")
    sinks = [files.create(folder, n) for n in names]
    encoder, end = Encoder(tokenizer, dtype), np.array([end_id], dtype).tobytes()
    tokens, docs = pa.ipc.new_file(sinks[0], schema), None
    held, waiting, total, n_docs = [], 0, 0, 0
    full = BATCH * length

    def put(ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        tokens.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), length),
                                                       pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema))

    def flush(last: bool) -> None:
        nonlocal held, waiting
        data = np.frombuffer(b"".join(held), dtype)
        n = len(data) // full * full
        for at in range(0, n, full):
            put(data[at:at + full], full)
        rest = data[n:]
        if last and len(rest):
            put(np.concatenate([rest, np.zeros(-len(rest) % length, dtype)]), len(rest))
            rest = rest[:0]
        held, waiting = [rest.tobytes()], len(rest)

    def add(keys: pa.Array, texts: pa.Array) -> None:
        nonlocal docs, total, waiting, n_docs
        first, counts = [], []
        for t in texts:
            ids = encoder.encode(t.as_py()) + end
            held.append(ids)
            first.append(total)
            counts.append(len(ids) // size)
            total += counts[-1]
            waiting += counts[-1]
            if waiting >= full:
                flush(False)
        b = pa.RecordBatch.from_arrays([keys, pa.array(first, pa.int64()), pa.array(counts, pa.int64())], names=["key", "first", "n_tokens"])
        docs = docs or pa.ipc.new_file(sinks[1], b.schema)
        docs.write_batch(b)
        n_docs += len(counts)

    def close() -> tuple[str, str, int, int]:
        flush(True)
        tokens.close()
        docs.close()
        for s in sinks:
            s.close()
        return (*names, n_docs, total)

    return add, close


def write(df: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", order: list[str] | None = None,
          end_id: int = END_ID, length: int = LENGTH, vocabulary: int = 50257) -> TokenFiles:
    """Writes the texts of df in ascending order of `order` (default: key, then text) to folder.

    tokenizer: a file of the tokenizers library that every executor can open.
    """
    dtype, kind = id_type(max(vocabulary, end_id + 1)), df.schema[key].dataType.simpleString()
    ties = [] if order else [text]
    order = order or [key]  # ranges go by the order alone: their samples come to the driver
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order, *ties).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def part(rows: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        out, at = None, TaskContext.get().partitionId()
        for b in rows:
            if b.num_rows:
                out = out or _writer(folder, at, tokenizer, dtype, length, end_id)
                out[0](b.column(0), b.column(1))
        if out:
            tokens, docs, n_docs, n_tokens = out[1]()
            yield pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int64()), "tokens": [tokens], "docs": [docs],
                                              "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    made = stored(ranged.mapInArrow(part, "part long, tokens string, docs string, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    manifest = made.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    return TokenFiles(folder, manifest, key, kind, dtype, length)


def _stream(reader, length: int) -> Iterator:
    """Views of the real ids of a tokens file, batch by batch."""
    for i in range(reader.num_record_batches):
        b = reader.get_batch(i)
        real = b.column(1).values.true_count
        yield b.column(0).values.to_numpy(zero_copy_only=True)[:real]


def read_documents(made: TokenFiles) -> DataFrame:
    """Per document, from the files alone: key, start (ids of all documents before it), n_tokens, ids_crc32, part."""
    folder, length, key = made.folder, made.length, made.key
    todo = made.manifest.select("part", "first", "tokens", "docs")
    todo = todo.repartition(max(1, made.manifest.sparkSession.sparkContext.defaultParallelism * 2))

    def read(rows: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in rows:
            for row in b.to_pylist():
                docs = pa.ipc.open_file(files.opened(folder, row["docs"]))
                stream = _stream(pa.ipc.open_file(files.opened(folder, row["tokens"])), length)
                now = next(stream, None)
                for i in range(docs.num_record_batches):
                    d = docs.get_batch(i)
                    crcs = []
                    for n in d.column(2).to_pylist():
                        crc = 0
                        while n:
                            if not len(now):
                                now = next(stream)
                            piece, now = now[:n], now[n:]
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                            n -= len(piece)
                        crcs.append(crc)
                    start = d.column(1).to_numpy() + row["first"]
                    yield pa.RecordBatch.from_arrays([d.column(0), pa.array(start), d.column(2), pa.array(np.array(crcs, np.int64)),
                                                      pa.array(np.full(len(crcs), row["part"], np.int64))],
                                                     names=[key, "start", "n_tokens", "ids_crc32", "part"])

    return todo.mapInArrow(read, f"{key} {made.key_type}, start long, n_tokens long, ids_crc32 long, part long")


def sequence(folder: str, tokens: str, i: int):
    """(ids, mask) of sequence i of one tokens file; ids is a view of the file."""
    import pyarrow as pa

    reader = pa.ipc.open_file(files.opened(folder, tokens))
    b = reader.get_batch(i // BATCH)
    ids, mask = b.column(0)[i % BATCH].values, b.column(1)[i % BATCH].values
    return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def written(df: DataFrame, tokenizer: str, **options) -> TokenFiles:
    """`write` to a fresh shared folder."""
    spark: SparkSession = df.sparkSession
    return write(df, shared_folder(spark, "tokens"), tokenizer, **options)
