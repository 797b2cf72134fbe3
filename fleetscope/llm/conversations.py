"""Repair of the structure of conversations by a run-length dynamic program.

A conversation's rows, in the order of their turns, become one symbol each: the initial of the role (s, u, a or another)
and the row's first fault: blank, duplicate (role and text seen earlier) or truncated (the last visible character ends no
sentence). The cheapest edits are sought after which the role initials read `(s?(ua)+)?`:

    K  keep                        0      D  delete                            2 (blank and duplicate rows must go)
    R  make it user or assistant   1      I  insert an empty user or assistant 5, anywhere
    a truncated row that stays     5 more

Four states (nothing yet, after s, after u, after a) make each symbol a 4 x 4 min-plus matrix. Equal consecutive symbols
collapse into runs, and a run of length L is applied through the cached binary powers of its matrix. That gives the cost
to go at every run's end; the choices are then unrolled forward from the first state, taking the least of the letters D, I,
K, R that is still cheapest, so of all cheapest edits those with the ASCII-least audit are found.

Conversations of up to `large` bytes are dealt to tasks whole, and a task holds one of them at a time. Matrices are
associative, so larger ones are cut into segments of at most 65,536 rows anywhere in the cluster: each segment gives its
matrix, the product from the right gives the cost to go behind every segment, each segment is unrolled from all four
states, and the states between segments are followed from the left. Only their texts' SHA-256, which has no parallel form,
is read through one task, row by row.

Order of rows: turn (nulls first), then role, then text, so repeated rows lie side by side; the first one is no duplicate.
A null role or text counts as one space, a null conversation key is a conversation of its own, null turns take no part in
the gaps. Roles with other initials than s, u, a can't be kept. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from .exprs import stored

NONE, TRUNCATED, BLANK, DUPLICATE = range(4)
CLASSES = "sua"
#: States, and where an inserted or renamed row leads from each: user, or assistant after user.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: Where a kept row of each initial leads from each state; None where it may not stand.
KEPT = {0: (AFTER_S, None, None, None), 1: (AFTER_U, AFTER_U, None, AFTER_U), 2: (None, None, AFTER_A, None), 3: (None,) * 4}
DELETE, INSERT, RENAME, BROKEN = 2, 5, 1, 5
FAR = 1 << 60
BITS = 16  # 2^16 rows a segment
LARGE = 64 << 20
ENDS = b".!?"
SPACES = b" \t\n\x0b\x0c\r"
Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


def _inserts() -> Matrix:
    once = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else FAR for j in range(4)) for i in range(4))
    return times(once, once)  # two inserts lead anywhere that inserts lead


INSERTS = _inserts()
#: Cost to go after the last row: nothing or a whole answer may end a conversation.
END = apply(INSERTS, (0, FAR, FAR, 0))


def moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, in the order of the letters."""
    role, fault = symbol & 3, symbol >> 2
    out = [("D", DELETE, state)]
    if fault <= TRUNCATED:
        more = BROKEN if fault else 0
        if KEPT[role][state] is not None:
            out.append(("K", more, KEPT[role][state]))
        out.append(("R", RENAME + more, NEXT[state]))
    return out


@lru_cache(None)
def power(symbol: int, k: int) -> Matrix:
    """2^k rows of one symbol, each with what is inserted before it. There are 16 symbols."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    row = [[FAR] * 4 for _ in range(4)]
    for i in range(4):
        for _, cost, j in moves(symbol, i):
            row[i][j] = min(row[i][j], cost)
    return times(INSERTS, tuple(map(tuple, row)))


def runs(symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) of the runs of equal symbols."""
    out, at = [], 0
    while at < len(symbols):
        end, x = at + 1, symbols[at]
        while end < len(symbols) and symbols[end] == x:
            end += 1
        out.append((x, end - at))
        at = end
    return out


def product(symbols: bytes) -> Matrix:
    """The matrix of a whole segment."""
    out = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
    for x, n in runs(symbols):
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = times(out, power(x, k))
    return out


def cost_to_go(symbols: bytes, behind: Vector) -> tuple[Vector, list[Vector]]:
    """The cost to go before the segment, and at the end of each of its runs."""
    ends = []
    for x, n in reversed(runs(symbols)):
        ends.append(behind)
        for k in range(n.bit_length()):
            if n >> k & 1:
                behind = apply(power(x, k), behind)
    return behind, ends[::-1]


@lru_cache(100_000)
def _back(symbol: int, behind: Vector) -> Vector:
    return relative(apply(power(symbol, 0), behind))


def relative(v: Vector) -> Vector:
    """Only differences decide, so few vectors occur."""
    low = min(v)
    return tuple(x - low for x in v)


@lru_cache(100_000)
def _choose(symbol: int, state: int, behind: Vector) -> tuple[str, int]:
    """The least letters for a row and what is inserted before it, and the state after it."""
    here, out = apply(power(symbol, 0), behind), ""
    while True:
        for letter, cost, to in sorted([*((c, w, (True, s)) for c, w, s in moves(symbol, state)), ("I", INSERT, (False, NEXT[state]))]):
            taken, to_state = to
            if cost + (behind if taken else here)[to_state] == here[state]:
                out, state = out + letter, to_state
                if taken:
                    return out, state
                break


def closing(state: int) -> str:
    """What is inserted after the last row."""
    return {AFTER_S: "II", AFTER_U: "I"}.get(state, "")


def unroll(symbols: bytes, state: int, behind: Vector) -> tuple[str, int]:
    """The letters for a segment entered in a state, with the cost to go behind it, and the state it is left in."""
    _, ends = cost_to_go(symbols, behind)
    out = []
    for (x, n), end in zip(runs(symbols), ends):
        after = [relative(end)]
        for _ in range(n - 1):
            after.append(_back(x, after[-1]))
        for v in reversed(after):
            letters, state = _choose(x, state, v)
            out.append(letters)
    return "".join(out), state


def symbol(role: str, text: str, seen: bool) -> int:
    """Role class and first fault of a row."""
    bare = text.encode().strip(SPACES)
    fault = BLANK if not bare else DUPLICATE if seen else TRUNCATED if bare[-1] not in ENDS else NONE
    return (CLASSES.find(role[0]) & 3 if role else 3) | fault << 2


def _faults(symbols: bytes, before: int | None) -> tuple[int, int, int, int]:
    """How many rows are blank, duplicate and truncated, and how many neighbours have roles that may not follow each other."""
    count, illegal = [0] * 4, 0
    for x in symbols:
        count[x >> 2] += 1
        illegal += before is not None and (before, x & 3) not in ((0, 1), (1, 2), (2, 1))
        before = x & 3
    return count[BLANK], count[DUPLICATE], count[TRUNCATED], illegal


class Writer:
    """Hash of the repaired rows, which come one by one with the audit's letters."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, START, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _named(self, text: str) -> None:
        self.state = NEXT[self.state]
        self._put("user" if self.state == AFTER_U else "assistant", text)

    def _inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self._named("")

    def row(self, role: str, text: str) -> None:
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self._named(text)
        elif letter == "K":
            self.state = KEPT[CLASSES.find(role[0]) & 3][self.state]
            self._put(role, text)

    def end(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FIELDS = [x.split()[0] for x in RESULT.split(", ")]


def _whole(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations that a task can hold one by one."""

    def solved(turns: list, said: list) -> tuple:
        seen, codes = set(), bytearray()
        for pair in said:
            codes.append(symbol(*pair, pair in seen))
            seen.add(pair)
        there = {t for t in turns if t is not None}
        gaps = max(there) - min(there) + 1 - len(there) if there else 0
        codes = bytes(codes)
        audit, state = unroll(codes, START, END)
        writer = Writer(audit + closing(state))
        for pair in said:
            writer.row(*pair)
        return gaps, *_faults(codes, None), cost_to_go(codes, END)[0][START], writer.audit, writer.end()

    def batches(parts: Iterator) -> Iterator:
        import pyarrow as pa

        conv, turns, said, out = None, [], [], []

        def table() -> pa.RecordBatch:
            cols = list(zip(*out))
            types = [pa.int64()] * 6 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *(pa.array(c, t) for c, t in zip(cols[1:], types))], names=["conv", *FIELDS])

        key_type = None
        for b in parts:
            key_type = b.schema.field(0).type
            for k, turn, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if turns and k != conv:
                    out.append((conv, *solved(turns, said)))
                    turns, said = [], []
                conv = k
                turns.append(turn)
                said.append((role, text))
            if out:
                yield table()
                out = []
        if turns:
            out.append((conv, *solved(turns, said)))
            yield table()

    dealt = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(batches, f"conv {kind}, {RESULT}")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))


def _arrow(df: DataFrame, of, schema: str) -> DataFrame:
    """The rows that of() yields for each row of df, as tuples of the schema's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = to_arrow_schema(StructType.fromDDL(schema))

    def batches(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for b in parts:
            for i in range(b.num_rows):
                found = list(of(*(c[i].as_py() for c in b.columns)))
                yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in found], schema=shape)

    return df.mapInArrow(batches, schema)


def _cut(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations of any size, segment by segment."""
    turn, key = F.col("turn"), f"conv {kind}, seg long"
    rows = rows.withColumn("digest", F.unhex(F.md5(F.concat("role", F.lit("\0"), "text"))))
    often = rows.groupBy("conv", "digest").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.bool_or(F.isnull("turn")).alias("unset"))
    often = often.where("low < high or (unset and low is not null)")
    later = F.coalesce(F.when(F.col("unset"), turn.isNotNull()).otherwise(turn > F.col("low")), F.lit(False))
    rows = rows.alias("r").join(often.alias("o"), _same("r", "o") & (F.col("r.digest") == F.col("o.digest")), "left").select("r.conv", "turn", "role", "text", later.alias("later"))
    order = ["conv", turn.asc_nulls_first(), "role"]

    def marked(parts: Iterator) -> Iterator:
        import pyarrow as pa

        last = None
        for b in parts:
            codes = []
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                codes.append(symbol(row[2], row[3], row[4] or row[:4] == last))
                last = row[:4]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(codes, pa.int32())], names=["conv", "role", "text", "code"])

    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")  # equal rows are never parted
    placed = stored(ranged.mapInArrow(marked, f"conv {kind}, role string, text string, code int").withColumn("at", F.monotonically_increasing_id()), "turns")
    listed = F.array_sort(F.collect_list(F.struct("at", "code")))  # 2^16 rows at most
    segs = placed.groupBy("conv", F.shiftright("at", BITS).alias("seg")).agg(listed.alias("rows")).select("conv", "seg", F.col("rows.code").alias("codes"))
    segs = stored(segs, "segments")

    whole = _arrow(segs, lambda c, s, codes: [(c, s, [x for r in product(bytes(codes)) for x in r], codes[0] & 3, codes[-1] & 3, *_faults(bytes(codes), None))],
                   f"{key}, m array<long>, first int, last int, blank long, duplicate long, truncated long, illegal long")
    whole = stored(whole, "products").groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("seg", "m", "first", "last"))).alias("s"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])

    def behind(conv, s, *counts):
        v, out = END, []
        for x in reversed(s):
            out.append((conv, x["seg"], list(v)))
            v = apply(tuple(tuple(x["m"][4 * i:4 * i + 4]) for i in range(4)), v)
        border = sum((a["last"], b["first"]) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(s, s[1:]))
        return [(*r, v[START], *counts[:3], counts[3] + border) for r in out]

    ahead = stored(_arrow(whole, behind, f"{key}, v array<long>, cost long, blank long, duplicate long, truncated long, illegal long"), "costs")
    on = _same("a", "b") & (F.col("a.seg") == F.col("b.seg"))
    tried = segs.alias("a").join(ahead.alias("b"), on).select("a.conv", "a.seg", "a.codes", "b.v")

    def each(conv, seg, codes, v):
        letters, exits = zip(*(unroll(bytes(codes), s, tuple(v)) for s in range(4)))
        yield conv, seg, list(letters), list(exits)

    tried = stored(_arrow(tried, each, f"{key}, letters array<string>, exits array<int>"), "unrolled")

    def followed(conv, s):
        state = START
        for x in s:
            yield conv, x["seg"], state, closing(x["exits"][state]) if x["seg"] == s[-1]["seg"] else ""
            state = x["exits"][state]

    entered = _arrow(tried.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seg", "exits")))), followed, f"{key}, state int, closing string")
    pieces = tried.alias("a").join(entered.alias("b"), on).select("a.conv", "a.seg", F.concat(F.col("letters")[F.col("state")], "closing").alias("piece"))
    audits = pieces.groupBy("conv").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seg", "piece")))["piece"], "").alias("audit"))
    audits = stored(audits, "audits")

    def hashed(parts: Iterator) -> Iterator:
        import pyarrow as pa

        conv, writer, key_type = None, None, None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([conv], key_type), pa.array([writer.end()])], names=["conv", "repaired_sha256"])
        for b in parts:
            key_type = b.schema.field(0).type
            for k, at, role, text in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                if at.as_py() < 0:
                    if writer:
                        yield one()
                    conv, writer = k.as_py(), Writer(text.as_py())
                else:
                    writer.row(role.as_py(), text.as_py())
        if writer:
            yield one()

    told = audits.select("conv", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    told = told.unionByName(placed.select("conv", "at", "role", "text")).repartition("conv").sortWithinPartitions("conv", "at")
    hashes = told.mapInArrow(hashed, f"conv {kind}, repaired_sha256 string")
    gaps = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    sums = ahead.groupBy("conv").agg(*[F.max(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    out = sums.alias("a").join(audits.alias("b"), _same("a", "b")).join(hashes.alias("c"), _same("a", "c")).join(gaps.alias("d"), _same("a", "d"))
    return out.select("a.conv", *FIELDS)


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", large: int = LARGE) -> DataFrame:
    """conv and the result columns of every conversation in df."""
    kind, blank = df.schema[key].dataType.simpleString(), F.lit(" ")
    rows = df.select(F.col(key).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, blank).alias("role"), F.coalesce(text, blank).alias("text"))
    size = rows.groupBy("conv").agg(F.sum(F.octet_length("text") + F.octet_length("role") + 200).alias("size"))
    big = stored(size.where(F.col("size") > large).select("conv"), "large-conversations")
    if big.isEmpty():
        return _whole(rows, kind)
    part = lambda how: rows.alias("r").join(big.alias("b"), _same("r", "b"), how).select("r.*")
    return _whole(part("left_anti"), kind).unionByName(_cut(part("left_semi"), kind))


def damage(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The faults that tests plant: by crc32(`key:turn`) % 20, 0 drops a row, 1 empties its text, 2 takes `.!?` out of it,
    3 repeats it, 4 makes its role user. Nulls count as one space."""
    blank = F.lit(" ")
    word = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    fate = F.crc32(F.concat_ws(":", word(key), word(turn)).cast("binary")) % 20
    rows = df.select(F.col(key), F.col(turn), word(role).alias(role), word(text).alias(text), fate.alias("_fate")).where("_fate != 0")
    said = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate(F.col(text), ".!?", "")).otherwise(F.col(text))
    copies = F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select(key, turn, F.when(F.col("_fate") == 4, "user").otherwise(F.col(role)).alias(role), said.alias(text), copies.alias("_copy")).drop("_copy")


def repair_all(df: DataFrame, damaged: DataFrame, key: str = "conv_id", **how) -> DataFrame:
    """repair(damaged), and zeros, an empty audit and the hash of nothing for conversations of df of which no row is left."""
    every = df.select(F.col(key).alias("conv")).distinct()
    none = hashlib.sha256().hexdigest()
    met = every.alias("e").join(repair(damaged, key, **how).alias("f"), _same("e", "f"), "left")
    fill = [F.coalesce(F.col(f"f.{c}"), F.lit({"audit": "", "repaired_sha256": none}.get(c, 0))).alias(c) for c in FIELDS]
    return met.select("e.conv", *fill)
