"""Repaired conversations against a search of all edits by cost and letters, whole and in segments."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fleetscope.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, conv string, seg string, at string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """rows: (role, text, fault). The least (cost, letters) by Dijkstra; each entry carries what it has written."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, at, roles, said = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, "\n".join(said)
        if (at, roles[-1:]) in done:
            continue
        done.add((at, roles[-1:]))
        new = "a" if roles[-1:] == "u" else "u"
        full = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(heap, (cost + 5, letters + "I", at, roles + new, (*said, f"{full}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, letters + "D", at + 1, roles, said))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + 1 + more, letters + "R", at + 1, roles + new, (*said, f"{full}:{text}")))
                if (role[:1] == new) or (role[:1] == "s" and not roles):
                    heapq.heappush(heap, (cost + more, letters + "K", at + 1, roles + role[:1], (*said, f"{role}:{text}")))


def plain(rows):
    """conv: result, for rows in any order."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        for _, role, text in mine:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault))
        turns = {t for t, *_ in mine if t is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, letters, said = cheapest(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, letters,
                     hashlib.sha256(said.encode()).hexdigest())
    return out


def conversation(r, n, conv):
    roles = ["user", "assistant", "system", "user", "assistant", "other", "", None, "umpire", "System"]
    texts = ["Yes.", "No", "", " \t", "Why?", None, "é!", "same.", "x\x0b", "a\nb.", "."]
    turn, out = 0, []
    for _ in range(n):
        turn += r.choice([0, 1, 1, 1, 2])
        calm = r.random() < 0.5
        role = ("user", "assistant")[turn % 2] if calm else r.choice(roles)
        out.append((conv, r.choice([turn] * 9 + [None]), role, f"{turn} done." if calm else r.choice(texts)))
    return out


def rows(seed, convs=150, longest=14):
    r = random.Random(seed)
    out = [x for c in range(convs) for x in conversation(r, r.randint(1, longest), r.choice([c, c, None]) if c % 40 == 0 else c)]
    out += [(900, t, "user", "Same again.") for t in range(40)] + [(901, None, "assistant", "Same again.")] * 30
    r.shuffle(out)
    return out


def frame(spark, data):
    return spark.createDataFrame([(*x, "clash", None, "clash") for x in data], SCHEMA)


def found(df):
    assert df.columns == ["conv", *C.FIELDS]
    out = {r["conv"]: tuple(r)[1:] for r in df.collect()}
    return out


@pytest.mark.parametrize("large", [C.LARGE, 0, 2500])
def test_against_search(spark, large):
    data = rows(11)
    assert found(C.repair(frame(spark, data).repartition(5), large=large)) == plain(data)


def test_segments_of_a_long_conversation(spark, monkeypatch):
    """Segments end after four rows; the driver's plan has the width, the tasks don't need it."""
    monkeypatch.setattr(C, "BITS", 2)
    data = [x for c in range(6) for x in conversation(random.Random(c), 150, c)]
    df = frame(spark, data)
    assert found(C.repair(df, large=0)) == plain(data) == found(C.repair(df))


def test_damage_and_emptied_conversations(spark):
    data = rows(12)
    got = found(C.repair_all(frame(spark, data), C.damage(frame(spark, data))))
    want, nothing = plain(damaged(data)), (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == {c: want.get(c, nothing) for c in {x[0] for x in data}} and nothing in got.values()


def test_every_short_sequence_and_long_runs():
    """Unrolled letters cost what the matrices say, also where a run is long."""
    r = random.Random(13)
    for n in [1, 2, 3, 5, 8] * 30 + [3000]:
        symbols = bytes(x for _ in range(n) for x in [r.randrange(16)] * (r.choice([1, 1, 2, 700]) if n < 9 else 1))
        letters, state = C.unroll(symbols, C.START, C.END)
        price = {"D": 2, "I": 5, "R": 1, "K": 0}
        stay = [c for c in letters if c != "I"]
        cost = sum(price[c] for c in letters + C.closing(state)) + sum(5 for c, x in zip(stay, symbols) if c != "D" and x >> 2 == C.TRUNCATED)
        assert len(stay) == len(symbols) and cost == C.cost_to_go(symbols, C.END)[0][C.START] == C.apply(C.product(symbols), C.END)[C.START]


def test_nothing(spark):
    assert found(C.repair(frame(spark, []))) == {} == found(C.repair_all(frame(spark, []), frame(spark, [])))


def test_a_very_long_text(spark):
    data = [(1, 0, "user", "word " * 3_000_000 + "."), (1, 1, "assistant", "short.")]
    want = {1: (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(f"user:{data[0][3]}\nassistant:short.".encode()).hexdigest())}
    assert found(C.repair(frame(spark, data))) == want == found(C.repair(frame(spark, data), large=100))


def test_whole_table(spark):
    from fleetscope.llm import queries

    data = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_repair_conversations"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["conv_id", *C.FIELDS]
    want, nothing = plain(damaged(data)), (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == {c: want.get(c, nothing) for c in {x[0] for x in data}}
    assert dict(got.where(F.col("cost") > 0).dtypes)["cost"] == "bigint"
