"""Small documents with every awkward case, and plain versions of what the operators compute."""

import hashlib
import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, block string, `key` string"


def words(text):
    return WORD.findall(text or "")


def documents(seed=1, n=60):
    """Rows of DOCS: prose, copies, near copies, nulls, blanks, odd white space, one very long text, clashing columns."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Straße", "été", "日本語", "it's", "end.", "x,"]
    out = []
    for d in range(n):
        kind = r.random()
        if kind < 0.6 or not out:
            text = " ".join(r.choice(vocab) for _ in range(r.randint(1, 150)))
        elif kind < 0.75:
            text = r.choice(out)[1]
        elif kind < 0.9:
            w = (r.choice(out)[1] or "").split(" ")
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        else:
            text = r.choice([None, "", " \t\n", "one", "a\x0bb\x0c c\r\nd", "line one\nline one\nline two", "   no break", "ab ab ab ab ab ab"])
        out.append((d, text, r.choice(["en", None]), r.choice(["hot"] * 5 + ["a", "b", None]), r.choice([None, 5, 900]), "clash", "clash", "clash"))
    out.append((n, " ".join(r.choice(vocab) for _ in range(30_000)), "en", "hot", None, None, None, None))
    return out


def frame(spark, rows=None, schema=DOCS):
    return spark.createDataFrame(documents() if rows is None else rows, schema)


def digest(kept):
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()


def crc(data: bytes) -> int:
    return zlib.crc32(data)
