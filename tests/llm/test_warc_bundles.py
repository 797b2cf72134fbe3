"""Records against the pages, and the bundle format by an ordinary Zstandard reader."""

import hashlib
import io

import pytest
import zstandard

from fleetscope.llm import warc_bundles as W

BIG = "<p>" + "x" * 200 + "</p>"
PAGES = [(5, "http://a/", BIG), (3, "http://b/ c\r\nd", BIG), (9, None, BIG), (9, None, BIG), (3, "again", BIG), (1, "u", "short"), (2, "u", "short"), (4, "ü", None), (6, "", ""),
         (7, "é", "ü" * 50), (8, "e", "ü" * 50), (10, "f", "ü" * 49), (11, "g", "ü" * 49), (None, "n", BIG), (12, "crlf", "\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" + "y" * 90), (13, "long", "z" * 3_000_000)]
SCHEMA = "page_id long, url string, html string, _body string, payload string"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    df = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], SCHEMA)
    return W.write(df, str(tmp_path_factory.mktemp("w") / "warc"))


def test_records(made):
    want, first = [], {}
    for k, _, html in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        if len((html or "").encode()) >= 100:
            first.setdefault(html, k)
    for k, _, html in PAGES:
        body = (html or "").encode()
        refers = first.get(html) if k is not None and first.get(html, k) != k else None
        want.append((k, len(body), hashlib.sha256(body).hexdigest(), "revisit" if refers is not None else "response", refers, None if refers is not None else body))
    got = [(r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]) or (None if r["payload"] is None else b"")) for r in W.read(made).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_any_reader_and_seeks(made):
    names = {r["bundle"] for r in made.index.collect()}
    whole = {n: zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(f"{made.folder}/{n}", "rb").read()), read_across_frames=True).read() for n in names}
    for r in made.index.collect():
        b = W.Bundle(made.folder, r["bundle"])
        before = sum(d for _, _, d in b.frames[:r["frame"]])
        part = whole[r["bundle"]][before + r["offset"]:before + r["offset"] + r["length"]]
        assert part.startswith(b"WARC/1.1\r\n") and part.endswith(b"\r\n\r\n")
        assert W.parse(part) == W.fetch(made, r["bundle"], r["frame"], r["offset"], r["length"])
        fields, _ = W.parse(part)
        assert (fields["X-Record-Key"] or None) == (None if r["key"] is None else str(r["key"]))
    assert sum(len(v) for v in whole.values()) == sum(r["length"] for r in made.index.collect())


def test_frames_and_bundles_end(tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FRAME_BYTES", 100)
    monkeypatch.setattr(W, "BUNDLE_BYTES", 60)
    w = W._Writer(str(tmp_path), 0)
    where = [w.add(bytes([i]) * 60) for i in range(9)]
    w.close()
    assert len({x[0] for x in where}) > 1 and {x[2] for x in where} == {0, 60}
    for i, (name, frame, at, n) in enumerate(where):
        assert W.Bundle(str(tmp_path), name).frame(frame)[at:at + n] == bytes([i]) * 60


def test_empty(spark, tmp_path):
    made = W.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert W.read(made).count() == 0
