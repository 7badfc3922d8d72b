import hashlib
import zlib

import pytest

from firmweave.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload string")


def plain(rows):
    """The contract by hand."""
    raws = [(r[0], (r[2] or "").encode()) for r in rows]
    want = []
    for i, raw in raws:
        same = [j for j, other in raws if other == raw and j is not None]
        first = min(same, default=None) if len(raw) >= 100 else None
        revisit = len(raw) >= 100 and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(),
                     "revisit" if revisit else "response", first if revisit else None))
    return sorted(want, key=repr)


def test_round_trip(spark):
    big = "<p>ä</p>" * 40
    rows = [
        (5, "http://a/1", big), (3, "http://a/2", big), (9, None, big), (9, "u v\r\nw", big), (None, "x", big),
        (1, "http://b", None), (2, "http://b", ""), (4, "y", "short"), (6, "y", "short"),
        (7, "z", "x" * 300_000), (8, "z", "\x00\r\n\r\n "), (10, "q", "y" * 100), (11, "q", "y" * 100),
        (12, "q", "y" * 99), (13, "q", "y" * 99),
    ]
    rows = [(*r, "clash", "clash") for r in rows]
    got = sorted((tuple(r) for r in warc.through_archives(pages(spark, rows)).collect()), key=repr)
    assert got == plain(rows)


def test_empty_table(spark):
    assert warc.through_archives(pages(spark, [])).count() == 0


def test_archives_roll_and_are_many_members(spark, monkeypatch, tmp_path):
    listed = warc.write_archives(pages(spark, [(k, "u", f"{k}" * 200, "", "") for k in range(50)]), str(tmp_path))
    assert sum(r.n_records for r in listed.collect()) == 50
    raw = open(listed.first().path, "rb").read()
    assert raw.count(b"\x1f\x8b\x08") >= listed.first().n_records
    assert len(warc.read_bytes(raw)) == listed.first().n_records


def test_damage_is_found():
    payload = b"p" * 500
    good = warc.record(1, "u", payload, hashlib.sha256(payload).hexdigest(), None, False)
    assert warc.read_bytes(good + good)[1][:2] == (1, 500)
    with pytest.raises(ValueError):
        warc.read_bytes(good[:-20])
    with pytest.raises(ValueError):
        warc.read_bytes(warc.record(1, "u", payload, "0" * 64, None, False))
    plain_text = zlib.decompress(good, 31)
    for bad in (plain_text.replace(b"ppp", b"pqp", 1), plain_text[:-4], plain_text + b"x"):
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            warc.read_bytes(squeeze.compress(bad) + squeeze.flush())
