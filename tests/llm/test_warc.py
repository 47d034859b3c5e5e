"""Round trips through archives, and salvage of archives damaged in every way."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import pytest

from mimicry.llm import warc

SCHEMA = "page_id long, url string, html string, type string, copy int"
PAGES = [
    (3, "http://a/", "same"), (1, "http://b/", "same"), (2, None, "same"), (2, None, "same"), (1, "http://a/", "same"),
    (7, "http://a/", None), (8, "http://a/", ""), (9, "http://ü/ x\r\nWARC/1.1\r\n", "é日本😀"), (None, "n", "no id"), (None, None, "no id"),
    (10, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.0\r\n"), (11, "u", "x" * 20_000_000), (12, "u", "\r\n\r\n"),
    (-5, "u", "minus"), (13, "u", "twice"), (13, "v", "other"),
] + [(100 + i, "hot", "hot copy") for i in range(50)] + [(14, "r", "row")] * 4


def plain(pages, revisit_from=0):
    """Rows (page_id, bytes, digest, type, refers_to) as the rule says."""
    def order(p):
        return (p[0] is None, p[0] or 0, p[1] is None, p[1] or "")

    out, first = [], {}
    for p in sorted(pages, key=order):
        body = (p[2] or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if len(body) < revisit_from or body not in first:
            first.setdefault(body, p[0])
            out.append((p[0], len(body), digest, "response", None))
        else:
            out.append((p[0], len(body), digest, "revisit", first[body]))
    return Counter(out)


def frame(spark, pages):
    return spark.createDataFrame([(*p, "clash", 9) for p in pages], SCHEMA).repartition(3)


@pytest.mark.parametrize("revisit_from", [0, 1, 6, 10**9])
def test_round_trip(spark, tmp_path, revisit_from):
    warc.write_archives(warc.records(frame(spark, PAGES), revisit_from=revisit_from), f"{tmp_path}/a", archive_records=7)
    rows = warc.read_archives(spark, f"{tmp_path}/a").collect()
    assert not [r.gap for r in rows if r.gap]
    ids = {r.record_id: r.page_id for r in rows}
    assert len(ids) == len(rows) == len(PAGES)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.type, ids.get(r.refers_to)) for r in rows)
    assert got == plain(PAGES, revisit_from)
    bodies = {(p[2] or "").encode() for p in PAGES}
    assert {bytes(r.payload) for r in rows if r.type == "response"} == bodies
    files = list(Path(f"{tmp_path}/a").glob("part-*"))
    assert all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in files if f.stat().st_size)
    assert {r.uri for r in rows if r.page_id == 9} == {"http://ü/%20x%0D%0AWARC/1.1%0D%0A"}


def test_empty(spark, tmp_path):
    warc.write_archives(warc.records(frame(spark, [])), f"{tmp_path}/a")
    assert warc.read_archives(spark, f"{tmp_path}/a").collect() == []


def made(n, size=60):
    rng = random.Random(n)
    out = []
    for i in range(n):
        body = rng.randbytes(rng.randrange(9, size))
        row = {"type": "response", "page_id": i, "url": f"http://{i}/", "sha1": hashlib.sha1(body).hexdigest(), "bytes": len(body), "payload": body, "copy": 0}
        out.append(warc.record_bytes(row))
    return out


def ids(found):
    """Numbers of the records by what they hold: a header field of a bare record is not checked."""
    number = {x.payload: i for n in (1, 2, 4, 12) for i, r in enumerate(made(n)) for x in warc.salvaged(r)}
    return [number[x.payload] for x in found if not x.gap]


def covered(found, data):
    """Records and gaps stand one behind the other; empty members may stand between."""
    at = 0
    for x in found:
        while data.startswith(warc._NO_RECORD, at) and at < x.offset:
            at += len(warc._NO_RECORD)
        assert x.offset == at
        at += x.length
    while data.startswith(warc._NO_RECORD, at):
        at += len(warc._NO_RECORD)
    return at == len(data)


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("seed", range(40))
def test_salvage(packed, seed):
    """After a change, a deletion, an insertion or a cut all other records come back."""
    rng = random.Random(seed)
    parts = [warc.member(r) if packed else r for r in made(12)]
    hurt = sorted(rng.sample(range(12), rng.choice([1, 1, 2, 5])))
    for i in hurt:
        part, at = parts[i], rng.randrange(len(parts[i]))
        kind = rng.choice(["change", "delete", "insert", "cut"])
        if kind == "change":
            part = part[:at] + bytes([part[at] ^ rng.randrange(1, 256)]) + part[at + 1 :]
        elif kind == "delete":
            part = part[:at] + part[at + rng.randrange(1, 9) :]
        elif kind == "insert":
            part = part[:at] + rng.randbytes(5) + part[at:]
        else:
            part = part[:at]
        parts[i] = part
    data = b"".join(parts)
    found = list(warc.salvaged(data))
    got = ids(found)
    assert set(range(12)) - set(hurt) <= set(got) and len(got) == len(set(got))
    assert covered(found, data)
    assert all(x.length > 0 for x in found)


def test_every_byte_of_a_bare_record_is_checked_or_harmless():
    """A changed byte is found out, or stands in a field that is not checked."""
    record, behind = made(1)[0], made(2)[1]
    block = record.index(b"HTTP/1.1")
    for at in range(block, len(record)):
        data = record[:at] + bytes([record[at] ^ 1]) + record[at + 1 :] + behind
        found = list(warc.salvaged(data))
        assert ids(found) == [1] and found[0].gap and found[0].length == len(record), at


def test_kinds_of_damage():
    good, other = made(2)
    head, block = good.split(b"\r\n\r\n", 1)

    def reason(data):
        return [x.gap for x in warc.salvaged(data + other)]

    assert reason(good.replace(b"WARC/1.1", b"WARC/9.1")) == ["no version line", None]
    assert reason(good.replace(b"WARC-Date", b"WARC-Dote")) == ["field warc-date is missing", None]
    assert reason(good.replace(b"WARC-Date:", b"WARC-Date")) == ["malformed field", None]
    assert reason(good.replace(b"WARC-Date: ", b"WARC-Date: \xff")) == ["header is not UTF-8", None]
    assert reason(good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: -", 1)) == ["content-length is no number", None]
    assert reason(good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9999", 1)) == ["block is cut off", None]
    assert reason(good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1", 1))[-1] is None
    assert reason(good.replace(b"200 OK", b"404 OK")) == ["block digest differs", None]
    assert reason(b"junk" + good) == ["no version line", None, None]
    without = b"\r\n".join(line for line in head.split(b"\r\n") if b"Block-Digest" not in line)
    assert reason(without + b"\r\n\r\n" + block) == [None, None]  # a digest that is not stated is not checked
    assert reason(without.replace(b"Payload-Digest: sha1:", b"Payload-Digest: sha1:A") + b"\r\n\r\n" + block) == ["payload digest differs", None]
    assert [x.gap for x in warc.salvaged(b"")] == []
    assert [x.gap for x in warc.salvaged(b"nothing here")] == ["no version line"]
    assert [x.gap for x in warc.salvaged(good[:40])] == ["header without end"]


def test_members_of_several_records_and_mixed_files():
    a, b, c, d = made(4)
    broken = b.replace(b"200 OK", b"500 OK")
    data = gzip.compress(a + broken + c) + d + gzip.compress(b"not an archive") + zlib.compress(b"", wbits=31) + warc.member(b)
    found = list(warc.salvaged(data))
    assert ids(found) == [0, 2, 3, 1]
    gaps = [x for x in found if x.gap]
    assert [(x.gap, x.inner, x.length) for x in gaps][0] == ("block digest differs", len(a), len(broken))
    assert gaps[1].gap == "no version line" and data[gaps[1].offset : gaps[1].offset + gaps[1].length] == gzip.compress(b"not an archive")


def test_damaged_files_read_by_spark(spark, tmp_path):
    warc.write_archives(warc.records(frame(spark, PAGES).coalesce(1)), f"{tmp_path}/a")
    files = sorted(Path(f"{tmp_path}/a").glob("part-*"))
    whole = {str(f): f.read_bytes() for f in files}
    (tmp_path / "b").mkdir()
    for i, data in enumerate(whole.values()):
        spoiled = bytearray(data)
        if len(spoiled) > 20:
            spoiled[15] ^= 255
        (tmp_path / "b" / f"{i}.warc.gz").write_bytes(bytes(spoiled))
    rows = warc.read_archives(spark, f"{tmp_path}/b").collect()
    hurt = sum(len(d) > 20 for d in whole.values())
    assert sum(r.gap is not None for r in rows) == hurt
    assert len(rows) - hurt == len(PAGES) - hurt
    assert sum(r.length for r in rows) <= sum(map(len, whole.values()))
