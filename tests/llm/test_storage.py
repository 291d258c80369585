"""Shards (1), GIF media (2) and archives (3): exact round trips."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from strandline.llm import arc, gif, sstable
from strandline.llm.common import fresh_path
from strandline.llm.queries import vocabulary_path


def _plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def _expected(rows):
    rows = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    start, out = 0, []
    for r, ids in zip(rows, _plain([r["text"] or "" for r in rows]), strict=True):
        ids = [*ids, 0]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_shards_give_the_librarys_ids_back(docs, corpus):
    for df in (docs, corpus):
        got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in sstable.token_shards(df, vocabulary_path()).orderBy("start").collect()]
        assert got == _expected(df.collect())


def test_shards_of_nothing(no_docs):
    assert sstable.token_shards(no_docs, vocabulary_path()).count() == 0


def test_lookup(spark, docs):
    path = fresh_path(spark, "lookup-test")
    sstable.write_shards(docs, vocabulary_path(), path)
    found = {r["doc_id"]: r["ids"] for r in sstable.lookup(spark, path, [8, 9, 777]).collect()}
    text = [r["text"] for r in docs.collect() if r["doc_id"] == 8]
    assert found[8] == [*_plain(text)[0], 0] and 777 not in found and len(found) == 2


def test_shard_blocks_and_damage():
    w = sstable.ShardWriter()
    for i in range(-3000, 3000):
        w.add(sstable.encode_key(i), sstable.pack_ids(np.arange(i % 50, dtype="<u4") + (70_000 if i % 7 == 0 else 0)), i % 50)
    data = w.finish(5) + b"\n"
    shard = sstable.Shard(data)
    assert shard.order == 5 and shard.entries == 6000 and len(shard.firsts) > 1
    assert [k for k, _ in shard.scan()] == list(range(-3000, 3000))
    assert shard.get(-2999)[0].tolist() == (np.arange(1)).tolist() and shard.get(5000) == []
    with pytest.raises(ValueError):
        sstable.Shard(data[:-1])
    with pytest.raises(ValueError):
        list(sstable.Shard(data[:3] + bytes([data[3] ^ 1]) + data[4:]).scan())


def test_gif_round_trip(docs, no_docs):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in gif.text_media(docs).collect()}
    for r in docs.collect():
        body = (r["text"] or "").encode()
        payload = body + bytes(-len(body) % 64 or (0 if body else 64))
        row = got[(r["doc_id"], hashlib.sha256(payload).hexdigest())]
        assert (row["n_bytes"], row["payload_bytes"], row["tail_crc32"]) == (len(body), len(payload), zlib.crc32(payload[-64:]))
    assert gif.text_media(docs).count() == docs.count() and gif.text_media(no_docs).count() == 0


def test_gif_frames_of_long_text(spark):
    text = "abc " * 60_000
    media = gif.store_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    frames = gif.frame_columns(media).orderBy("frame").collect()
    assert len(frames) == 4 and [f["start"] for f in frames] == [0, 10, 20, 30]
    assert sum(sum(f["histogram"]) for f in frames[:1]) == 64 * 1024


def _stream(codes_of):
    """A code stream that clears often, from literals only."""
    bits, out = "", []
    for i, b in enumerate(codes_of):
        if i % 100 == 0:
            out.append(256)
        out.append(b)
    out.append(257)
    bits = "".join(format(c, "09b")[::-1] for c in out)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def test_lzw_with_many_clear_codes_and_bad_codes():
    data = bytes(np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8))
    assert gif.lzw_decode(_stream(data), 8, len(data)) == data
    assert gif.lzw_decode(gif.lzw_encode(data * 3), 8, len(data) * 3) == data * 3
    with pytest.raises(ValueError):
        gif.lzw_decode(bytes([0xFF, 0xFF, 0xFF]), 8, 10)


def test_gif_transparency_and_disposal():
    def frame(samples, disposal, transparent, left=0):
        flags = disposal << 2 | (transparent is not None)
        return (
            b"!\xf9\x04" + struct.pack("<BHBB", flags, 5, transparent or 0, 0) + b"," + struct.pack("<HHHHB", left, 0, len(samples), 1, 0)
            + b"\x08" + gif._sub_blocks(gif.lzw_encode(bytes(samples)))
        )

    head = b"GIF89a" + struct.pack("<HHBBB", 3, 1, 0xF7, 0, 0) + gif._GREY
    data = head + frame([10, 20, 30], 1, None) + frame([99, 7], 3, 7, 1) + frame([50], 2, None) + frame([60], 1, None, 2) + b";"
    red = [f.canvas[0, :, 0].tolist() for f in gif.decode(data)[0]]
    assert red == [[10, 20, 30], [10, 99, 30], [50, 20, 30], [0, 20, 60]]


def test_arc_versions_and_bad_files():
    records = [arc.ArcRecord("http://a/b c", "1.2.3.4", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nline\n\nx"), arc.ArcRecord("http://d", "-", "2020", "text/plain", b"")]
    for version in "12":
        data = arc.write_arc(records, version)
        back = list(arc.parse_arc(data))
        assert [r.content for r in back] == [r.content for r in records] and back[0].url == "http://a/b%20c" and back[0].payload() == b"line\n\nx"
        with pytest.raises(ValueError):
            list(arc.parse_arc(data[:-5]))
    with pytest.raises(ValueError):
        list(arc.parse_arc(data[data.index(b"http://a") :]))
    assert arc.warc_date("2020") == "2020-01-01T00:00:00Z"


def test_archives(spark):
    big = "<p>" + "y" * 2000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, "http://b", big), (None, None, big), (4, "u r l", "small"), (5, None, None), (6, "x", "small"), (7, "x", ""), (3, "http://b", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = arc.page_archives(pages).collect()
    assert len(got) == len(rows) and all(r["block_ok"] for r in got)
    kinds = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(0, "revisit", 3), (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)]
    bodies = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(r["payload_digest"] == hashlib.sha1(bodies[r["page_id"]]).hexdigest() and r["payload_bytes"] == len(bodies[r["page_id"]]) for r in got)
    assert arc.page_archives(pages.limit(0)).count() == 0


def test_existing_archives_are_converted_and_damage_is_reported(spark):
    from strandline.llm.common import fresh_path

    at, out = fresh_path(spark, "arcs"), fresh_path(spark, "warcs")
    import gzip
    import os

    os.makedirs(at)
    head = b"HTTP/1.1 200 OK\r\n\r\n"
    records = [arc.ArcRecord(f"http://a/{i}", "1.2.3.4", "20200102030405", "text/html", head + b"x" * (100 + i)) for i in range(5)]
    whole = arc.write_arc(records, "2")
    for name, data in {"one.arc": arc.write_arc(records, "1"), "two.arc.gz": gzip.compress(whole), "cut.arc": whole[:-50], "odd.arc": b"nothing of the kind\n"}.items():
        with open(f"{at}/{name}", "wb") as f:
            f.write(data)
    report = {r["path"].rsplit("/", 1)[1]: (r["records"], r["error"] is None) for r in arc.convert_archives(spark, at, out).collect()}
    assert report == {"one.arc": (5, True), "two.arc.gz": (5, True), "cut.arc": (4, False), "odd.arc": (0, False)}
    got = arc.read_warc(spark, out).collect()
    assert len(got) == 14 and all(r["block_ok"] and r["record_type"] == "response" for r in got)
    assert {r["payload_bytes"] for r in got} == set(range(100, 105)) and {r["target_uri"] for r in got} == {r.url for r in records}


def test_archives_roll_by_bytes():
    made = list(arc._rolled(iter([[b"a" * 10] * 3, [b"b" * arc.ARCHIVE_BYTES], [b"c"] * 2])))
    assert [len(f) for f in made] == [1] * len(made) and len(made) == 3
    assert made[0]["value"][0] == b"\r\n\r\n".join([b"a" * 10] * 3) and made[2]["value"][0] == b"c\r\n\r\nc" and list(arc._rolled(iter([]))) == []


def test_bad_media_are_flagged(spark):
    rows = [(1, gif.encode(b"abc")), (2, b"GIF89a" + bytes(20)), (3, b"no"), (4, None), (5, gif.encode(b"abc")[:200])]
    media = spark.createDataFrame([(k, bytearray(m) if m is not None else None) for k, m in rows], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in gif.stored_digests(media).collect()}
    assert set(got) == {1, 2, 3, 5} and got[1]["error"] is None and got[1]["n_bytes"] == 3 and all(got[k]["error"] and got[k]["payload_bytes"] is None for k in (2, 3, 5))
    assert [(t["frame"], t["start"], t["delay"], sum(t["histogram"])) for t in got[1]["timeline"]] == [(0, 0, gif.DELAY, 64)]
    frames = gif.frame_columns(media).collect()
    assert sorted((r["doc_id"], r["frame"], r["error"] is None) for r in frames if r["frame"] is not None) == [(1, 0, True)] and sum(r["error"] is not None for r in frames) == 3
