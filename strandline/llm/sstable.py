"""Token ids in sorted-string-table shards, written and read by Spark.

A shard is one file: blocks of entries in key order, then a Bloom filter over the keys, a sparse
index with the first key of every block, and a footer.

* key: one byte 0 for null, or 1 and the id as 8 bytes big-endian with the sign bit flipped, so that
  bytes sort as ids do.
* entry: varints (bytes shared with the key before, further key bytes, value bytes), the further key
  bytes, the value. The shared count is 0 at the start of a block.
* value: the token ids as little-endian unsigned 16-bit integers, or 32-bit where an id needs it (a
  leading byte, 2 or 4, says which).
* block: CRC-32 and sizes in the index; compressed with Zstandard where a flag in the index says so.
* footer: places of Bloom filter and index, counts, the shard's place in the order, a magic number
  that ends in a line feed. The text writer puts that line feed; so shards go through Spark's own
  commit protocol, and a lost executor leaves no half shard behind.

Reading a key: Bloom filter, binary search in the index, then one block.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import fresh_path, input_bytes, materialise, shuffle_partitions, small, totals_before, whole_text

MAGIC = b"SSTIDS1\n"
FOOTER = struct.Struct("<QQQQQQQ")  # bloom at, bloom bytes, index at, index bytes, entries, tokens, order
BLOCK_BYTES = 64 * 1024
SHARD_BYTES = 16 * 1024 * 1024
BLOOM_BITS = 10  # a key
BLOOM_HASHES = 7
END_ID = 0


def encode_key(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + 2**63) % 2**64)


def decode_key(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - 2**63


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def pack_ids(ids: np.ndarray) -> bytes:
    if len(ids) and int(ids.max()) > 0xFFFF:
        return b"\x04" + ids.astype("<u4").tobytes()
    return b"\x02" + ids.astype("<u2").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u4" if value[0] == 4 else "<u2", offset=1).astype("<u4")


class ShardWriter:
    """Takes entries in key order; ``finish`` gives the shard's bytes without the last line feed."""

    def __init__(self) -> None:
        self.body, self.index, self.keys = bytearray(), [], []
        self.block, self.first, self.last, self.tokens = bytearray(), b"", b"", 0

    def size(self) -> int:
        return len(self.body) + len(self.block)

    def add(self, key: bytes, value: bytes, tokens: int) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.tokens += tokens
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            raw = bytes(self.block)
            packed = zstandard.compress(raw, 1)
            stored, flag = (packed, 1) if len(packed) < len(raw) else (raw, 0)
            self.index.append((self.first, len(self.body), len(stored), flag, zlib.crc32(stored)))
            self.body += stored
            self.block = bytearray()

    def finish(self, order: int) -> bytes:
        self._flush()
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_bloom_places(key, bits)] = True
        packed = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQBI", *rest) for k, *rest in self.index)
        at = len(self.body)
        foot = FOOTER.pack(at, len(packed), at + len(packed), len(index), len(self.keys), self.tokens, order)
        return bytes(self.body) + packed + index + foot + MAGIC[:-1]


class Shard:
    """A shard's bytes, opened from the footer."""

    def __init__(self, data: bytes) -> None:
        if data[-len(MAGIC):] != MAGIC:
            raise ValueError("not a shard, or cut off")
        self.data = data
        foot = FOOTER.unpack_from(data, len(data) - len(MAGIC) - FOOTER.size)
        bloom_at, bloom_size, index_at, index_size, self.entries, self.tokens, self.order = foot
        self.bits = struct.unpack_from("<Q", data, bloom_at)[0]
        self.bloom = data[bloom_at + 8 : bloom_at + bloom_size]
        self.firsts, self.places, at = [], [], index_at
        while at < index_at + index_size:
            n, at = _read_varint(data, at)
            self.firsts.append(data[at : at + n])
            self.places.append(struct.unpack_from("<QQBI", data, at + n))
            at += n + struct.calcsize("<QQBI")

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, size, flag, crc = self.places[i]
        raw = self.data[at : at + size]
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {i} is damaged")
        raw = zstandard.decompress(raw) if flag else raw
        at, key = 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            more, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + more]
            yield key, raw[at + more : at + more + size]
            at += more + size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.places)):
            for key, value in self._block(i):
                yield decode_key(key), unpack_ids(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key; empty if there is none."""
        key = encode_key(doc_id)
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(key, self.bits)):
            return []
        found, i = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            found += [unpack_ids(v) for k, v in self._block(i) if k == key]
            i += 1
        return found


#: Splits plain Latin text where the tokenizer's own pattern does; letters are those of ``re``.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile("[\\n\\x20-\\x7e\xa1\xbf-ſ]*")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Whole texts to ids with the tokenizers library, which never merges across its pieces.

    Text of basic Latin letters is split into the pieces, and the ids of a piece are kept once the
    library has given them, in two tables of about ``most`` pieces; any other text, and one that holds an added token (such as ``<|endoftext|>``, which
    the library gives its own id), goes to the library as it is.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.most, self.known, self.older = most, {}, {}

    @staticmethod
    def at(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _learn(self, pieces: list[str]) -> None:
        """Fills ``known``. At ``most`` pieces it becomes ``older``, from which pieces still in use come back."""
        if len(self.known) >= self.most:
            self.known, self.older = {}, self.known
        known, older, words, others = self.known, self.older, [], []
        for p in pieces:
            if p in older:
                known[p] = older[p]
            elif p[0] == " " and p[1:].isalpha():
                words.append(p)  # these stay apart when joined, which spares calls
            else:
                others.append(p)
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            # a line feed before " word" is a piece and an id of its own, so it marks the ends
            ids = np.array(self.tokenizer.encode("\n".join([*part, ""]), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.line_feed) * 4
            raw = ids.tobytes()
            known.update(zip(part, [raw[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist())], strict=True))
        for p, e in zip(others, self.tokenizer.encode_batch(others, add_special_tokens=False), strict=True):
            known[p] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a call is one portion of texts, whose pieces are all known at once."""
        out: list[np.ndarray | None] = []
        whole, later, fresh, find, known = [], [], set(), self.known.get, self.known.__getitem__
        for i, text in enumerate(texts):
            ids = None
            if (text.isascii() or _PLAIN.fullmatch(text)) and not any(a in text for a in self.added):
                pieces = _PIECES.findall(text)
                try:
                    ids = np.frombuffer(b"".join(map(known, pieces)), "<u4")
                except KeyError:
                    got = list(map(find, pieces))
                    gaps = [j for j, g in enumerate(got) if g is None]
                    later.append((i, pieces, got, gaps))
                    fresh.update([pieces[j] for j in gaps])
            else:
                whole.append(i)
            out.append(ids)
        if fresh:
            self._learn(list(fresh))
            known = self.known
            for i, pieces, got, gaps in later:
                for j in gaps:
                    got[j] = known[pieces[j]]
                out[i] = np.frombuffer(b"".join(got), "<u4")
        if whole:
            for i, e in zip(whole, self.tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4")
        return out


def _portions(frames: Iterator[pd.DataFrame], size: int = 4_000_000) -> Iterator[list[tuple]]:
    """Rows in lists of about ``size`` characters."""
    part, chars = [], 0
    for frame in frames:
        for row in frame.itertuples(index=False, name=None):
            part.append(row)
            chars += len(row[1])
            if chars >= size:
                yield part
                part, chars = [], 0
    if part:
        yield part


def write_shards(docs: DataFrame, vocabulary: str, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text, appends ``END_ID`` and writes shards in ascending key order.

    Null texts are empty; null keys come first; rows that share a key stay next to each other in the
    order of a hash of their texts; an empty table writes no shard. Other columns are not used.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), whole_text(text).alias("t"))
    parts = max(shuffle_partitions(docs.sparkSession), -(-input_bytes(docs, text) // (4 * SHARD_BYTES)))

    def shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, writer, made = Encoder.at(vocabulary), ShardWriter(), 0
        order = TaskContext.get().partitionId() << 20
        for part in _portions(frames):
            for (k, _), ids in zip(part, encoder.encode([t for _, t in part]), strict=True):
                if writer.keys and writer.size() >= SHARD_BYTES:
                    yield pd.DataFrame({"value": [writer.finish(order + made)]})
                    writer, made = ShardWriter(), made + 1
                writer.add(encode_key(None if k is None else int(k)), pack_ids(np.append(ids, np.uint32(END_ID))), len(ids) + 1)
        if writer.keys:
            yield pd.DataFrame({"value": [writer.finish(order + made)]})

    # ranges over key and a hash of the text, so that a key that many rows share is split like any other; equal pairs are equal rows
    ordered = rows.withColumn("own", F.xxhash64("t")).repartitionByRange(parts, F.col("k").asc_nulls_first(), "own")
    ordered = ordered.sortWithinPartitions(F.col("k").asc_nulls_first(), "own").drop("own")
    # keys go as text: a batch with a null would make them floating-point numbers
    ordered = ordered.withColumn("k", F.col("k").cast("string"))
    files = ordered.mapInPandas(shards, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, in no order: its key, token count, CRC-32 of its ids, and where it stands."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                shard, at, out = Shard(content), 0, []
                for doc_id, ids in shard.scan():
                    out.append((doc_id, shard.order, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                made = pd.DataFrame(out, columns=["doc_id", "shard", "start_in_shard", "n_tokens", "ids_crc32"])
                yield made.astype({"doc_id": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(read, "doc_id long, shard long, start_in_shard long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents (a list of bounded length), found by binary search in every shard."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                shard = Shard(content)
                out = [(k, ids.tolist()) for k in doc_ids for ids in shard.get(k)]
                yield pd.DataFrame(out, columns=["doc_id", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(find, "doc_id long, ids array<long>")


def token_shards(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes shards in the shared folder, reads them back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before: those of the shards before (sums in two levels,
    so no task sees all shards) and those before it in its own shard.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "token-shards")
    write_shards(docs, vocabulary, path)
    rows = materialise(read_shards(spark, path), "token-digests")
    totals = materialise(rows.groupBy("shard").agg(F.sum("n_tokens").alias("_n")), "token-totals")
    # the places of shards are a partition's number and 20 more bits: a dense rank would do as well, but this needs no sort
    totals = totals_before(totals, "shard", "_n", "_before", block=1 << 28)
    rows = rows.join(small(totals.select("shard", "_before"), 24), "shard")
    return rows.select("doc_id", (F.col("_before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32", "shard")
