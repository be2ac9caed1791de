"""Token ids in wavelet-matrix shards.

A shard holds the ids of consecutive documents (ascending doc_id, each document closed by an end id) as a wavelet
matrix: a bit-plane for each bit of the ids, most significant first, each stably partitioned by the planes before it.
A directory of ones before every superblock makes rank constant-time, and access, counting and lookup of occurrences
work on the packed planes. Ids are cut into blocks of BLOCK, each a matrix of its own, so that building needs bounded
memory; the shard's header has the number of blocks, the documents and their lengths.

Shards are rows (shard, n_docs, n_tokens, file) of a table in the shared folder, so that they are written and read by
Spark wherever the folder lies.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import _PART, digests, eights, materialize, mix64, slices, small, table, texts

MAGIC = b"TWM1"
BLOCK = 1 << 18
SUPER = 512
#: Text bytes of a shard.
SHARD_BYTES = 16 << 20
END = 0

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Wavelet:
    """A wavelet matrix over n ids: planes of packed bits, ones before each superblock, zeros of each plane."""

    def __init__(self, n: int, planes: np.ndarray, ranks: np.ndarray, zeros: np.ndarray):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> Wavelet:
        n = len(ids)
        depth = max(int(ids.max()).bit_length(), 1) if n else 1
        x = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        width = -(-n // SUPER) * (SUPER // 8)
        planes, zeros = np.zeros((depth, width), np.uint8), np.zeros(depth, np.uint32)
        for k in range(depth):
            one = (x & x.dtype.type(1 << (depth - 1 - k))) != 0
            packed = np.packbits(one)
            planes[k, : len(packed)] = packed
            high = np.flatnonzero(one)  # places are far faster than masks here
            zeros[k] = n - len(high)
            x = np.concatenate([x.take(np.flatnonzero(~one)), x.take(high)])
        return cls(n, planes, cls._ranks(planes), zeros)

    @staticmethod
    def _ranks(planes: np.ndarray) -> np.ndarray:
        each = np.bitwise_count(planes.view(np.uint64)).reshape(len(planes), -1, SUPER // 64).sum(2, dtype=np.uint32) if planes.shape[1] else np.zeros((len(planes), 0), np.uint32)
        out = np.zeros((len(planes), each.shape[1] + 1), np.uint32)
        np.cumsum(each, axis=1, out=out[:, 1:])
        return out

    def dump(self) -> bytes:
        body = zstandard.ZstdCompressor(level=1).compress(self.planes.tobytes())
        return struct.pack("<IHI", self.n, len(self.planes), len(body)) + self.zeros.astype("<u4").tobytes() + self.ranks.astype("<u4").tobytes() + body

    @classmethod
    def load(cls, data: bytes, at: int = 0) -> tuple[Wavelet, int]:
        n, depth, size = struct.unpack_from("<IHI", data, at)
        at += 10
        blocks = -(-n // SUPER)
        zeros = np.frombuffer(data, "<u4", depth, at)
        at += 4 * depth
        ranks = np.frombuffer(data, "<u4", depth * (blocks + 1), at).reshape(depth, -1)
        at += 4 * depth * (blocks + 1)
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=depth * blocks * SUPER // 8), np.uint8).reshape(depth, -1)
        return cls(n, planes, ranks, zeros), at + size

    def _rank1(self, k: int, i: int) -> int:
        """Ones before place i of plane k."""
        top = i // SUPER
        whole, rest = self.planes[k, top * (SUPER // 8) : i // 8], i % 8
        count = int(self.ranks[k, top]) + int(_ONES[whole].sum())
        return count + (int(_ONES[self.planes[k, i // 8] >> (8 - rest)]) if rest else 0)

    def access(self, i: int) -> int:
        value = 0
        for k in range(len(self.planes)):
            bit = (self.planes[k, i // 8] >> (7 - i % 8)) & 1
            one = self._rank1(k, i)
            value = (value << 1) | int(bit)
            i = int(self.zeros[k]) + one if bit else i - one
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        if value >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            if (value >> (len(self.planes) - 1 - k)) & 1:
                lo, hi = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of plane k."""
        ranks = self.ranks[k].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * SUPER - ranks
        top = int(np.searchsorted(before, j, "right")) - 1
        bits = np.unpackbits(self.planes[k, top * (SUPER // 8) : (top + 1) * (SUPER // 8)])
        return top * SUPER + int(np.flatnonzero(bits == bit)[j - int(before[top])])

    def occurrences(self, value: int) -> list[int]:
        """All places of a value, ascending."""
        lo, hi = self._range(value, 0, self.n)
        out = []
        for i in range(lo, hi):
            for k in range(len(self.planes) - 1, -1, -1):
                bit = (value >> (len(self.planes) - 1 - k)) & 1
                i = self._select(k, bit, i - int(self.zeros[k]) if bit else i)
            out.append(i)
        return sorted(out)

    def ids(self) -> np.ndarray:
        """All ids: the partitions are undone plane by plane."""
        depth = len(self.planes)
        kind = np.uint16 if depth <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for k in range(depth - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n).view(bool)
            z = int(self.zeros[k])
            y = np.empty(self.n, kind)
            y[np.flatnonzero(~one)] = x[:z]
            y[np.flatnonzero(one)] = x[z:] | kind(1 << (depth - 1 - k))
            x = y
        return x


def write_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    head = struct.pack("<4sIQ", MAGIC, len(doc_ids), len(ids))
    blocks = [Wavelet.build(ids[i : i + BLOCK]).dump() for i in range(0, len(ids), BLOCK)]
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), *blocks])


class Shard:
    """A shard's file: documents, lengths and wavelet matrices."""

    def __init__(self, data: bytes):
        magic, docs, self.n = struct.unpack_from("<4sIQ", data)
        if magic != MAGIC:
            raise ValueError("no token shard")
        self.doc_ids = np.frombuffer(data, "<i8", docs, 16)
        self.lengths = np.frombuffer(data, "<u8", docs, 16 + 8 * docs).astype(np.int64)
        self.blocks, at = [], 16 + 16 * docs
        while at < len(data):
            block, at = Wavelet.load(data, at)
            self.blocks.append(block)

    def ids(self) -> np.ndarray:
        return np.concatenate([b.ids() for b in self.blocks]) if self.blocks else np.zeros(0, np.uint16)

    def access(self, i: int) -> int:
        return self.blocks[i // BLOCK].access(i % BLOCK)

    def count(self, value: int) -> int:
        return sum(b.count(value) for b in self.blocks)

    def occurrences(self, value: int) -> list[int]:
        return [k * BLOCK + i for k, b in enumerate(self.blocks) for i in b.occurrences(value)]


#: Encoded words that a worker keeps.
KEEP = 1_000_000
#: Words of so many bytes at most are their own key.
EXACT = 15


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each part (of a byte at least), never both 0: its bytes and their number up to EXACT bytes; of longer parts a 120-bit digest that no short part can have."""
    size, at = end - start, eights(data)
    one = at[start] & _PART[np.minimum(size, 8)]
    two = (at[np.minimum(start + 8, len(data))] & _PART[np.clip(size - 8, 0, 7)]) | (size.astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(size > EXACT)
    if len(long):
        one[long], low = digests(data, start[long], end[long])
        two[long] = low | np.uint64(0xFF << 56)
    return one, two


class Words:
    """Whole texts encoded by the tokenizers library, each distinct word once.

    The library splits a text before each space between two other than white characters, whatever surrounds it, and
    encodes the parts by themselves. So a text is cut before these spaces, and each distinct part goes to the library
    once; texts with other white space beside a space go there whole, and so do texts that hold an added token. Parts
    are told apart by their bytes (long ones by a digest), in an open-addressed table that is searched for all parts of a
    slice at a time.
    """

    _loaded: dict[str, Words] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # in the byte-level alphabet a character is a byte
        self.length = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)
        self._clear()

    @classmethod
    def load(cls, path: str) -> Words:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _clear(self, room: int = 0) -> None:
        slots = 1 << (2 * max(KEEP, room) - 1).bit_length()
        self.mask = slots - 1
        self.one, self.two = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)  # two is 0 in free slots
        self.start, self.count = np.zeros(slots, np.int64), np.zeros(slots, np.int32)
        self.ids, self.used, self.held = np.zeros(1 << 20, self.kind), 0, 0

    def whole(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def _slot(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (mix64((one * np.uint64(0x9E3779B97F4A7C15)) ^ two) & np.uint64(self.mask)).astype(np.int64)

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of each part, or -1."""
        at = self._slot(one, two)
        found = self.two.take(at)
        out = np.where((found == two) & (self.one.take(at) == one), at, -1)
        todo = np.flatnonzero((out < 0) & (found != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.two.take(at[todo])
            hit = (found == two[todo]) & (self.one.take(at[todo]) == one[todo])
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (found != 0)]
        return out

    def _put(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Distinct new parts with their ids one after another."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), self.kind)])
        self.ids[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(count) - count
        self.used, self.held = self.used + len(ids), self.held + len(one)
        at, left = self._slot(one, two), np.arange(len(one))
        while len(left):
            free = left[self.two.take(at[left]) == 0]
            _, first = np.unique(at[free], return_index=True)  # of those that want one slot, one gets it
            put = free[first]
            self.one[at[put]], self.two[at[put]], self.start[at[put]], self.count[at[put]] = one[put], two[put], start[put], count[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _learn(self, data: bytes, start: np.ndarray, end: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        order = np.lexsort((one, two))
        new = np.ones(len(order), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        first = order[new]
        start, end, one, two = start[first], end[first], one[first], two[first]
        led = np.frombuffer(data, np.uint8)[start] == 32
        for i in range(0, int(led.sum()), 4000):  # parts that a space leads are one text for the library; lengths tell whose ids are whose
            part = np.flatnonzero(led)[i : i + 4000]
            text = b"".join([data[a:b] for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)])
            ids = self.whole([text.decode()])[0]
            to = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(end[part] - start[part])) + 1
            self._put(one[part], two[part], ids, np.diff(to, prepend=0).astype(np.int32))
        heads = np.flatnonzero(~led)
        if len(heads):
            own = self.whole([data[a:b].decode() for a, b in zip(start[heads].tolist(), end[heads].tolist(), strict=True)])
            self._put(one[heads], two[heads], np.concatenate(own), np.array([len(x) for x in own], np.int32))

    def encode(self, strings: list[str], offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
        """The ids of each text; offsets and data are the texts' UTF-8."""
        space = data == 32
        mark = space.copy()
        mark[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(mark)
        if not len(start):
            return [np.zeros(0, self.kind)] * len(strings)
        if self.held > KEEP or self.held + len(start) > self.mask // 4 * 3:
            self._clear(len(start))
        end = np.append(start[1:], len(data))
        text = np.searchsorted(offsets, start, "right") - 1
        led = space.take(start)
        at = start.compress(led)
        pad = np.concatenate([np.full(3, 32, np.uint8), data, np.full(1, 32, np.uint8)])  # place i of data is i + 3
        near = pad.take(at + 2)
        bad = _WHITE.take(pad.take(at + 4)) | _WHITE_LAST.take(near) | ((pad.take(at + 1) == 0xC2) & (near < 0xA1)) | _WHITE_LEAD.take(pad.take(at))
        of = text.compress(led)
        bad |= (at == offsets.take(of)) | (at + 1 == offsets.take(of + 1))
        odd = np.zeros(len(strings), bool)
        odd[of.compress(bad)] = True
        whole = data.tobytes()
        for token in self.added:
            place = whole.find(token)
            while place >= 0:
                odd[np.searchsorted(offsets, place, "right") - 1] = True
                place = whole.find(token, place + 1)
        if odd.any():
            use = ~odd.take(text)
            start, end, text = start.compress(use), end.compress(use), text.compress(use)
        one, two = _keys(data, start, end)
        slot = self._find(one, two)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            self._learn(whole, start[miss], end[miss], one[miss], two[miss])
            slot[miss] = self._find(one[miss], two[miss])
        count = self.count.take(slot).astype(np.int64)
        total = np.cumsum(count)
        place = np.repeat(self.start.take(slot) - (total - count), count) + np.arange(total[-1] if len(total) else 0)
        ids = self.ids.take(place)
        to = np.concatenate([[0], total]).take(np.searchsorted(text, np.arange(len(strings) + 1)))
        out = [ids[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
        sent = np.flatnonzero(odd).tolist()
        for i, own in zip(sent, self.whole([strings[i] for i in sent]), strict=True):
            out[i] = own
        return out


def _bytes(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


# White space after a space: ASCII, or a first byte of what may be other white space. Before it: ASCII here, more bytes above.
_WHITE = _bytes(*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3)
_WHITE_LAST = _bytes(*range(9, 14), *range(28, 33))
_WHITE_LEAD = _bytes(0xE1, 0xE2, 0xE3)


def write_shards(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs: doc_id, text (null: empty). A table in the shared folder: shard, n_docs, n_tokens, file; shards ascend with doc_id.

    Repeated ids keep all their rows, in order of their text (null as empty); rows without id come first. The rows of one id
    may lie in several shards.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64), F.col("text"))
    dealt = rows.repartitionByRange(max(1, -(-size // shard_bytes)), *order[:2]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = Words.load(path)
        end = np.array([END], coder.kind)
        ids, lengths, names = [], [], []
        for part, offsets, data in slices(batches, "text", 4 << 20):
            for x in coder.encode([t or "" for t in part.column(1).to_pylist()], offsets, data):
                lengths.append(len(x) + 1)
                ids += (x, end)
            names.append(np.array([-(2**63) if d is None else d for d in part.column(0).to_pylist()], np.int64))
        if lengths:
            file = write_file(np.concatenate(names), np.array(lengths), np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([len(lengths)], pa.int64()), pa.array([int(np.sum(lengths))], pa.int64()), pa.array([file], pa.binary())], ["shard", "n_docs", "n_tokens", "file"])

    return materialize(dealt.mapInArrow(run, "shard long, n_docs long, n_tokens long, file binary"), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids before the document, in all shards), n_tokens and ids_crc32."""
    # two numbers a shard of SHARD_BYTES go through one task
    totals = materialize(shards.select("shard", "n_tokens"), "shard-sizes", narrow=True)
    before = totals.select("shard", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before"))
    placed = shards.select("shard", "file").join(small(materialize(before, "shard-starts", narrow=True)), "shard").select("before", "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Shard(file.as_py())
                ids = s.ids().astype("<u4")
                ends = np.cumsum(s.lengths)
                whole = memoryview(ids.tobytes())
                crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip((ends - s.lengths).tolist(), ends.tolist(), strict=True)]
                doc = pa.array(s.doc_ids, mask=s.doc_ids == -(2**63))
                yield pa.RecordBatch.from_arrays([doc, pa.array(ends - s.lengths + first), pa.array(s.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents (null: empty)."""
    import public_tokenizers

    return read_shards(write_shards(texts(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json")))
