"""Byte-level BPE in numpy: encoding with a rank file, and decoding.

Texts are split by the tokenizer's pattern; each distinct piece is encoded once for a slice of texts (and kept for
later slices, within a bound). Pieces of like length form padded matrices of ids. In each round every row merges its
leftmost pair of minimum rank; ranks of pairs come from a hashed table, only the pairs beside a merge are looked up
again, and rows are compacted by the place that the merge frees. Rows without a pair leave the matrix.

Long pieces are cut where two bytes meet that no token holds side by side: no merge can cross such a place. What is still
long is a row of its own that merges all its pairs of minimum rank in a round, which comes to the same as the leftmost
each time unless a merge makes a pair of lesser rank; then the round merges the leftmost alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .util import slices, table, texts

NONE = np.int32(2**31 - 1)
#: Longer pieces are cut, and rows that stay longer merge all pairs of minimum rank in a round instead of one.
ROW_BYTES = 256
#: Encoded pieces that a worker keeps.
KEEP = 400_000
_BITS = 20


class Coder:
    _loaded: dict[tuple[str, str], Coder] = {}

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # the classes of the library's engine, whatever this engine's \s is
        pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.vocabulary[rank] = piece
        self.byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("every byte needs a rank")
        self.side_by_side = np.zeros((256, 256), bool)
        joined = np.frombuffer(b"".join(self.ranks), np.uint8)
        ends = np.cumsum([len(x) for x in self.ranks])
        within = np.setdiff1d(np.arange(len(joined) - 1), ends - 1)
        self.side_by_side[joined[within], joined[within + 1]] = True
        self._index()

    @classmethod
    def load(cls, path: str, pattern: str) -> Coder:
        if (path, pattern) not in cls._loaded:
            cls._loaded[path, pattern] = cls(path, pattern)
        return cls._loaded[path, pattern]

    def _index(self) -> None:
        """Every split of every piece into two pieces, in an open-addressed table keyed by both ids."""
        get, keys, ranks = self.ranks.get, [], []
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a = get(piece[:i])
                b = get(piece[i:]) if a is not None else None
                if b is not None:
                    keys.append((a << 32) | b)
                    ranks.append(rank)
        k, r = np.array(keys, np.uint64), np.array(ranks, np.int32)
        bits = max(_BITS, int(len(k) * 3).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, NONE, np.int32)
        at, left, self.probes = self._slot(k), np.arange(len(k)), 0
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] == 2**64 - 1
            _, first = np.unique(np.where(free, at[left], -1 - left), return_index=True)
            first = first[free[first]]
            put = left[first]
            self.keys[at[put]], self.values[at[put]] = k[put], r[put]
            left = np.delete(left, first)
            at[left] = (at[left] + 1) & ((1 << bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NONE if the two don't merge or one is padding (-1)."""
        key = (a.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | b.astype(np.uint32).astype(np.uint64)
        at = self._slot(key)
        have = self.keys[at]
        out = np.where(have == key, self.values[at], NONE)
        todo = np.flatnonzero((have != key).reshape(-1) & (have != 2**64 - 1).reshape(-1))
        flat_key, flat_at, flat_out = key.reshape(-1), at.reshape(-1), out.reshape(-1)
        while len(todo):
            flat_at[todo] = (flat_at[todo] + 1) & (len(self.keys) - 1)
            have = self.keys[flat_at[todo]]
            hit = have == flat_key[todo]
            flat_out[todo[hit]] = self.values[flat_at[todo[hit]]]
            todo = todo[~hit & (have != 2**64 - 1)]
        return out

    def _matrix(self, ids: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merges every row of ids (padded with -1; n ids each). Yields rows, their ids and lengths as they end."""
        rows = np.arange(len(ids))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ids.shape[1] > 1:
                at = ranks.argmin(1)
                every = np.arange(len(rows))
                least = ranks[every, at]
                over = least == NONE
            else:
                over = np.ones(len(rows), bool)
            if over.any():
                yield rows[over], ids[over], n[over]
                go = ~over
                rows, ids, n, ranks = rows[go], ids[go], n[go], ranks[go]
                if not len(rows):
                    return
                at, least, every = at[go], least[go], np.arange(len(rows))
            width = ids.shape[1]
            ids[every, at] = least
            keep = np.ones((len(rows), width), bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(len(rows), width - 1)
            ranks = ranks[keep[:, 1:]].reshape(len(rows), width - 2)  # the merged pair's place goes
            n = n - 1
            if width > 2:
                right = np.flatnonzero(at < width - 2)
                ranks[right, at[right]] = self.pair_ranks(ids[right, at[right]], ids[right, at[right] + 1])
                left = np.flatnonzero(at > 0)
                ranks[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], ids[left, at[left]])

    def _row(self, ids: np.ndarray) -> np.ndarray:
        """Merges one long row: all its leftmost pairs of minimum rank in each round."""
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            if len(at) > 1:  # of pairs that overlap every other one, from the left
                new = np.concatenate([[True], np.diff(at) > 1])
                at = at[(np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]) % 2 == 0]
                after = np.concatenate([[False], np.diff(at) == 2])  # the pair before has become one id
                before = np.where(after, least, ids[at - 1])[1 if at[0] == 0 else 0 :]
                behind = ids[at[at + 2 < len(ids)] + 2]
                made = np.concatenate([self.pair_ranks(before, np.full_like(before, least)), self.pair_ranks(np.full_like(behind, least), behind)])
                if len(made) and made.min() < least:
                    at = at[:1]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, ranks = ids[keep], ranks[keep[1:]]
            at = at - np.arange(len(at))
            again = np.concatenate([at[at < len(ranks)], at[at > 0] - 1])
            ranks[again] = self.pair_ranks(ids[again], ids[again + 1])
        return ids

    def _cuts(self, piece: bytes) -> list[int]:
        """The places where a piece may be cut, its ends included."""
        b = np.frombuffer(piece, np.uint8)
        return [0, *(np.flatnonzero(~self.side_by_side[b[:-1], b[1:]]) + 1).tolist(), len(piece)]

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of distinct pieces as little-endian unsigned 32-bit numbers."""
        out: dict[str, bytes] = {}
        raw: list[bytes] = []
        names: list[str | tuple[str, int]] = []
        cut: dict[str, list[bytes]] = {}
        for piece in pieces:
            x = piece.encode()
            rank = self.ranks.get(x)
            if rank is not None:  # as the library does: a piece that has a rank is one id
                out[piece] = rank.to_bytes(4, "little")
            elif len(x) > ROW_BYTES:
                cuts = self._cuts(x)
                cut[piece] = [b""] * (len(cuts) - 1)
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b - a > ROW_BYTES:
                        cut[piece][k] = self._row(self.byte[np.frombuffer(x[a:b], np.uint8)]).astype("<u4").tobytes()
                    else:
                        raw.append(x[a:b])
                        names.append((piece, k))
            else:
                raw.append(x)
                names.append(piece)
        for name, ids in zip(names, self._rows(raw), strict=True):
            if isinstance(name, tuple):
                cut[name[0]][name[1]] = ids
            else:
                out[name] = ids
        out.update((piece, b"".join(parts)) for piece, parts in cut.items())
        return out

    def _rows(self, raw: list[bytes]) -> list[bytes]:
        """The ids of byte strings, merged in matrices of rows of like length."""
        out = [b""] * len(raw)
        if not raw:
            return out
        size = np.array([len(x) for x in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        start = np.cumsum(size) - size
        bucket = np.where(size <= 32, size, 1 << np.ceil(np.log2(size)).astype(np.int64))  # exact widths, then powers of two
        for width in np.unique(bucket).tolist():
            own = np.flatnonzero(bucket == width)
            for i in range(0, len(own), max(1, (1 << 19) // width)):
                rows = own[i : i + max(1, (1 << 19) // width)]
                place = np.minimum(start[rows, None] + np.arange(width), len(data) - 1)
                ids = np.where(np.arange(width) < size[rows, None], self.byte[data[place]], np.int32(-1))
                for found, x, n in self._matrix(ids, size[rows].copy()):
                    w, buffer = 4 * x.shape[1], x.astype("<u4").tobytes()
                    for k, (r, m) in enumerate(zip(rows[found].tolist(), (4 * n).tolist(), strict=True)):
                        out[r] = buffer[k * w : k * w + m]
        return out

    def encode(self, strings: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        if len(self.pieces) > KEEP:
            self.pieces.clear()
        split, have = self.split, self.pieces
        parts = [split(s) for s in strings]
        missing = set().union(*parts).difference(have)
        if missing:
            have.update(self.encode_pieces(list(missing)))
        get = have.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text (null: empty) to doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.load(path, pattern)
        for part, _, _ in slices(batches, "text", 4 << 20):
            ids = coder.encode([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds decoded (binary) to doc_id, n_tokens and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.load(path, pattern)
        for part, _, _ in slices(batches, "ids", 4 << 20):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([coder.decode(np.frombuffer(x, "<u4")) for x in part.column(2).to_pylist()], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents (null: empty)."""
    import public_tokenizers as tokenizers
    from pyspark.sql import functions as F

    path, pattern = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    done = decode(encode(texts(table(spark, sf_dir, "documents")), path, pattern), path, pattern)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
