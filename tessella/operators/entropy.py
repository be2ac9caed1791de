"""Symbol statistics as aggregations and windows, and entropy coding per mesh and attribute.

Coding is one ordered walk over a symbol stream, so streams are groups of an Arrow function; everything that needs no
order (histograms, normalised frequencies, cumulative sums) is relational.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Binary coder: bits of probability, base of the state.
BINARY_BITS, BINARY_BASE = 8, 4096
#: Bits of probability by bit length of the number of symbols (fixed values of the format).
PRECISION = {**dict.fromkeys(range(1, 9), 12), 9: 13, 10: 15, 11: 16, 12: 18, 13: 19, **dict.fromkeys(range(14, 19), 20)}
#: Connectivity symbols: bits and code, least significant bit first (fixed values of the format).
CLERS_CODES = {"C": (1, 0), "S": (3, 1), "L": (3, 3), "R": (3, 5), "E": (3, 7)}


def histogram(symbols: DataFrame, keys: list[str], symbol: str = "symbol") -> DataFrame:
    return symbols.groupBy(*keys, symbol).agg(F.count(F.lit(1)).alias("freq"))


def cumulative(hist: DataFrame, keys: list[str], symbol: str = "symbol", freq: str = "freq") -> DataFrame:
    """Adds cum: the sum of frequencies of lesser symbols."""
    w = Window.partitionBy(*keys).orderBy(symbol).rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("cum", F.coalesce(F.sum(freq).over(w), F.lit(0)))


def normalised(hist: DataFrame, keys: list[str], bits: int, symbol: str = "symbol") -> DataFrame:
    """Adds prob: frequencies scaled to 2**bits in all, at least 1.

    What lacks goes to the largest. What is too much is taken from the largest ones, one each; if there are not enough
    over 1, as much as they have, from the largest on.
    """
    own = Window.partitionBy(*keys)
    total = 1 << bits
    first = hist.withColumn("p", F.greatest(F.floor(F.col("freq") / F.sum("freq").over(own) * total + 0.5), F.lit(1)).cast("long"))
    down = own.orderBy(F.desc("p"), F.desc(symbol))
    ranked = first.withColumn("r", F.row_number().over(down)).withColumn("err", F.sum("p").over(own) - total).withColumn("m", F.count_if(F.col("p") > 1).over(own))
    ranked = ranked.withColumn("taken", F.coalesce(F.sum(F.col("p") - 1).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    less = F.when(F.col("err") <= F.col("m"), (F.col("r") <= F.col("err")).cast("int")).otherwise(F.least(F.col("p") - 1, F.greatest(F.col("err") - F.col("taken"), F.lit(0))))
    p = F.when(F.col("err") < 0, F.col("p") - F.when(F.col("r") == 1, F.col("err")).otherwise(0)).otherwise(F.col("p") - less)
    return ranked.select(*hist.columns, p.cast("long").alias("prob"))


def entropy_bits(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon bits of each stream, and its symbols."""
    n = F.sum("freq").over(Window.partitionBy(*keys))
    return hist.withColumn("n", n).groupBy(*keys).agg(F.max("n").alias("symbols"), F.sum(-F.col("freq") * F.log2(F.col("freq") / F.col("n"))).alias("bits"))


def zero_probability(flags: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Probability of false in 1/256, from 1 to 255; 1 where there are no flags."""
    share = F.try_divide(F.count_if(~F.col(flag)), F.count(flag))
    return flags.groupBy(*keys).agg(F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0)) * 256 + 0.5), F.lit(1)), F.lit(255)).cast("int").alias("prob_zero"))


# Byte and bit streams.


def varint(v: int) -> bytes:
    out = bytearray()
    while True:
        v, low = v >> 7, v & 127
        out.append(low | (128 if v else 0))
        if not v:
            return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        b = data[at]
        at += 1
        v |= (b & 127) << shift
        shift += 7
        if b < 128:
            return v, at


def pack_bits(fields: list[tuple[int, int]]) -> bytes:
    """(size, value) fields one after another, least significant bit first; the last byte is filled with zeros."""
    total = n = 0
    for size, value in fields:
        total |= value << n
        n += size
    return total.to_bytes(-(-n // 8), "little")


def read_bits(data: bytes, sizes: list[int], at: int = 0) -> list[int]:
    total, out = int.from_bytes(data[at:], "little"), []
    for size in sizes:
        out.append(total & ((1 << size) - 1))
        total >>= size
    return out


def _closed(state: int, base: int, out: bytearray) -> bytes:
    """The state at the end; the two top bits of the last byte say how many bytes it has."""
    state -= base
    for size in range(4):
        if state < 1 << (8 * size + 6):
            return bytes(out) + (state | (size << (8 * size + 6))).to_bytes(size + 1, "little")
    raise ValueError("a state of over 30 bits")


def _opened(data: bytes, base: int) -> tuple[int, int]:
    size = data[-1] >> 6
    tail = int.from_bytes(data[len(data) - size - 1 :], "little") & ((1 << (8 * size + 6)) - 1)
    return tail + base, len(data) - size - 1


def encode_flags(flags: list[bool], zero: int) -> bytes:
    """Binary arithmetic coding; flags are read back last to first."""
    state, out, total = BINARY_BASE, bytearray(), 1 << BINARY_BITS
    one = total - zero
    for f in flags:
        p, start = (one, 0) if f else (zero, one)
        if state >= (BINARY_BASE >> BINARY_BITS) * p << 8:
            out.append(state & 255)
            state >>= 8
        state = (state // p << BINARY_BITS) + state % p + start
    return _closed(state, BINARY_BASE, out)


def decode_flags(data: bytes, zero: int, n: int) -> list[bool]:
    """In the order in which they were given to encode_flags."""
    state, at = _opened(data, BINARY_BASE)
    total, out = 1 << BINARY_BITS, []
    one = total - zero
    for _ in range(n):
        if state < BINARY_BASE and at:
            at -= 1
            state = state << 8 | data[at]
        low = state % total
        f = low < one
        p, start = (one, 0) if f else (zero, one)
        state = (state >> BINARY_BITS) * p + low - start
        out.append(f)
    return out[::-1]


def frequencies(counts: list[int], bits: int) -> list[int]:
    """The rule of normalised() for one stream, symbols without occurrence included."""
    total, n = 1 << bits, sum(counts)
    probs = [max(int(c / n * total + 0.5), 1) if c else 0 for c in counts]
    order = sorted((i for i, p in enumerate(probs) if p), key=lambda i: (probs[i], i), reverse=True)
    err = sum(probs) - total
    if err < 0:
        probs[order[0]] -= err
    elif err <= sum(p > 1 for p in probs):
        for i in order[:err]:
            probs[i] -= 1
    else:
        for i in order:
            less = min(probs[i] - 1, err)
            probs[i], err = probs[i] - less, err - less
    return probs


def write_frequencies(probs: list[int]) -> bytes:
    """A count, then each probability with a two-bit length tag, or 3 with the number of zeros that follow."""
    out, i = bytearray(varint(len(probs))), 0
    while i < len(probs):
        p = probs[i]
        if p:
            extra = (p >= 1 << 6) + (p >= 1 << 14)
            out += ((p << 2) | extra).to_bytes(4, "little")[: extra + 1]
        else:
            run = 0
            while run < 63 and probs[i + run + 1] == 0:
                run += 1
            out.append(run << 2 | 3)
            i += run
        i += 1
    return bytes(out)


def read_frequencies(data: bytes, at: int) -> tuple[list[int], int]:
    n, at = read_varint(data, at)
    probs: list[int] = []
    while len(probs) < n:
        tag = data[at] & 3
        if tag == 3:
            probs += [0] * ((data[at] >> 2) + 1)
            at += 1
        else:
            probs.append(int.from_bytes(data[at : at + tag + 1], "little") >> 2)
            at += tag + 1
    return probs, at


def encode_symbols(symbols: list[int]) -> bytes:
    """A direct-coded stream: method, bit length, frequencies, length and bytes of the arithmetic coder."""
    length = min(max(sum(s > 0 for s in symbols).bit_length() + 1, 1), 18)
    bits = PRECISION[length]
    counts = [0] * (max(symbols, default=0) + 1)
    for s, n in Counter(symbols).items():
        counts[s] = n
    if not symbols:
        counts = [1]
    probs = frequencies(counts, bits)
    starts, total = [], 0
    for p in probs:
        starts.append(total)
        total += p
    base = 4 << bits
    state, out = base, bytearray()
    full = [(base >> bits) * p << 8 for p in probs]
    for s in reversed(symbols):
        p, most = probs[s], full[s]
        while state >= most:
            out.append(state & 255)
            state >>= 8
        state = (state // p << bits) + state % p + starts[s]
    body = _closed(state, base, out)
    return b"\x01" + bytes([length]) + write_frequencies(probs) + varint(len(body)) + body


def decode_symbols(data: bytes, n: int, at: int = 0) -> tuple[list[int], int]:
    bits = PRECISION[data[at + 1]]
    probs, at = read_frequencies(data, at + 2)
    size, at = read_varint(data, at)
    body, end = data[at : at + size], at + size
    starts, slots, total = [], [], 0
    for s, p in enumerate(probs):
        starts.append(total)
        slots += [s] * p
        total += p
    base = 4 << bits
    state, place = _opened(body, base)
    mask, out = (1 << bits) - 1, []
    for _ in range(n):
        low = state & mask
        s = slots[low]
        state = (state >> bits) * probs[s] + low - starts[s]
        while state < base and place:
            place -= 1
            state = state << 8 | body[place]
        out.append(s)
    return out, end


def encode_tagged(symbols: list[int], components: int) -> bytes:
    """A length-coded stream: bit lengths of tuples by the arithmetic coder, then the values in so many bits."""
    tuples = [symbols[i : i + components] for i in range(0, len(symbols), components)]
    lengths = [max(s.bit_length() for s in t) for t in tuples]
    head = encode_symbols(lengths)
    values = pack_bits([(n, s) for n, t in zip(lengths, tuples, strict=True) for s in t])
    return b"\x00" + head + values


def decode_tagged(data: bytes, n: int, components: int, at: int = 0) -> tuple[list[int], int]:
    lengths, at = decode_symbols(data, n // components, at + 1)
    sizes = [k for k in lengths for _ in range(components)]
    return read_bits(data, sizes, at), at + -(-sum(sizes) // 8)


def encoded_streams(symbols: DataFrame, keys: list[str], rank: str = "rank", symbol: str = "symbol") -> DataFrame:
    """keys, n, body: each stream coded in order of rank. A stream is a group of an Arrow function."""
    schema = ", ".join(f"{k} {symbols.schema[k].dataType.simpleString()}" for k in keys) + ", n long, body binary"

    def run(group: pa.Table) -> pa.Table:
        own = group.sort_by(rank)
        s = own.column(symbol).to_pylist()
        return pa.table({**{k: own.column(k)[:1] for k in keys}, "n": pa.array([len(s)], pa.int64()), "body": pa.array([encode_symbols(s)], pa.binary())})

    return symbols.select(*keys, rank, symbol).groupBy(*keys).applyInArrow(run, schema)


def decoded_streams(streams: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rank (from 0), symbol."""
    schema = ", ".join(f"{k} {streams.schema[k].dataType.simpleString()}" for k in keys) + ", rank long, symbol long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column(len(keys))[i].as_py()
                s, _ = decode_symbols(batch.column(len(keys) + 1)[i].as_py(), n)
                yield pa.RecordBatch.from_arrays([*(pa.array([batch.column(k)[i].as_py()] * n, batch.column(k).type) for k in range(len(keys))), pa.array(range(n), pa.int64()), pa.array(s, pa.int64())], [*keys, "rank", "symbol"])

    return streams.select(*keys, "n", "body").mapInArrow(run, schema)
