"""Removal of repeated byte strings, found by prefix-free parsing.

Texts are parsed into phrases by rolling-hash triggers (see parsing): every window of LENGTH bytes lies in the phrase of
its trigger, and equal windows have equal triggers at equal places. Phrases whose trigger occurs once are done with. The
dictionary is the distinct phrases of the others. All windows of a phrase that occurs twice are repeated. What is left are
phrases that occur once but whose trigger also stands in other phrases: those meet by trigger, one occurrence a distinct
phrase. There two orders are built and combined: the suffix order of the parse, of what follows the trigger, and that of the
dictionary, of what precedes it, read backwards. Their common prefixes say how far each two phrases agree on either side; a
window that starts o bytes before the trigger is repeated if some other phrase agrees on o bytes before it and LENGTH - o
from it.

Copies cost one row a phrase. A trigger with more than GROUP distinct phrases is split: two phrases that agree on f bytes from
the trigger on have in common the bytes from LENGTH - l - s before it to l after it, where l is f rounded down to a multiple of s.
So each phrase goes to a group for each l, by a hash of those bytes, and a group's phrases share LENGTH - s bytes. Groups that are
still too large are split again by an eighth of s; in the end, where s is FINEST at most, windows are rows, s + 1 a phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parsing import GRAM, parse
from .util import digests, discard, frequent_join, materialize, mix64, signed, slices, table

#: Bytes of a string of the contract, and of what counts as a passage elsewhere: a passage of over 50 words is longer.
LENGTH, PASSAGE = 400, 200
#: Distinct phrases that meet in a group of a task: some 1 MB.
GROUP = 1_000
#: Each split divides a group's range of places by this, down to FINEST places.
FAN, FINEST = 8, 8

#: What is known of a phrase: its group, place and bytes before the trigger, whether it occurs once, and of a split group the least bytes in common from the trigger on and their spread.
_MEMBER = "key long, lo int, left int, size int, alone boolean, low int, spread int, length int, large boolean"
_PART = "array<struct<" + _MEMBER.replace(" ", ":").replace(",:", ",") + ">>"
_NAMES = [x.split()[0] for x in _MEMBER.split(", ")]


def phrases(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """doc_id, rid, at (the trigger's place in the text), left (bytes before it in the phrase), key, and for the i-th length n{i} (windows), one{i} and two{i} (digest).

    Triggers are those of windows of the least length. A phrase has the windows of every length whose first bytes have its
    trigger; texts that end before have fewer of the longer ones, or none.
    """
    least = min(lengths)
    names = ["doc_id", "rid", "at", "left", "key", *(f"{c}{i}" for i in range(len(lengths)) for c in ("n", "one", "two"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, data in slices(batches, "text"):
            p = parse(offsets, data, least)
            rows = pa.array(p.text)
            cols = [part.column(0).take(rows), part.column(1).take(rows), *(pa.array(x.astype(np.int32)) for x in (p.at - offsets[p.text], p.at - p.lo)), pa.array(signed(p.key))]
            for length in lengths:
                n = np.maximum(np.minimum(p.hi, offsets[p.text + 1] - length) - p.lo + 1, 0)
                one, two = digests(data, p.lo, np.where(n > 0, p.lo + n + (length - 1), p.lo))
                one = mix64(one + (p.at - p.lo).astype(np.uint64))
                cols += [pa.array(n.astype(np.int32)), pa.array(signed(one)), pa.array(signed(two))]
            yield pa.RecordBatch.from_arrays(cols, names)

    kinds = ", ".join(f"n{i} int, one{i} long, two{i} long" for i in range(len(lengths)))
    return docs.select("doc_id", "rid", "text").mapInArrow(run, f"doc_id long, rid long, at int, left int, key long, {kinds}")


def _same_row(a: str, b: str):
    return F.expr(f"{a}.doc_id <=> {b}.doc_id AND {a}.rid = {b}.rid")


def excerpts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Members (doc_id, rid and _MEMBER) with their bytes: span."""
    own = members.groupBy("doc_id", "rid").agg(F.collect_list(F.struct(*_NAMES)).alias("parts"))
    both = docs.alias("d").join(own.alias("o"), _same_row("d", "o")).select("d.doc_id", "d.rid", F.encode("d.text", "UTF-8").alias("body"), F.col("parts").cast(_PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offsets, data in slices(batches, "body"):
            parts = batch.column(3)
            counts = np.diff(parts.offsets.to_numpy())
            inner = parts.flatten()
            rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            start = (np.repeat(offsets[:-1], counts) + inner.field(1).to_numpy()).tolist()
            whole = data.tobytes()
            spans = [whole[a : a + b] for a, b in zip(start, inner.field(3).to_numpy().tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(inner.field(i) for i in range(len(_NAMES))), pa.array(spans, pa.binary())], ["doc_id", "rid", *_NAMES, "span"])

    return both.mapInArrow(run, f"doc_id long, rid long, {_MEMBER}, span binary")


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]


def finer(pieces: DataFrame) -> DataFrame:
    """Members of finer groups, without bytes: a phrase in common with another from `low` to `low + spread` bytes of the trigger on meets it in one of FAN groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("span")).to_pylist()
            rows, keys, lows, steps = [], [], [], []
            for i, (x, k, first, spread, length) in enumerate(zip(spans, *(c.tolist() for c in _columns(batch, "left", "low", "spread", "length")), strict=True)):
                step = -(-spread // FAN)
                for place in range(first, min(first + spread, length), step):
                    before, ahead = max(length - place - step, 0), max(place, GRAM)
                    if k >= before and len(x) - k >= ahead:
                        rows.append(i)
                        keys.append(xxhash.xxh3_64_intdigest(x[k - before : k + ahead], place * 65_536 + length))
                        lows.append(place)
                        steps.append(step)
            own = batch.take(pa.array(rows, pa.int32()))
            new = {"key": pa.array(signed(np.array(keys, np.uint64))), "low": pa.array(lows, pa.int32()), "spread": pa.array(steps, pa.int32())}
            names = ["doc_id", "rid", *_NAMES]
            yield pa.RecordBatch.from_arrays([new.get(c, own.column(own.schema.get_field_index(c))) for c in names], names)

    return pieces.mapInArrow(run, f"doc_id long, rid long, {_MEMBER}")


def _agree(order: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Common prefix lengths of neighbours in a sorted order."""
    n = np.array([len(strings[i]) for i in order])
    width = int(n.max())
    rows = np.zeros((len(order), width + 1), np.uint8)
    flat_, place = np.frombuffer(b"".join([strings[i] for i in order]), np.uint8), np.arange(width)
    rows[:, :-1][place < n[:, None]] = flat_
    unlike = rows[1:] != rows[:-1]
    unlike[:, width] = True
    return np.minimum(unlike.argmax(1), np.minimum(n[1:], n[:-1]))


def _reach(common: np.ndarray, k: int) -> np.ndarray:
    """Common prefix of the k-th string of an order with each other: minima of the neighbours' between them; -1 for itself."""
    out = np.empty(len(common) + 1, np.int64)
    out[k] = -1
    out[k + 1 :] = np.minimum.accumulate(common[k:]) if k < len(common) else common[:0]
    out[:k] = np.minimum.accumulate(common[:k][::-1])[::-1]
    return out


def repeated_windows(spans: list[bytes], left: list[int], alone: list[bool], length: int) -> list[list[tuple[int, int]]]:
    """For each phrase that is alone, the runs (first start, past the last start, from the phrase's start) of windows that another phrase has too."""
    after = [s[k:] for s, k in zip(spans, left, strict=True)]
    before = [s[:k][::-1] for s, k in zip(spans, left, strict=True)]
    g = len(spans)
    parse_order = np.array(sorted(range(g), key=after.__getitem__))
    dictionary_order = np.array(sorted(range(g), key=before.__getitem__))
    right, back = _agree(parse_order, after), _agree(dictionary_order, before)
    in_parse, in_dictionary = np.empty(g, np.int64), np.empty(g, np.int64)
    in_parse[parse_order] = np.arange(g)
    in_dictionary[dictionary_order] = np.arange(g)
    out: list[list[tuple[int, int]]] = []
    for m in range(g):
        runs: list[tuple[int, int]] = []
        if alone[m]:
            ahead, behind = np.empty(g, np.int64), np.empty(g, np.int64)
            ahead[parse_order] = _reach(right, int(in_parse[m]))
            behind[dictionary_order] = _reach(back, int(in_dictionary[m]))
            least = np.maximum(length - ahead, 0)  # of bytes before the trigger
            ok = (ahead >= 0) & (least <= behind) & (ahead > 0)
            if ok.any():
                change = np.bincount(least[ok], minlength=left[m] + 2) - np.bincount(behind[ok] + 1, minlength=left[m] + 2)
                yes = np.concatenate([[False], np.cumsum(change)[: left[m] + 1] > 0, [False]])
                edge = np.flatnonzero(yes[1:] != yes[:-1])
                # o bytes before the trigger is start left - o
                runs = [(left[m] - b + 1, left[m] - a + 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        out.append(runs)
    return out


_SPANS = "doc_id long, rid long, length int, start int, end int"


def _met(pieces: DataFrame) -> DataFrame:
    """Repeated spans of phrases that are alone, groups by key."""
    rows = pieces.select("key", "doc_id", "rid", "lo", "left", "alone", "span", "length").repartition("key").sortWithinPartitions("key", "doc_id", "rid", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(group: list[tuple]) -> list[tuple]:
            length = group[0][7]
            found = repeated_windows([x[6] for x in group], [x[4] for x in group], [x[5] for x in group], length)
            return [(x[1], x[2], length, x[3] + a, x[3] + b - 1 + length) for x, runs in zip(group, found, strict=True) for a, b in runs]

        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for i in range(0, batch.num_rows, 1000):
                for row in zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns), strict=True):
                    if group and group[0][0] != row[0]:
                        out += spans(group)
                        group = []
                    if not group or group[-1][:4] != row[:4]:  # rows of a table that are equal give a phrase once
                        group.append(row)
            yield _spans(out)
        if group:
            yield _spans(spans(group))

    return rows.mapInArrow(run, _SPANS)


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "rid", "length", "start", "end"])


def _counted(pieces: DataFrame) -> DataFrame:
    """The same for groups that are large however fine: their windows are rows, counted by 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, data in slices(batches, "span", 1 << 18):
            left, low, lo, spread, length = (x.astype(np.int64) for x in _columns(part, "left", "low", "lo", "spread", "length"))
            first = np.maximum(left - (length - low), 0)
            last = np.minimum(left - np.maximum(length - low - spread, 0), np.diff(offsets) - length)
            n = np.maximum(last - first + 1, 0)
            rows = np.repeat(np.arange(part.num_rows), n)
            i = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + first[rows]
            at = offsets[rows] + i
            start, take = lo[rows] + i, pa.array(rows)
            own = [part.column(part.schema.get_field_index(c)).take(take) for c in ("doc_id", "rid", "length", "alone")]
            yield pa.RecordBatch.from_arrays([*(pa.array(signed(x)) for x in digests(data, at, at + length[rows])), *own, pa.array(start.astype(np.int32)), pa.array((start + length[rows]).astype(np.int32))], ["h1", "h2", "doc_id", "rid", "length", "alone", "start", "end"])

    windows = materialize(pieces.mapInArrow(run, "h1 long, h2 long, doc_id long, rid long, length int, alone boolean, start int, end int"), "windows")
    # a phrase has the windows of several groups: the same window of one phrase counts once
    once = windows.select("h1", "h2", "doc_id", "rid", "start").distinct()
    again = materialize(once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "repeated-windows")
    found = frequent_join(windows.where("alone"), again, ["h1", "h2"], windows.count())
    return found.select("doc_id", "rid", "length", "start", "end").distinct()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, rid (with doc_id, tells rows apart up to equal rows, which fare alike) and text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"), text.alias("text"))


def repeated_spans(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), group: int = GROUP) -> DataFrame:
    """docs: doc_id, rid, text. doc_id, rid, length, start, end: a written table of spans that cover the bytes of every repeated string of each length; they may overlap."""
    found = materialize(phrases(docs, lengths), "phrases")
    total = found.count()
    shared = materialize(found.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "triggers", narrow=True)
    again = materialize(frequent_join(found, shared, ["key"], total), "shared-phrases")
    discard(found, shared)
    kinds = F.array(*(F.struct(F.lit(length).alias("length"), *(F.col(f"{c}{i}").alias(c) for c in ("n", "one", "two"))) for i, length in enumerate(lengths)))
    each = again.select("doc_id", "rid", (F.col("at") - F.col("left")).alias("lo"), "left", "key", F.inline(kinds)).where("n > 0")
    each = each.select("doc_id", "rid", "lo", "left", F.xxhash64("key", "length").alias("key"), (F.col("n") + F.col("length") - 1).alias("size"), "length", "one", "two")
    dictionary = each.groupBy("length", "one", "two").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "rid", "lo", "left", "size", "key")).alias("f"))
    dictionary = materialize(dictionary, "dictionary")
    twice = frequent_join(each, dictionary.where("c > 1").select("length", "one", "two", "c"), ["length", "one", "two"], total)
    spans = [materialize(twice.select("doc_id", "rid", "length", F.col("lo").alias("start"), (F.col("lo") + F.col("size")).alias("end")), "whole-phrases")]
    discard(again)
    members = dictionary.select("f.*", (F.col("c") == 1).alias("alone"), F.lit(0).alias("low"), F.col("length").alias("spread"), "length")
    met = materialize(excerpts(docs, _grouped(members, total, group)), "excerpts")
    used, base = [dictionary, met], None
    while True:
        spans.append(materialize(_met(met.where("NOT large")), "met-phrases"))
        large = met.where("large")
        if not large.limit(1).count():
            break
        last = large.where(F.col("spread") <= FINEST)
        if last.limit(1).count():
            spans.append(materialize(_counted(last), "counted"))
        if base is None:  # the bytes of all phrases in large groups; rows that are equal give them once
            base = materialize(large.select("doc_id", "rid", "lo", "left", "length", "span").dropDuplicates(["doc_id", "rid", "lo", "left", "length"]), "large-groups")
        members = materialize(finer(large.where(F.col("spread") > FINEST)), "finer-members")
        grouped = _grouped(members.drop("large"), total, group)
        same = F.expr("m.doc_id <=> b.doc_id AND m.rid = b.rid AND m.lo = b.lo AND m.left = b.left AND m.length = b.length")
        met = materialize(grouped.alias("m").join(base.alias("b"), same).select("m.*", "b.span"), "finer-groups")
        used += [members, met]
    result = materialize(reduce(DataFrame.unionByName, spans), "spans")
    discard(*used, *spans, *([base] if base is not None else []))
    return result


def _grouped(members: DataFrame, total: int, group: int) -> DataFrame:
    """The members of groups that can tell something, with large: whether the group has more than `group` of them."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("alone").alias("any_alone")).where("any_alone AND c > 1").select("key", "c", (F.col("c") > group).alias("large"))
    return frequent_join(members, materialize(sizes, "groups", narrow=True), ["key"], total).select("doc_id", "rid", *_NAMES)


def _collected(docs: DataFrame, spans: DataFrame, *lengths: int) -> DataFrame:
    """docs (doc_id, rid and more) with spans0, spans1, ... of the lengths."""
    own = spans.groupBy("doc_id", "rid").agg(*(F.collect_set(F.when(F.col("length") == n, F.struct("start", "end"))).alias(f"spans{i}") for i, n in enumerate(lengths)))
    both = docs.alias("d").join(own.alias("o"), _same_row("d", "o"), "left")
    return both.select("d.*", *(F.col(f"o.spans{i}").cast("array<struct<start:int,end:int>>").alias(f"spans{i}") for i in range(len(lengths))))


def _lists(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of each row's spans, ascending."""
    offsets = column.offsets.to_numpy()
    start, end = (column.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    out = []
    for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        order = np.argsort(start[x:y], kind="stable")
        out.append((start[x:y][order], end[x:y][order]))
    return out


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that touch or overlap as one."""
    if not len(a):
        return a, b
    b = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(b) - 1]])]


def _rest(body: memoryview, a: np.ndarray, b: np.ndarray) -> bytes:
    """The bytes outside merged spans."""
    return b"".join([body[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(body)], strict=True)])


def _characters(body: bytes | memoryview, a: np.ndarray, b: np.ndarray) -> str:
    """The text without the characters that lie in merged spans wholly."""
    x = np.frombuffer(body, np.uint8)
    if not len(a):
        return x.tobytes().decode()
    change = np.bincount(a, minlength=len(x) + 1) - np.bincount(b, minlength=len(x) + 1)
    stays = np.cumsum(change)[: len(x)] == 0
    head = np.flatnonzero((x & 0xC0) != 0x80)  # first bytes of characters: one byte that stays keeps all
    stays = np.repeat(np.logical_or.reduceat(stays, head), np.diff(np.append(head, len(x))))
    return x[stays].tobytes().decode()


def removed(docs: DataFrame, spans: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs: doc_id, rid, text. Adds n_bytes, n_removed, n_spans, kept_sha256 and kept (binary); spans are merged."""
    both = _collected(docs, spans, length).select("doc_id", "rid", F.encode("text", "UTF-8").alias("body"), "spans0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, (a, b) in enumerate(_lists(batch.column(3))):
                body = memoryview(batch.column(2)[i].as_buffer())
                a, b = _merged(a, b)
                left = _rest(body, a, b)
                rows.append((len(body), len(body) - len(left), len(a), hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(run, "doc_id long, rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_passages(docs: DataFrame, spans: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """`removed` without its bytes, beside passage_bytes (in repeated strings of the length `passage`) and text (without the characters in these)."""
    both = _collected(docs, spans, length, passage).select("doc_id", F.encode("text", "UTF-8").alias("body"), "spans0", "spans1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, (long, short) in enumerate(zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True)):
                body = memoryview(batch.column(1)[i].as_buffer())
                long, short = _merged(*long), _merged(*short)
                left = _rest(body, *long)
                rows.append((len(body), len(body) - len(left), len(long[0]), hashlib.sha256(left).hexdigest(), int((short[1] - short[0]).sum()), _characters(body, *short)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_bytes", "text"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_bytes long, text string")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as UTF-8 (null: empty), without strings of LENGTH bytes that repeat; text is what is left without those of PASSAGE bytes."""
    docs = keyed(table(spark, sf_dir, "documents"))
    return without_passages(docs, repeated_spans(docs, (LENGTH, PASSAGE)))


def cleaned(docs: DataFrame, spans: DataFrame, length: int = PASSAGE) -> DataFrame:
    """docs with its own columns, each text without the characters that lie in spans wholly; n_chars, if there, follows. Null texts stay null, and rows that lose all their text go."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("rid"))
    both = _collected(rows, spans, length).select("r", F.encode(F.col("r.text").cast("string"), "UTF-8").alias("body"), "spans0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            out = [None if body is None else _characters(body, *_merged(a, b)) for body, (a, b) in zip(bodies, _lists(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["r", "kept"])

    done = both.mapInArrow(run, T.StructType([T.StructField("r", both.schema["r"].dataType), T.StructField("kept", T.StringType())]))
    done = done.where("kept IS NULL OR kept <> '' OR r.text = ''")
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*((F.when(F.col("r.text").isNull(), F.col(f"r.`{c}`")).otherwise(changed[c]) if c in changed else F.col(f"r.`{c}`")).alias(c) for c in docs.columns))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that repeat: strings of PASSAGE bytes, all their occurrences, as op1's text."""
    return cleaned(docs, repeated_spans(keyed(docs), (PASSAGE,)))
