"""Prefix-free parsing of texts by rolling-hash triggers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .util import Rolling, mix64

#: Bytes of a trigger window.
GRAM = 32

_GRAM = Rolling(0x9E3779B97F4A7C15)


@dataclass
class Phrases:
    """Phrases of a slice: parallel arrays, ascending."""

    text: np.ndarray  #: number of the text in the slice
    at: np.ndarray  #: place of the trigger in the slice
    lo: np.ndarray  #: first window of `length` bytes that has this trigger
    hi: np.ndarray  #: last such window
    key: np.ndarray  #: hash of the trigger


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values: from the minima of blocks of w up to and from each place."""
    n = len(x)
    if w == 1:
        return x
    blocks = -(-n // w)
    pad = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    pad = pad.reshape(blocks, w)
    fore = np.minimum.accumulate(pad, axis=1).reshape(-1)
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


def parse(offsets: np.ndarray, data: np.ndarray, length: int, gram: int = GRAM) -> Phrases:
    """The phrases of the texts in data. Texts shorter than length have none.

    The trigger of a window of length bytes is the gram of least rolling hash inside it (the last of equals), so equal
    windows have equal triggers at equal places, whatever surrounds them. A phrase is the bytes of all windows of one
    trigger; phrases overlap by length - 1 bytes, so none is a prefix of another's continuation.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return Phrases(none, none, none, none, np.zeros(0, np.uint64))
    prefix = _GRAM.prefix(data)
    start = np.arange(len(data) - gram + 1)
    grams = mix64(_GRAM.spans(prefix, start, start + gram))
    places = np.uint64(0xFFFFFFFF) - start.astype(np.uint64)
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | places
    least = np.uint64(0xFFFFFFFF) - (_sliding_min(order, length - gram + 1) & np.uint64(0xFFFFFFFF))
    at = least.astype(np.int64)
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    total = int(windows.sum())
    if not total:
        return Phrases(none, none, none, none, np.zeros(0, np.uint64))
    text = np.repeat(np.arange(len(sizes)), windows)
    first = np.cumsum(windows) - windows
    window = np.arange(total) - np.repeat(first - offsets[:-1], windows)
    a = at[window]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [total]]) - 1
    t, lo, hi = a[new], window[new], window[last]
    return Phrases(text[new], t, lo, hi, grams[t])
