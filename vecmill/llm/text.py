"""Vectorised word hashing over batches of UTF-8 texts.

Words are maximal runs of the bytes that a class table admits.  A word's hash
folds its bytes eight at a time, so the work is per word and not per byte; the
texts are taken in slices of about a megabyte, whatever the size of a batch or
of one text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SLICE_BYTES = 1 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def class_table(is_delimiter) -> bytes:
    """256 flags for ``bytes.translate``: 1 for a byte of a word."""
    return bytes(0 if is_delimiter(c) else 1 for c in range(256))


#: Words are what stands between ASCII white space.
SPACED = class_table(lambda c: c == 32 or 9 <= c <= 13)
#: Words are runs of digits, lower-case letters and bytes beyond ASCII.
ALNUM = class_table(lambda c: c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F)

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit numbers."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hash_words(raw: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of ``raw`` (lower-cased already)."""
    n = len(raw)
    flags = np.empty(n + 2, dtype=np.int8)
    flags[0] = flags[-1] = 0
    flags[1:-1] = np.frombuffer(raw.translate(words), dtype=np.int8)
    step = np.diff(flags)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return starts, hash_spans(raw, starts, ends)


def hash_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of ``raw``."""
    data = np.frombuffer(raw + b"\0" * 8, dtype=np.uint8)
    eight = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=data, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64))
    left, at, live = length, starts, np.arange(len(starts))
    while len(live):
        part = eight[at]
        cut = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        short = left < 8
        part[short] &= (np.uint64(1) << cut[short]) - np.uint64(1)
        h[live] = mix(h[live] ^ part)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def word_hash(word: str | bytes) -> int:
    """The hash that ``hash_words`` gives to one word."""
    raw = word.encode() if isinstance(word, str) else word
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])


def slices(texts: Iterable[bytes | None], words: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes, offsets of each text's words) for runs of texts.

    A text longer than a slice comes alone; it is hashed piecewise, cut where a word ends.
    """
    run: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        text = text or b""
        if len(text) > SLICE_BYTES:
            if run:
                yield first, *_hash_run(run, words)
            yield i, *_hash_long(text, words)
            run, first, size = [], i + 1, 0
            continue
        run.append(text)
        size += len(text) + 1
        if size > SLICE_BYTES:
            yield first, *_hash_run(run, words)
            run, first, size = [], i + 1, 0
    if run:
        yield first, *_hash_run(run, words)


def _hash_run(run: list[bytes], words: bytes) -> tuple[np.ndarray, np.ndarray]:
    starts, hashes = hash_words(b" ".join(run).translate(LOWER), words)
    begins = np.zeros(len(run) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in run], out=begins[1:])
    return hashes, np.searchsorted(starts, begins)


def _hash_long(text: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray]:
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + SLICE_BYTES)
        while end < len(text) and words[LOWER[text[end]]]:
            end += 1
        parts.append(hash_words(text[at:end].translate(LOWER), words)[1])
        at = end
    hashes = np.concatenate(parts)
    return hashes, np.array([0, len(hashes)])


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words; with fewer words the whole sequence is one."""
    k = min(width, len(hashes))
    if k == 0:
        return hashes
    n = len(hashes) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h = mix(h ^ hashes[i : i + n])
    return h


def binary_column(batch, name: str) -> list[bytes | None]:
    """A text column of an Arrow batch as UTF-8 bytes."""
    import pyarrow as pa

    column = batch.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
