"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Whether the text is cut at a position is settled as soon as a fixed number of
bytes after it has been seen.  That number, the sufficient lookahead, follows
from the merge list: a merge ``(u, v)`` happens unless a part at the right end
of ``v`` is taken first by a merge of higher priority with what follows, which
again happens unless the right end of its own right part is taken first, and so
on with ever higher priority.  The longest such chain, in bytes, is the
lookahead.  A run of text is therefore encoded window by window: tokens that end
before the lookahead of the window are emitted, the rest is carried on, and the
memory does not depend on the length of the text.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import tidy

#: White space as the Unicode property has it; Python's own class also has the separators 1C to 1F.
_SPACE = r"\t-\r \x85\xA0  -     　"
#: The pattern by which the vocabulary's texts are divided before merging.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The runs that a long piece may be made of, to be continued over chunk borders.
_RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", rf"[^{_SPACE}\p{{L}}\p{{N}}]+")]
_BLANKS = regex.compile(rf"[{_SPACE}]+")

CHUNK_CHARS, CACHED = 1 << 16, 300_000


def byte_of_char() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    rest = (b for b in range(256) if chr(b) not in table)
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, bytes and special tokens of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_of_char()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in ids.items() if token not in self.special}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.byte_ids = [0] * 256
        for token, i in ids.items():
            if len(token) == 1 and token in to_byte:
                self.byte_ids[to_byte[token]] = i
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        #: (left id, right id) -> (rank, id of the product)
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.lookahead = sufficient_lookahead(self.merges, {i: len(b) for i, b in self.bytes_of.items()})

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a piece of text: the pair of lowest rank merges first, the leftmost of equals."""
        tokens = [self.byte_ids[b] for b in data]
        return self._merge_short(tokens) if len(tokens) <= 48 else self._merge_long(tokens)

    def _merge_short(self, tokens: list[int]) -> list[int]:
        merges, none = self.merges, (1 << 30, -1)
        pairs = [merges.get(p, none) for p in zip(tokens, tokens[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            tokens[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = merges.get((tokens[i - 1], tokens[i]), none)
            if i < len(pairs):
                pairs[i] = merges.get((tokens[i], tokens[i + 1]), none)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        n = len(tokens)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*m, i) for i, p in enumerate(zip(tokens, tokens[1:])) if (m := self.merges.get(p))]
        heap = [(rank, i, product) for rank, product, i in heap]
        heapq.heapify(heap)
        alive: list[int | None] = list(tokens)
        while heap:
            rank, i, product = heapq.heappop(heap)
            j = after[i] if alive[i] is not None else -1
            if j < 0 or self.merges.get((alive[i], alive[j])) != (rank, product):
                continue
            alive[i], alive[j] = product, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := self.merges.get((alive[a], alive[b]))):
                    heapq.heappush(heap, (m[0], a, m[1]))
        return [t for t in alive if t is not None]


def sufficient_lookahead(merges: dict[tuple[int, int], tuple[int, int]], length: dict[int, int]) -> int:
    """Bytes after a position that settle whether a token ends there (see the module's text)."""
    made = {product: (rank, right) for (_, right), (rank, product) in merges.items()}
    by_left: dict[int, tuple[list[int], list[int]]] = {}  # ranks of the merges with this left part, and the greatest reach so far
    most = 0
    for (left, right), (rank, _) in sorted(merges.items(), key=lambda m: m[1][0]):
        beyond, part, limit = 0, right, rank
        while True:
            ranks, reach = by_left.get(part, ([], []))
            if at := bisect.bisect_left(ranks, limit):
                beyond = max(beyond, reach[at - 1])
            if part not in made:
                break
            limit, part = made[part]
        own = length[right] + beyond
        ranks, reach = by_left.setdefault(left, ([], []))
        ranks.append(rank)
        reach.append(max(own, reach[-1] if reach else 0))
        most = max(most, own)
    return most


class Encoder:
    """Text chunks in, tokens out, each as soon as no later text can change it.

    ``feed(chunk)`` returns the tokens that became stable, ``close()`` the rest.
    """

    def __init__(self, vocabulary: Vocabulary, cache: dict | None = None):
        self.vocabulary = vocabulary
        self.window = max(4096, 4 * vocabulary.lookahead)
        self.cache = cache if cache is not None else PieceCache(vocabulary)
        self.find = regex.compile(PIECES).findall
        marks = sorted(vocabulary.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        self.longest_mark = max(map(len, marks), default=0)
        self.held = ""  # text whose division into pieces may still change
        self.run: regex.Pattern | None = None  # the kind of run that a long piece consists of
        self.rest = b""  # bytes of that run whose tokens may still change

    def feed(self, chunk: str) -> list[int]:
        return self._take(self.held + chunk, last=False)

    def close(self) -> list[int]:
        out = self._take(self.held, last=True)
        self.held = ""
        return out

    def _take(self, text: str, last: bool) -> list[int]:
        out: list[int] = []
        if self.marks is not None:
            at = 0
            for mark in self.marks.finditer(text):
                out += self._part(text[at : mark.start()], True)
                out.append(self.vocabulary.special[mark.group()])
                at = mark.end()
            text = text[at:]
        # The start of a special token may stand at the end of a chunk.
        keep = 0 if last else next((k for k in range(min(self.longest_mark - 1, len(text)), 0, -1) if any(m.startswith(text[len(text) - k :]) for m in self.vocabulary.special)), 0)
        out += self._part(text[: len(text) - keep], last)
        self.held += text[len(text) - keep :]
        return out

    def _part(self, text: str, last: bool) -> list[int]:
        """Tokens of text up to a special token or, if not ``last``, up to where it may go on."""
        self.held = ""
        out: list[int] = []
        if self.run is not None:
            more = self.run.match(text)
            end = more.end() if more else 0
            over = last or end < len(text)
            if self.run is _BLANKS and end and not (last and end == len(text)):
                # The last blank before other text is not of the run's piece.
                end -= 1
            out += self._stable(text[:end].encode(), over)
            if not over:
                self.held = text[end:]
                return out
            self.run, text = None, text[end:]
        pieces = self.find(text)
        if not last and pieces:
            # The last piece may grow; a mark before it may become part of a contraction.
            tail = pieces[-2:]
            if len(tail[-1]) > self.window and (run := self._kind(tail[-1])):
                out += self._encode(pieces[:-1])
                self.run = run
                end = len(tail[-1]) - (run is _BLANKS)
                self.held = tail[-1][end:]
                return out + self._stable(tail[-1][:end].encode(), False)
            pieces = pieces[:-2]
            self.held = "".join(tail)
        return out + self._encode(pieces)

    def _kind(self, piece: str):
        """The run of which a long piece consists."""
        if _BLANKS.match(piece[1:2]):
            return _BLANKS
        body = piece[1:] if piece[0] == " " else piece
        return next((r for r in _RUNS if body and r.match(body[:1])), None)

    def _encode(self, pieces: list[str]) -> list[int]:
        cache = self.cache
        if max(map(len, pieces), default=0) <= self.window:
            return list(chain.from_iterable(map(cache.__getitem__, pieces)))
        out: list[int] = []
        for piece in pieces:
            out += cache[piece] if len(piece) <= self.window else self._stable(piece.encode(), True)
        return out

    def _stable(self, data: bytes, last: bool) -> list[int]:
        """Tokens of a long run, window by window."""
        out: list[int] = []
        rest, size, look = self.rest + data, self.window, self.vocabulary.lookahead
        length = self.vocabulary.bytes_of
        at = 0
        while len(rest) - at > (size if not last else 0):
            window = rest[at : at + size]
            tokens = self.vocabulary.merge(window)
            if at + size >= len(rest) and last:
                out += tokens
                at = len(rest)
                break
            end = 0
            for token in tokens:
                if end + len(length[token]) > len(window) - look:
                    break
                end += len(length[token])
                out.append(token)
            at += end
        self.rest = rest[at:]
        return out


class PieceCache(dict):
    """Tokens of short pieces; it is emptied when full."""

    def __init__(self, vocabulary: Vocabulary, most: int = CACHED):
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        tokens = tuple(self.vocabulary.merge(piece.encode()))
        if len(piece) <= 64:
            self[piece] = tokens
        return tokens


class Decoder:
    """Tokens in, text out: bytes that do not yet end a character wait; invalid ones become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def close(self) -> str:
        return self.state.decode(b"", True)


def encode_stream(vocabulary: Vocabulary, text: str, cache: dict | None = None) -> Iterator[list[int]]:
    """The tokens of a text, chunk by chunk."""
    encoder = Encoder(vocabulary, cache)
    for at in range(0, len(text), CHUNK_CHARS):
        yield encoder.feed(text[at : at + CHUNK_CHARS])
    yield encoder.close()


_LOADED: dict[str, tuple[Vocabulary, PieceCache, dict[int, str]]] = {}


def _loaded(path: str) -> tuple[Vocabulary, PieceCache, dict[int, str]]:
    """One vocabulary and cache for the life of a Python worker."""
    if path not in _LOADED:
        vocabulary = Vocabulary(path)
        _LOADED[path] = vocabulary, PieceCache(vocabulary), {i: str(i) for i in vocabulary.bytes_of}
    return _LOADED[path]


def bpe_roundtrip(docs: DataFrame, vocabulary: str, with_values: bool = False) -> DataFrame:
    """Encode each text and decode its tokens again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    docs: ``doc_id`` and ``text`` (other columns, whatever their names, are not read); one row per row,
    repeated ones too, and none for an empty table.  ``with_values`` adds ``ids`` (array of int) and
    ``decoded``.  ``ids_sha256`` is of the decimal ids joined by commas.  Null and empty texts have no
    tokens; the digests are then those of the empty string.  A null doc_id stays null.  Very long
    texts are encoded chunk by chunk, runs of letters or blanks window by window.
    """
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_values
    names = [c.split()[0] for c in fields.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: len(names)]

    def run(batches):
        loaded, cache, decimal = _loaded(vocabulary)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                decoder, seen, back = Decoder(loaded), hashlib.sha256(), hashlib.sha256()
                n, ids, decoded = 0, [], []
                for some in encode_stream(loaded, text.as_py() or "", cache):
                    if some:
                        seen.update((("," if n else "") + ",".join(map(decimal.__getitem__, some))).encode())
                        n += len(some)
                        piece = decoder.feed(some)
                        back.update(piece.encode())
                        if with_values:
                            ids += some
                            decoded.append(piece)
                piece = decoder.close()
                back.update(piece.encode())
                rows.append((key, n, seen.hexdigest(), back.hexdigest(), ids, "".join([*decoded, piece]))[: len(names)])
            columns = zip(*rows, strict=True) if rows else ([] for _ in names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), fields)
