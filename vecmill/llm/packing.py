"""Bounded-space online packing of token streams into fixed windows.

Every input partition keeps at most ``OPEN`` unfinished windows.  Of a document
all whole windows are cut off first; the remaining piece goes into the open
window whose free room it leaves smallest (best fit).  If no window has room
and all are in use, the fullest is emitted and a new one is opened.  What is
still open at the end of a partition is laid end to end and cut at window
borders; the last, unfilled windows of ``MERGED`` partitions go to one task,
which does the same, so a window is padded only once for all of them.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import batch_rows, materialize, tidy

#: Open windows of a partition, and partitions whose last windows one task merges.
OPEN, MERGED = 64, 32
#: Rows of an Arrow batch of texts, of which JVM and Python worker each hold one or two.
BATCH = 200
END_OF_TEXT = 1
#: Blanks in a row from which a text goes to the streaming encoder.
BLANKS = 100_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def token_encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as the ``tokenizers`` library gives them for a byte-level BPE file.

    ``vocabulary`` is the tokenizer's JSON file.  The ids come from ``tiktoken`` over the same
    vocabulary and pattern, which tests hold equal; it needs a quarter of the time.  Its pattern
    needs a stack as long as a run of blanks, so texts with very long runs are encoded by the
    streaming encoder, which gives the same ids.
    """
    import json

    import regex
    import tiktoken
    from public_tokenizers import PATTERN

    from .bpe import _SPACE, _loaded, byte_of_char, encode_stream

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    to_byte = byte_of_char()
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    blanks = regex.compile(rf"[{_SPACE}]{{{BLANKS}}}")

    def encode(text: str) -> np.ndarray:
        if len(text) >= BLANKS and blanks.search(text):
            loaded, cache, _ = _loaded(vocabulary)
            return np.fromiter((i for some in encode_stream(loaded, text, cache) for i in some), dtype=np.uint32)
        return encoding.encode_to_numpy(text, allowed_special="all")

    return encode


class OnlinePacker:
    """The windows of one partition; a piece is (document's key, start, ids, tokens of the document)."""

    def __init__(self, window: int = 2048, open_windows: int = OPEN):
        self.window, self.open_windows = window, open_windows
        self.room: list[tuple[int, int]] = []  # (free room, number of the window), sorted
        self.content: dict[int, list] = {}
        self.opened = 0

    def _new(self) -> int:
        self.opened += 1
        return self.opened - 1

    def add(self, key, ids: np.ndarray) -> Iterator[tuple[int, list]]:
        """Place a document; yields (number, pieces) of each window that is finished."""
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            yield self._new(), [(key, start, ids[start : start + self.window], len(ids))]
        if whole < len(ids):
            yield from self._place((key, whole, ids[whole:], len(ids)))

    def _place(self, piece) -> Iterator[tuple[int, list]]:
        need = len(piece[2])
        at = bisect.bisect_left(self.room, (need, -1))
        if at < len(self.room):
            free, number = self.room.pop(at)
        else:
            if len(self.room) == self.open_windows:
                _, full = self.room.pop(0)
                yield full, self.content.pop(full)
            free, number = self.window, self._new()
            self.content[number] = []
        self.content[number].append(piece)
        if free == need:
            yield number, self.content.pop(number)
        else:
            bisect.insort(self.room, (free - need, number))

    def leftovers(self) -> list:
        """The pieces of the windows that are still open, window by window."""
        return [piece for number in sorted(self.content) for piece in self.content[number]]


def end_to_end(pieces: Iterable, window: int) -> Iterator[tuple[int, list]]:
    """Lay pieces one after another and cut them at window borders; the last window may be short."""
    number, row, used = 0, [], 0
    for key, start, ids, total in pieces:
        while len(ids):
            part = ids[: window - used]
            row.append((key, start, part, total))
            used, start, ids = used + len(part), start + len(part), ids[len(part) :]
            if used == window:
                yield number, row
                number, row, used = number + 1, [], 0
    if row:
        yield number, row


def _rows(pieces: list, sequence: int) -> list[tuple]:
    out, offset = [], 0
    for key, start, ids, total in pieces:
        out.append((key, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()), total, sequence, offset))
        offset += len(ids)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 2048, open_windows: int = OPEN, with_ids: bool = False) -> DataFrame:
    """Pack all documents into windows of ``window`` tokens; one row per piece.

    docs: ``doc_id`` and ``text`` (other columns are not read).  Columns: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset`` and, with ``with_ids``, ``ids`` (array of int).

    A document is its token ids and the end-of-text id 1, so null and empty texts give one piece
    of one token.  Documents longer than a window, very long ones too, are cut into whole windows and
    a rest; leftovers may be cut again where they are merged.  A null doc_id stays null; repeated rows
    are packed each.  Of windows with equal room the one opened first is taken.  An empty table gives
    no rows.  Windows with fewer than ``window`` tokens are to be padded.  The call packs and writes the
    pieces to the shared folder; merging the last windows is left to who reads the result.
    """
    fields = PIECES + ", ids binary"
    first = fields + ", merge_key long"

    def pack(batches):
        from pyspark import TaskContext

        encode = token_encoder(vocabulary)
        part = TaskContext.get().partitionId()
        packer = OnlinePacker(window, open_windows)
        out: list[tuple] = []

        def finish(number: int, pieces: list) -> None:
            rows = _rows(pieces, (part << 32) + number)
            out.extend((*row, p[2].astype("<u4").tobytes() if with_ids else None, row[5]) for row, p in zip(rows, pieces, strict=True))

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_OF_TEXT))
                for number, pieces in packer.add(key, ids):
                    finish(number, pieces)
                if len(out) >= 4096:
                    yield _batch(out, first)
                    out.clear()
        for _, pieces in end_to_end(packer.leftovers(), window):
            if sum(len(p[2]) for p in pieces) == window:
                finish(packer.opened, pieces)
                packer.opened += 1
            else:
                out.extend((key, start, len(ids), None, total, None, None, ids.astype("<u4").tobytes(), -1 - part // MERGED) for key, start, ids, total in pieces)
        yield _batch(out, first)

    def merge(batches):
        group, pieces = None, []
        for batch in batches:
            open_rows = pc.is_null(batch.column("sequence_id"))
            done = batch.filter(pc.invert(open_rows))
            if done.num_rows:
                yield _shown(done.to_pylist()) if with_ids else done.select(_NAMES)
            for row in batch.filter(open_rows).to_pylist():
                if row["merge_key"] != group:
                    yield flush(group, pieces)
                    group, pieces = row["merge_key"], []
                pieces.append((row["doc_id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"]))
        yield flush(group, pieces)

    def flush(group: int | None, pieces: list) -> pa.RecordBatch:
        pieces.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1], p[2].tobytes()))
        out = []
        for number, row in end_to_end(pieces, window):
            out += [(*r, p[2].tobytes()) for r, p in zip(_rows(row, (group << 32) + number), row, strict=True)]
        if with_ids:
            return _shown([dict(zip([*_NAMES, "ids"], r, strict=True)) for r in out])
        return _batch([r[:-1] for r in out], PIECES)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Written here, as the size of a batch is the session's at the time of a job, and the caller's job would have its own.
    with batch_rows(docs.sparkSession, BATCH):
        rows = materialize(texts.mapInArrow(tidy(pack), first), "pieces")
    # Finished rows are spread evenly; only a window's leftovers of each partition are brought together.
    return rows.repartition("merge_key").sortWithinPartitions("merge_key").mapInArrow(tidy(merge), PIECES + ", ids array<int>" * with_ids)


def _shown(rows: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([r[c] for r in rows], pa.int64()) for c in _NAMES]
    ids = pa.array([np.frombuffer(r["ids"], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([*columns, ids], [*_NAMES, "ids"])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.binary() if c.split()[1] == "binary" else pa.int64() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
