"""Exact n-gram Jaccard join by groups of equal prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles.  Two
documents link when ``den * |A & B| >= num * |A | B|``.

1. Documents with equal sets collapse into one class (a 128-bit digest of the
   set), represented by the smallest doc_id.
2. Shingles are ordered rarest first.  Any order does that is the same for all
   documents, so what is known of it is kept small.  Every partition counts all
   its shingles and reports those that are frequent within a block, and those
   whose hashes are so small that they would be in a prefix by hash.  Shingles
   that one document has come first, then those that are shared, then frequent
   ones by their count, each by hash.  The first two are told apart by a filter
   of fixed size.  ``MAX_FREQUENT`` bounds the table of counts: a shingle is
   listed from a fixed share of all occurrences on, and no more shingles than
   its inverse can reach that share.
3. A pair that links must share a shingle among the first
   ``n - ceil(t * n) + 1`` of each.  Classes with the same prefix and the same
   size form one group, and only groups are indexed.
4. Group pairs pass a size and a positional filter within the join condition,
   so pairs that fail are never emitted.  A bitmap speaks for one set only: it
   filters pairs of groups of one member, and else the pairs of members after
   the expansion.  What is left is screened by a longer bitmap and verified by
   the intersection of the whole sets.

Pairs are taken in rounds.  In the first ``STARS`` rounds each group is compared
with one centre of each of its index entries, another one each time, which joins
large groups of near copies with a number of comparisons linear in the index.
What is still apart is then compared exhaustively: the entries of a shingle are
dealt to cells of two blocks, a task compares the members of a cell by size,
position and bitmap, and only pairs of different components that pass leave it.
No link between components is lost, and neither a group nor a shingle is
expanded into its pairs as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import connected_components
from .storage import Bitset, batch_rows, bitset, discarding, materialize, sized_broadcast, tidy

#: Entries of the broadcast order table, at most (16 bytes each).
MAX_FREQUENT = 1 << 20
#: Shingles that a partition counts before it reports and forgets them, and the count from which it reports.
BLOCK, REPORTED = 1 << 21, 4
#: Shingles reported of a document, in quarters of its prefix, and bits of the filter of shared ones (32 MB at most).
POOL, SHARED_BITS = 5, 28
#: Rows of an Arrow batch with texts, and with two sets.
TEXT_ROWS, SET_ROWS = 1000, 200
#: Words of the bitmap that goes with an index entry; the sketch of a set has as many bits or more.
BITMAP_WORDS = 8
#: Rounds in which index entries meet one centre each; entries of a block of the exhaustive round, for lists of up to as many.
STARS, CELL = 2, 1024
#: Rows that a task of that round compares at a time, at least, and pairs of them.
CELL_ROWS, CELL_PAIRS = 1 << 15, 1 << 18

SETS = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, prefix_a long, prefix_b long, prefix array<long>, bitmap array<long>, sketch binary"


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a batch."""
    for first, hashes, offsets in tx.slices(tx.binary_column(batch, "text"), tx.SPACED):
        for k in range(len(offsets) - 1):
            yield first + k, np.unique(tx.shingles(hashes[offsets[k] : offsets[k + 1]], width))


def _digest(values: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _report(block: list[np.ndarray], pool: list[np.ndarray], total: int) -> pa.RecordBatch:
    """What is frequent in a block or in its pool, with its count; empties both lists, so little more than the block is held.

    The pool's arrays are parts of the block's, which are freed with both.
    """
    low = np.concatenate([np.empty(0, np.uint64), *pool])
    pool.clear()
    values = np.concatenate([np.empty(0, np.uint64), *block])
    block.clear()
    values.sort()
    hit = np.zeros(len(values), dtype=bool)
    hit[np.searchsorted(values, low)] = True
    new = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    first = np.flatnonzero(new)
    counts = np.empty(len(first), dtype=np.int64)
    np.subtract(first[1:], first[:-1], out=counts[:-1])
    counts[-1:] = len(values) - first[-1:]
    keep = (counts >= REPORTED) | hit[first]
    # The row without a hash carries the number of occurrences counted.
    h = pa.concat_arrays([pa.array(values[first[keep]].view(np.int64)), pa.array([None], pa.int64())])
    return pa.RecordBatch.from_arrays([h, pa.array(np.append(counts[keep], total))], ["h", "n"])


def _order(docs: DataFrame, width: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, Bitset]:
    """What the order of shingles rests on: hashes (sorted) and counts of the frequent ones, and a filter of the shared ones."""

    def count(batches):
        block, pool, size = [], [], 0
        for batch in batches:
            for _, found in _sets(batch, width):
                block.append(found)
                pool.append(found[: _prefix_size(len(found), num, den) * POOL // 4])
                size += len(found)
                if size >= BLOCK:
                    yield _report(block, pool, size)
                    block, pool, size = [], [], 0
        yield _report(block, pool, size)

    with batch_rows(docs.sparkSession, TEXT_ROWS):
        counts = docs.select("text").mapInArrow(tidy(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1 or h is null")
        counts = materialize(counts, "frequent")
    total = counts.where("h is null").agg(F.sum("n")).first()[0] or 0
    # Sums over this number less than MAX_FREQUENT shingles, as all occurrences number `total`.
    least = max(2 * REPORTED, total // MAX_FREQUENT)
    found = counts.where(F.col("h").isNotNull() & (F.col("n") > least)).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    at = np.argsort(h)
    return h[at], n[at], bitset(counts, "h", SHARED_BITS, hashed=True)


def shingle_sets(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """One row per document with a doc_id: size and digest of its set, prefix, prefix digest and bitmap.

    A text without words gives size 0 and no prefix.
    """
    with discarding():
        order = docs.sparkSession.sparkContext.broadcast(_order(docs, width, num, den))

    def sketch(values: np.ndarray) -> np.ndarray:
        # The parity of the shingles in each bin: two sets differ by at least as many shingles as bins.
        # There are four bins or more for each shingle by which sets of this size may differ.
        bins = 64 * BITMAP_WORDS
        while bins * (den + num) < 8 * len(values) * (den - num):
            bins *= 2
        odd = np.bincount((values >> np.uint64(20) & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little")

    def make(batches):
        listed, counts, shared = order.value
        for batch in batches:
            n, rows = [], []
            for _, found in _sets(batch, width):
                k = len(found)
                n.append(k)
                if k == 0:
                    rows.append((0, 0, 0, 0, [], [0] * BITMAP_WORDS, b""))
                    continue
                rank = shared.contains(found.view(np.int64)).astype(np.int64)
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, found), len(listed) - 1)
                    rank = np.where(listed[at] == found, counts[at], rank)
                prefix = found[np.argsort(rank, kind="stable")[: _prefix_size(k, num, den)]].view(np.int64)
                full = sketch(found)
                rows.append((*_digest(found), *_digest(prefix), prefix, _folded(full, 8 * BITMAP_WORDS).view(np.int64), full.tobytes()))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), *columns], ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "prefix_a", "prefix_b", "prefix", "bitmap", "sketch"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(tidy(make), SETS)


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch with fewer bins, in bytes: bins that become one add their parities."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _screened(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sketches leave a link possible; sketches are far smaller than sets."""
    side = lambda key, n, sketch: reps.select(F.col("id").alias(key), F.col("n").alias(n), F.col("sketch").alias(sketch))
    both = pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b")

    def screen(batches):
        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column("x"), batch.column("y"), (batch.column("na").to_numpy() + batch.column("nb").to_numpy()).tolist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                unlike = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
                keep.append((num + den) * (n - unlike) >= 2 * num * n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(both.mapInArrow(tidy(screen), "a long, b long"), "screened")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of representatives whose whole sets link."""
    with discarding() as keep:
        return keep(_checked(pairs, docs, reps, width, num, den))


def _checked(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, num: int, den: int) -> DataFrame:
    pairs = _screened(pairs, reps, num, den)
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    needed = materialize(reps.join(ends, "id", "left_semi").select("id", F.col("rep").alias("doc_id"), "set_a", "set_b"), "needed")
    wanted = bitset(needed, "doc_id")
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def some(batches):
        for batch in batches:
            hit = held.value.contains(batch.column("slot").to_numpy())
            batch = batch.filter(pa.array(hit))
            sets = [found for _, found in _sets(batch, width)]
            digests = [_digest(found) for found in sets]
            columns = [pa.array([d[k] for d in digests], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "set_a", "set_b", "shingles"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), wanted.slot(F.col("doc_id").cast("long")).alias("slot"))
    sets = rows.mapInArrow(tidy(some), "doc_id long, set_a long, set_b long, shingles binary")
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        sets = materialize(sets.join(needed, ["doc_id", "set_a", "set_b"]).select("id", "shingles").dropDuplicates(["id"]), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(same > 0 and den * same >= num * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with batch_rows(docs.sparkSession, SET_ROWS):
        return materialize(both.mapInArrow(tidy(check), "a long, b long").distinct(), "verified")


def _whole_runs(batches, names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole runs of equal values in ``names``, at least CELL_ROWS at a time but for the last, and where each row's run ends."""
    held: list[pa.RecordBatch] = []
    size = 0

    def ends(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows + 1, dtype=bool)
        new[1:-1] = np.any([np.diff(table.column(c).to_numpy()) != 0 for c in names], axis=0)
        starts = np.flatnonzero(new)
        return np.repeat(starts[1:], np.diff(starts))

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CELL_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            end = ends(table)
            # The last run may go on in the next batch.
            cut = int(np.searchsorted(end, size))
            if cut:
                yield table.slice(0, cut).combine_chunks(), end[:cut]
            held, size = table.slice(cut).combine_chunks().to_batches(), size - cut
    if size:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, ends(table)


def _alike_in_cells(cells: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of members of a cell that are in different components and pass size, position and bitmap.

    cells: see ``_cells``, sorted by cell within partitions.  Rows of a cell are compared with those
    a fixed number of places later, for all cells of a chunk at once.
    """
    group = ["inside", "key", "i", "j"]

    def compare(batches):
        for table, end in _whole_runs(batches, group):
            inside, i, j, own, gid, ids, n, at, c = (table.column(x).to_numpy() for x in ("inside", "i", "j", "own", "gid", "id", "n", "at", "c"))
            bits = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITMAP_WORDS)
            live, lag, found = np.arange(len(end)), 0, []
            while len(live):
                lag += 1
                live = live[live + lag < end[live]]
                for first in range(0, len(live), CELL_PAIRS):
                    x = live[first : first + CELL_PAIRS]
                    y = x + lag
                    keep = (c[x] != c[y]) & ((i[x] == j[x]) | (own[x] != own[y])) & ((inside[x] == 1) | (gid[x] != gid[y]))
                    x, y = x[keep], y[keep]
                    less, more = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                    # What follows the common shingle, and at most all that stands before it.
                    most = np.minimum(at[x], at[y]) + 1 + np.minimum(n[x] - at[x] - 1, n[y] - at[y] - 1)
                    keep = (den * less >= num * more) & ((inside[x] == 1) | ((num + den) * most >= num * (n[x] + n[y])))
                    x, y = x[keep], y[keep]
                    unlike = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                    keep = (num + den) * (n[x] + n[y] - unlike) >= 2 * num * (n[x] + n[y])
                    if keep.any():
                        x, y = ids[x[keep]], ids[y[keep]]
                        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return cells.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(compare), "a long, b long").where("a <> b").distinct()


def _cells(entries: DataFrame) -> DataFrame:
    """``entries`` (inside, key, size, id, ...) dealt to the cells of two blocks of their key, ``i`` and ``j``; ``own`` is a row's block.

    A list of m entries has about the root of m / CELL blocks, so m entries go to as many cells each.
    """
    blocks = F.expr(f"cast(ceil(sqrt(size / {CELL})) as int)")
    dealt = entries.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "size")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (``id, component_id``) after more links; only what they join is looked at again."""
    of = lambda df, key: df.join(found.select(F.col("id").alias(key), F.col("component_id").alias("_c")), key, "left").withColumn(key, F.coalesce("_c", key)).drop("_c")
    more = connected_components(of(of(links.select("a", "b"), "a"), "b"))
    old = found.join(more.select(F.col("id").alias("component_id"), F.col("component_id").alias("_c")), "component_id", "left").select("id", F.coalesce("_c", "component_id").alias("component_id"))
    new = more.join(found.select(F.col("component_id").alias("id")), "id", "left_anti")
    return materialize(old.unionByName(new.select("id", "component_id")), "found")


def _classes(docs: DataFrame, width: int, num: int, den: int, versions: bool) -> tuple[DataFrame, DataFrame]:
    """The rows' sets, and the classes of equal sets: ``set_a, set_b, class_id, class_size, root, component_id``.

    Classes have numbers of their own, so a doc_id may stand on rows with different texts; with
    ``versions`` those are linked.
    """
    sets = shingle_sets(docs, width, num, den)
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        sets = materialize(sets, "shingles")
    with discarding() as keep:
        return sets, keep(_joined_classes(docs, sets, width, num, den, versions))


def _joined_classes(docs: DataFrame, sets: DataFrame, width: int, num: int, den: int, versions: bool) -> DataFrame:
    usable = sets.where("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"))
    whole = usable.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "set_a", "set_b", "prefix_a", "prefix_b", "prefix", "bitmap", "sketch")
    reps = whole.join(classes, ["set_a", "set_b", "rep"]).dropDuplicates(["set_a", "set_b"])
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("id"), "*"), "reps")
    groups = materialize(reps.groupBy("prefix_a", "prefix_b", "n").agg(F.min("id").alias("gid"), F.count("*").alias("members")), "groups")
    grouped = reps.select("id", "n", "prefix_a", "prefix_b").join(groups.where("members > 1"), ["prefix_a", "prefix_b", "n"]).select("id", "gid")
    shared = materialize(grouped, "shared")
    words = [f"b{k}" for k in range(BITMAP_WORDS)]

    def passes(x, y):
        """The filters of a group pair that shares the shingle at positions ``at``, and the bitmaps of their heads."""
        n, m, i, j = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.at", f"{y}.at"))
        most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
        unlike = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in words), F.lit(0))
        # |A & B| = (n + m - |A ^ B|) / 2, and |A ^ B| is at least the number of unlike bins.
        return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((num + den) * most >= num * (n + m)) & ((num + den) * (n + m - unlike) >= 2 * num * (n + m))

    heads = reps.join(groups.select(F.col("gid").alias("id")), "id", "left_semi")
    entries = heads.select(F.col("id").alias("gid"), F.explode("prefix").alias("token"))
    tokens = materialize(entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "tokens")
    live = bitset(tokens, "token", hashed=True)
    held = docs.sparkSession.sparkContext.broadcast(live)

    def postings(batches):
        # Only shingles that two groups share go on, so the index is not shuffled whole a second time.
        for batch in batches:
            hit = held.value.contains(batch.column("token").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("gid", "n", "token", "at", "bitmap")], ["gid", "n", "token", "at", "bitmap"]).filter(pa.array(hit))

    index = (
        heads.select(F.col("id").alias("gid"), "n", "bitmap", F.posexplode("prefix").alias("at", "token"))
        .mapInArrow(tidy(postings), "gid long, n long, token long, at int, bitmap array<long>")
        .join(tokens, "token", "left_semi")
        .select("token", "gid", "n", "at", *[F.col("bitmap")[k].alias(b) for k, b in enumerate(words)], F.col("gid").alias("lo"), F.col("gid").alias("hi"))
    )
    index = materialize(index, "index")

    def apart(x, y):
        """Some members of two groups are in different components."""
        return (F.col(f"{x}.lo") != F.col(f"{x}.hi")) | (F.col(f"{y}.lo") != F.col(f"{y}.hi")) | (F.col(f"{x}.lo") != F.col(f"{y}.lo"))

    found = None
    for salt in range(STARS):
        # The head of each group against the centre of its index entries; in the first round each member against the head of its group.
        # The first centre is one with the fewest rarer shingles: what many are copies of has less of its own than they have.
        mark = F.pmod(F.xxhash64(F.lit(salt), "gid"), F.lit(1 << 31)) + (F.col("at").cast("long") * (1 << 31) if salt == 0 else 0)
        marked = index.join(index.groupBy("token").agg(F.min(mark).alias("centre")), "token").withColumn("mark", mark)
        x, y = marked.alias("x"), marked.where("mark = centre").alias("y")
        star = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") != F.col("y.gid")) & apart("x", "y") & passes("x", "y"))
        star = star.select(F.least("x.gid", "y.gid").alias("a"), F.greatest("x.gid", "y.gid").alias("b")).distinct()
        if found is None:
            star = star.union(shared.where("id <> gid").select(F.col("gid").alias("a"), F.col("id").alias("b")))
        links = _verified(materialize(star, "pairs"), docs, reps, width, num, den)
        found = connected_components(links) if found is None else _joined(found, links)

        # Entries of shingles whose groups are all in one component are done with.
        component = lambda df: df.join(found, "id", "left").withColumn("c", F.coalesce("component_id", "id"))  # noqa: B023, E731
        spans = component(shared).groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
        single = index.select("gid").distinct().join(spans, "gid", "left_anti").select(F.col("gid").alias("id"))
        spans = spans.unionByName(component(single).select(F.col("id").alias("gid"), F.col("c").alias("lo"), F.col("c").alias("hi")))
        entry = index.drop("lo", "hi").join(spans, "gid")
        mixed = entry.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token")
        index = materialize(entry.join(mixed, "token", "left_semi").select(*index.columns), "entries")

    # All members of what is still apart, cell by cell.
    member = reps.select("id", F.col("id").alias("gid"), "bitmap").join(shared.select("id"), "id", "left_anti")
    member = component(member.unionByName(reps.select("id", "bitmap").join(shared, "id").select("id", "gid", "bitmap")))
    member = member.select("id", "gid", "c", F.to_binary(F.array_join(F.transform("bitmap", lambda w: F.lpad(F.hex(w), 16, "0")), ""), F.lit("hex")).alias("bitmap"))
    expanded = index.select("token", "gid", "n", "at").join(member, "gid")
    sizes = expanded.groupBy("token").agg(F.count("*").alias("size"))
    expanded = expanded.join(sizes, "token").select(F.lit(0).alias("inside"), F.col("token").alias("key"), "size", "gid", "id", "n", "at", "c", "bitmap")
    torn = component(shared).groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("gid", "size")
    within = member.join(torn, "gid").join(reps.select("id", "n"), "id")
    within = within.select(F.lit(1).alias("inside"), F.col("gid").alias("key"), "size", "gid", "id", "n", F.lit(0).alias("at"), "c", "bitmap")
    pairs = materialize(_alike_in_cells(_cells(expanded.unionByName(within)), num, den), "pairs")
    found = _joined(found, _verified(pairs, docs, reps, width, num, den))

    if versions:
        own = usable.select("doc_id", "set_a", "set_b").distinct()
        several = own.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
        texts = own.join(sized_broadcast(several), "doc_id").join(reps.select("set_a", "set_b", "id"), ["set_a", "set_b"]).select("doc_id", "id")
        first = texts.groupBy("doc_id").agg(F.min("id").alias("a"))
        found = _joined(found, texts.join(first, "doc_id").select("a", F.col("id").alias("b")))

    least = reps.select("id", "rep").join(found, "id").groupBy("component_id").agg(F.min("rep").alias("least"))
    linked = found.join(least, "component_id").select("id", F.col("component_id").alias("root"), "least")
    classes = reps.select("id", "set_a", "set_b", "rep", "class_size").join(linked, "id", "left")
    return materialize(
        classes.select("set_a", "set_b", F.col("rep").alias("class_id"), "class_size", F.coalesce("root", "id").alias("root"), F.coalesce("least", "rep").alias("component_id")),
        "classes",
    )


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Near-duplicate classes: ``doc_id, n_shingles, component_id, class_id, class_size``.

    docs: ``doc_id`` and ``text`` (other columns, whatever their names, are not read).  Documents link
    when the Jaccard similarity of their sets of ``width``-word shingles is at least ``num / den``;
    component_id is the smallest doc_id reachable by links, class_id that of the documents with an
    equal set, which class_size counts.  Returns one row per input row; an empty table gives none.

    Null and empty texts, or texts without words: n_shingles 0 and linked with nothing.  Very long
    texts are taken whole, in slices of a megabyte.  A null doc_id: counted, linked with nothing,
    component_id null.  Repeated rows are copies of each other; rows with one doc_id and different
    texts are versions of one document, linked by their id.  Sets hold 64-bit hashes of shingles, so
    two documents could be judged wrongly only where hashes of different shingles collide; ties in
    the order of shingles and of groups go by hash and number and don't affect the result.
    """
    sets, classes = _classes(docs, width, num, den, versions=True)
    rows = sets.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(linked, F.col("class_size")).otherwise(F.lit(1)).alias("class_size"),
    )


def keep_one(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents without near duplicates: one row of each component stays, that of the smallest doc_id.

    Rows without words, and those without a doc_id, link with nothing and all stay.  Rows that share
    a doc_id are judged by their texts like any others; of several rows of the smallest doc_id that
    with the smallest hash of its text stays, and of rows that are alike in both one.  Columns pass
    through; very long texts are taken whole; an empty table gives none.
    """
    sets, classes = _classes(docs, width, num, den, versions=False)
    rows = sets.where("doc_id is not null and n_shingles > 0").select("doc_id", "text_key", "set_a", "set_b").join(classes.select("set_a", "set_b", "root"), ["set_a", "set_b"])
    rows = materialize(rows.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("times")), "rows")
    several = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("k")).where("k > 1")
    gone = rows.join(several, "root").where(F.struct("doc_id", "text_key") != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    repeated = sized_broadcast(rows.where("times > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    same = lambda df: (F.col("id") == df["_id"]) & (F.col("key") == df["_key"])
    gone = sized_broadcast(gone)
    kept = whole.join(gone, same(gone), "left_anti")
    plain = [F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    once = kept.join(repeated, same(repeated), "left_semi").groupBy("id", "key").agg(F.min_by("row", F.xxhash64(*plain)).alias("row")).select("row")
    kept = kept.join(repeated, same(repeated), "left_anti").select("row").unionByName(once)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
