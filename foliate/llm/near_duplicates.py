"""Near-duplicate texts: an exact similarity join in a metric space of word pairs.

A text is the multiset of its adjacent word pairs (k-th occurrences count as elements of their own, so sets suffice),
and two texts lie d = 1 - |A & B| / max(|A|, |B|) apart, which is a Jaccard-type metric. All pairs with d <= radius
are found:

* First division, by elements. Unrelated texts lie almost equally far from every whole text, so that windows around
  whole texts exclude nothing there (README has figures). A text therefore goes to the regions of its rarest elements,
  as many as it may lose within the radius and one more: every pair within the radius meets at its rarest common element.
* Further divisions, of regions above ``region_texts``, by documents, where a sample of the region shows that it pays.
  ``PIVOTS`` texts of the region are its pivots; each
  text belongs to the Voronoi cell of its nearest one. If A belongs to cell j and B to cell i, the triangle inequality
  gives d(B, j) <= d(B, i) + 2 * radius for every pair within the radius, so a text is replicated into just the cells
  within that window, and pairs of two replicas are not looked at. Cells above ``region_texts`` are divided again with
  pivots of their own, as long as that at least halves the pairs to be compared.
* What cannot be divided so is cut into blocks, and each pair of blocks is a region: no task holds more than two blocks.
* Within a region, sizes (distances to the empty set) and positions bound the overlap, and parity sketches bound the
  symmetric difference from below: popcount(sketch A ^ sketch B) <= |A - B| + |B - A|. All are exact bounds. A sketch
  that is short for its text bounds nothing, so that long texts would all go to the verification: they have sketches as
  long as they need, which are sent to all tasks once rather than with every posting.
* What is left is verified by the elements.

Rarity comes from a table of hashed counts over all texts, sized to the collection within fixed bounds. It orders the
elements and says which regions may be large; their true sizes are counted. Any order gives exact results. Equal texts
are joined once, as one representative.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize, small_enough, written

LIKENESS = 0.65
LEAST_WORDS = 8
#: Bounds of the number of counters of the rarity table, of 4 bytes each in the broadcast: one for each four elements.
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 22
#: A region of more texts is divided.
REGION_TEXTS = 1000
#: Documents that divide a region, texts that tell beforehand whether they do, and rows of a region that one task measures.
PIVOTS = 16
SAMPLE = 32
MEASURED_ROWS = 20_000
#: A block of a region that is not divided has so many times ``region_texts``.
BLOCK_REGIONS = 20
SKETCH_WORDS = 6
#: Longer texts have sketches of more words, doubled as often as their size needs; those are sent up to so many bytes.
SKETCH_ELEMENTS = 160
SENT_BYTES = 256 << 20
#: Text numbers are broadcast up to so many rows.
BROADCAST_ROWS = 1_000_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_29, _32 = np.uint64(29), np.uint64(32)


@lru_cache(maxsize=400_000)
def _word(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _32)) * _B
    return x ^ (x >> _29)


def elements(words: str) -> np.ndarray:
    """Sorted 64-bit elements of a text of space-separated words, one for each adjacent pair and occurrence."""
    h = np.fromiter(map(_word, words.split(" ")), dtype=np.uint64)
    pairs = np.sort(_mix(h[:-1] * _A + _mix(h[1:])))
    if len(pairs) < 2:
        return pairs
    start = np.concatenate(([True], pairs[1:] != pairs[:-1]))
    if start.all():
        return pairs
    at = np.arange(len(pairs))
    turn = at - np.maximum.accumulate(np.where(start, at, 0))
    return np.sort(np.where(turn > 0, _mix(pairs + turn.astype(np.uint64) * _C), pairs))


def least_common(size: np.ndarray | int, likeness: float) -> np.ndarray | int:
    """Elements that texts of this size (the larger one's) must share."""
    return np.ceil(np.asarray(size) * likeness - 1e-9).astype(np.int64)


def sketch(items: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    bits = np.bincount((items >> _32).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


class LongSketches:
    """Sketches of ``SKETCH_WORDS`` << doublings words by text number, for texts above ``SKETCH_ELEMENTS``."""

    def __init__(self, tid: np.ndarray, doublings: np.ndarray, sketches: list[bytes]) -> None:
        order = np.argsort(tid, kind="stable")
        self.tid, self.doublings, self.row, self.rows = tid[order], doublings[order], np.zeros(len(tid), dtype=np.int64), {}
        for k in np.unique(self.doublings):
            at = np.flatnonzero(self.doublings == k)
            self.row[at] = np.arange(len(at))
            self.rows[int(k)] = np.frombuffer(b"".join(sketches[order[i]] for i in at), dtype="<u8").reshape(len(at), -1)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lower bounds of the symmetric difference of texts by number; 0 where a text has no sketch here."""
        out = np.zeros(len(a), dtype=np.int64)
        if not len(self.tid):
            return out
        x, y = (np.minimum(np.searchsorted(self.tid, t), len(self.tid) - 1) for t in (a, b))
        known = np.flatnonzero((self.tid[x] == a) & (self.tid[y] == b))
        x, y = x[known], y[known]
        swap = self.doublings[x] > self.doublings[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        both = self.doublings[x] * 64 + self.doublings[y]
        for code in np.unique(both):
            j, k = divmod(int(code), 64)
            of = np.flatnonzero(both == code)
            step = max(1, (16 << 20) // (8 * SKETCH_WORDS << k))
            for start in range(0, len(of), step):
                part = of[start : start + step]
                few, many = self.rows[j][self.row[x[part]]], self.rows[k][self.row[y[part]]]
                # The longer sketch folds to the shorter one, as its number of bits is a multiple.
                many = np.bitwise_xor.reduce(many.reshape(len(part), -1, few.shape[1]), axis=1)
                out[known[part]] = np.bitwise_count(few ^ many).sum(axis=1)
        return out


def _long_sketches(texts: DataFrame, size: Column) -> LongSketches:
    """``size`` counts the elements of a text. The shorter ones of the long texts come first if not all can be sent; the
    others go on unbounded by sketches."""
    rows = texts.select("tid", "words", F.ceil(F.log2(size / SKETCH_ELEMENTS)).cast("int").alias("doublings")).where("doublings > 0")
    top, used = 0, 0
    for k, n in sorted(tuple(r) for r in rows.groupBy("doublings").count().collect()):
        used += n * ((8 * SKETCH_WORDS << k) + 20)
        if used > SENT_BYTES:
            break
        top = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(elements(words), SKETCH_WORDS << k).tobytes() for words, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], names=["tid", "doublings", "sketch"])

    if not top:
        return LongSketches(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), [])
    table = rows.where(F.col("doublings") <= top).mapInArrow(run, "tid bigint, doublings int, sketch binary").toArrow()
    return LongSketches(table.column("tid").to_numpy(), table.column("doublings").to_numpy(), table.column("sketch").to_pylist())


def _prefix(items: np.ndarray, counts: np.ndarray, likeness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest elements of a text, their positions (elements known to differ when a pair meets there first), and
    how often their counters say that they occur, which is never too low."""
    spare = len(items) - int(least_common(len(items), likeness))
    often = counts[(items % np.uint64(len(counts))).astype(np.int64)]
    order = np.lexsort((items, often))[: spare + 1]
    times = often[order]
    # An element counted once lies in no other text, so its region holds no pair.
    met = np.flatnonzero(times > 1)
    return items[order][met], met, times[met]


def _count(slots: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, dtype=np.int64)
        for batch in batches:
            for words in batch.column(0).to_pylist():
                np.add.at(counts, (elements(words) % np.uint64(slots)).astype(np.int64), 1)
        used = np.flatnonzero(counts)
        for start in range(0, len(used), 50_000):
            part = used[start : start + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["slot", "n"])

    return run


#: ``left``: elements from the position on. ``mark``: REPLICA, and the side of a text in a pair of blocks (FIRST or SECOND).
BODY = np.dtype([("tid", "<i8"), ("size", "<i4"), ("left", "<i4"), ("sketch", "<u8", (SKETCH_WORDS,)), ("mark", "<i4")])
REPLICA, FIRST, SECOND = 1, 2, 4


def _packed(regions: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * BODY.itemsize)
    bodies = pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(regions), bodies], names=["region", "body"])


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=BODY)


def _comparable(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Not two replicas, nor two texts of one side of a pair of blocks."""
    return (a & b & (REPLICA | FIRST | SECOND)) == 0


def _join_region(part: np.ndarray, likeness: float, long: LongSketches) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one region, i < j, that no bound rules out."""
    out_i, out_j = [], []
    order = np.argsort(part["size"], kind="stable")
    tid, size, left, sketches, mark = (part[name][order] for name in ("tid", "size", "left", "sketch", "mark"))
    marked = mark.any()
    n = len(size)
    # Only texts up to size / likeness can be a partner of a smaller one.
    reach = np.searchsorted(size, np.floor(size / likeness + 1e-9), side="right")
    for start in range(0, n, 256):
        rows = np.arange(start, min(start + 256, n))
        width = int(reach[rows].max())
        for begin in range(start, width, 4096):
            cols = np.arange(begin, min(begin + 4096, width))
            need = np.ceil(size[cols] * likeness - 1e-9)
            fits = (cols[None, :] > rows[:, None]) & (cols[None, :] < reach[rows][:, None]) & (left[rows][:, None] >= need[None, :]) & (left[cols] >= need)[None, :]
            if marked:
                fits &= _comparable(mark[rows][:, None], mark[cols][None, :])
            i, j = np.nonzero(fits)
            if not len(i):
                continue
            i, j = rows[i], cols[j]
            apart = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1)
            most = size[i] + size[j] - 2 * np.ceil(size[j] * likeness - 1e-9)
            keep = np.flatnonzero(apart <= most)
            both = keep[size[i[keep]] > SKETCH_ELEMENTS]
            if len(both):
                keep = np.setdiff1d(keep, both[long.apart(tid[i[both]], tid[j[both]]) > most[both]], assume_unique=True)
            out_i.append(order[i[keep]])
            out_j.append(order[j[keep]])
    if not out_i:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _join(likeness: float, long):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by region; a region, which has at most two blocks of texts, may span batches."""
        held: tuple[np.ndarray, np.ndarray] | None = None

        def pairs(region: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
            ends = np.append(starts[1:], len(rows))
            many = ends - starts > 1
            found_a, found_b = [], []
            for a, b in zip(starts[many], ends[many], strict=True):
                part = rows[a:b]
                i, j = _join_region(part, likeness, long.value)
                if len(i):
                    x, y = part["tid"][i], part["tid"][j]
                    found_a.append(np.minimum(x, y))
                    found_b.append(np.maximum(x, y))
            if found_a:
                both = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)], axis=1), axis=0)
                both = both[both[:, 0] != both[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            region, rows = batch.column(0).to_numpy(), _unpacked(batch.column(1))
            if held is not None:
                region, rows = np.concatenate([held[0], region]), np.concatenate([held[1], rows])
            cut = np.searchsorted(region, region[-1])
            held = region[cut:], rows[cut:]
            if cut:
                yield from pairs(region[:cut], rows[:cut])
        if held is not None:
            yield from pairs(*held)

    return run


def _measure(radius: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (region, part, pivot, tid, words, body) sorted by region and part, pivots (``pivot`` >= 0) first in each:
        a row for each Voronoi cell that a text belongs to or is replicated into."""
        here: tuple | None = None
        pivots: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            out: dict[str, list] = {"region": [], "cell": [], "own": [], "tid": [], "body": []}
            for region, part, pivot, tid, words, body in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (region, part) != here:
                    here, pivots = (region, part), []
                items = elements(words)
                if pivot >= 0:
                    pivots.append((pivot, items))
                    continue
                apart = np.array([1 - len(np.intersect1d(items, p, assume_unique=True)) / max(len(items), len(p)) for _, p in pivots])
                nearest = int(apart.argmin())
                for at in np.flatnonzero(apart <= apart[nearest] + 2 * radius + 1e-9):
                    out["region"].append(region)
                    out["cell"].append(pivots[at][0])
                    out["own"].append(bool(at == nearest))
                    out["tid"].append(tid)
                    out["body"].append(body)
            types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies with REPLICA where ``own`` is false; a text that was a replica once stays one."""
    for batch in batches:
        rows = _unpacked(batch.column(2)).copy()
        rows["mark"] |= np.where(batch.column(1).to_numpy(zero_copy_only=False), 0, REPLICA).astype(np.int32)
        yield _packed(batch.column(0).to_numpy(), rows)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, body, blocks) to a row for each pair of blocks that a text takes part in; one block stays as it is."""
    for batch in batches:
        single = batch.filter(pc.equal(batch.column(2), 1))
        yield single.select([0, 1])
        batch = batch.filter(pc.greater(batch.column(2), 1))
        if not batch.num_rows:
            continue
        regions, rows = batch.column(0).to_numpy(), _unpacked(batch.column(1))
        for region, row, blocks in zip(regions, rows, batch.column(2).to_pylist(), strict=True):
            mine = int(_mix(np.array([row["tid"]]).view(np.uint64))[0] % np.uint64(blocks))
            out = np.repeat(row, blocks)
            other = np.arange(blocks)
            out["mark"] |= np.where(other == mine, 0, np.where(other > mine, FIRST, SECOND)).astype(np.int32)
            cells = (np.minimum(other, mine) * blocks + np.maximum(other, mine)).astype(np.uint64)
            yield _packed(_mix(cells * _A + _mix(np.array([region]).view(np.uint64) + _C)).view(np.int64), out)


POSTINGS = "region bigint, body binary"


def _sized(postings: DataFrame, region_texts: int) -> DataFrame:
    """(region, texts) of the regions above ``region_texts``."""
    return postings.groupBy("region").agg(F.count("*").alias("texts")).where(F.col("texts") > region_texts)


def _cells(rows: DataFrame, texts: DataFrame, likeness: float) -> DataFrame:
    """(region, cell, own, tid, body) of rows (region, part, pivot, tid, body)."""
    rows = rows.join(texts.select("tid", "words"), "tid").select("region", "part", "pivot", "tid", "words", "body")
    rows = rows.repartition("region", "part").sortWithinPartitions("region", "part", F.desc("pivot"))
    return rows.mapInArrow(_measure(1 - likeness), "region bigint, cell int, own boolean, tid bigint, body binary")


def _worth(cells: DataFrame, share: float = 0.5) -> DataFrame:
    """The regions where the pairs to be compared in the cells are at most this share of those in the undivided region."""
    work = cells.groupBy("region", "cell").agg(F.count_if("own").cast("double").alias("own"), F.count("*").cast("double").alias("all"))
    work = work.groupBy("region").agg(F.sum(F.col("own") * F.col("all")).alias("work"), F.sum("own").alias("texts"))
    return work.where(F.col("work") <= F.col("texts") * F.col("texts") * share).select("region")


def divided(postings: DataFrame, texts: DataFrame, likeness: float, region_texts: int, block_texts: int | None = None, every: DataFrame | None = None) -> DataFrame:
    """The same postings in regions of at most ``region_texts``, or two blocks of ``block_texts`` (by default as many): by
    documents as pivots as long as their windows exclude enough, then in blocks.

    ``postings`` (region, body) is computed three times rather than kept, and of a large region only a few texts are
    measured before it is known that its division pays: most of it would be written for nothing. ``texts`` has tid and
    words. ``every``, if given, holds ``postings`` and others, in regions that are not above ``region_texts``, and is
    what is returned.
    """
    done: list[DataFrame] = []
    # Byte by byte: reverse() takes bytes for characters and keeps some of them together.
    number = F.conv(F.concat(*(F.hex(F.substring("body", at, 1)) for at in range(8, 0, -1))), 16, 10).cast("bigint")
    level = 0
    while True:
        whole = every if every is not None and level == 0 else postings
        sizes = materialize(_sized(postings, region_texts))
        if sizes.isEmpty():
            done.append(whole)
            break
        # One row for each ``region_texts`` postings at most.
        few = small_enough(sizes, BROADCAST_ROWS)
        known = postings.join(F.broadcast(sizes) if few else sizes, "region").select("region", "body", "texts", number.alias("tid"))
        # The pivots of a region are its texts of least hash, other ones on each level, and the sample those that follow.
        # Only those of a low hash are looked at.
        least = known.select("region", "texts", "tid", F.xxhash64("tid", F.lit(level)).alias("h"))
        least = least.where((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("texts") <= 4 * (PIVOTS + SAMPLE))
        ranked = least.withColumn("r", F.row_number().over(Window.partitionBy("region").orderBy("h", "tid")) - 1).where(F.col("r") < PIVOTS + SAMPLE)
        ranked = materialize(ranked.select("region", "texts", "tid", "r"))
        pivots = ranked.where(F.col("r") < PIVOTS).select("region", "texts", F.col("r").alias("pivot"), "tid")
        zero, none = F.lit(0).cast("bigint"), F.lit(b"")
        # Pivots lie nearest to themselves and would make the division look better than it is.
        sample = ranked.select("region", zero.alias("part"), F.when(F.col("r") < PIVOTS, F.col("r")).otherwise(-1).alias("pivot"), "tid", none.alias("body"))
        hopeful = materialize(_worth(_cells(sample, texts, likeness), 0.75))
        worth, inner = hopeful, None
        if not hopeful.isEmpty():
            large = materialize(known.join(F.broadcast(hopeful) if few else hopeful, "region"))
            parts = F.ceil(F.col("texts") / MEASURED_ROWS)
            drawn = pivots.join(hopeful, "region").select("region", F.explode(F.sequence(zero, parts - 1)).alias("part"), "pivot", "tid", none.alias("body"))
            rows = large.select("region", F.pmod(F.xxhash64("tid", F.lit(-2)), parts).alias("part"), F.lit(-1).alias("pivot"), "tid", "body").unionByName(drawn)
            cells = materialize(_cells(rows, texts, likeness))
            worth = materialize(_worth(cells))
            inner = cells.join(worth, "region").select(F.xxhash64("region", "cell").alias("region"), "own", "body")
        blocks = F.ceil(F.col("texts") / (block_texts or region_texts)).cast("int").alias("blocks")
        decided = materialize(sizes.join(worth, "region", "left_anti").select("region", blocks).unionByName(worth.select("region", F.lit(0).alias("blocks"))))
        split = whole.join(F.broadcast(decided) if few else decided, "region", "left").select("region", "body", F.coalesce("blocks", F.lit(1)).alias("blocks"))
        done.append(split.where("blocks > 0").mapInArrow(_blocks, POSTINGS))
        if inner is None or worth.isEmpty():
            break
        postings = materialize(inner.mapInArrow(_replicas, POSTINGS))
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def normal_words(text: Column) -> Column:
    """The words of a text (runs of a-z and 0-9 after lower-casing), separated by blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def distinct_texts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, texts) of (kind, id, text): members (kind, id, key), texts (tid, kind, key, copies, words).

    Null texts and texts of fewer than eight words are left out; repeated rows of an id count once. Deliveries of an id
    are combined within each task before texts are shuffled, and normalised after.
    """
    delivered = records.groupBy("kind", "id").agg(F.collect_set("text").alias("texts"))
    rows = delivered.select("kind", "id", F.explode(F.array_distinct(F.transform("texts", normal_words))).alias("words"))
    rows = rows.where(F.length("words") - F.length(F.translate("words", " ", "")) >= LEAST_WORDS - 1)
    members = written(rows.withColumn("key", F.md5(F.concat_ws("|", "kind", "words"))))
    texts = members.groupBy("kind", "key", "words").agg(F.count("*").alias("copies"))
    return members.select("kind", "id", "key"), written(texts.select(F.monotonically_increasing_id().alias("tid"), "kind", "key", "copies", "words"))


def similar_texts(texts: DataFrame, likeness: float = LIKENESS, region_texts: int = REGION_TEXTS) -> DataFrame:
    """(a, b, likeness) for all pairs of different ``tid`` of one kind that are at least so alike, a < b.

    ``texts`` has tid (unique), kind and words (see :func:`normal_words`) and is read three times, so it should be
    materialized.
    """
    spark = texts.sparkSession
    kinds = texts.withColumn("words", F.col("words"))
    pairs = F.length("words") - F.length(F.translate("words", " ", ""))
    total = kinds.agg(F.coalesce(F.sum(pairs), F.lit(0))).first()[0]
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (total // 4).bit_length()))
    counted = kinds.select("words").mapInArrow(_count(slots), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(slots, dtype=np.int32)
    table = counted.toArrow()  # at most MOST_SLOTS rows
    counts[table.column("slot").to_numpy()] = np.minimum(table.column("n").to_numpy(), np.iinfo(np.int32).max)
    sent = spark.sparkContext.broadcast(counts)

    def post(least: int):  # noqa: ANN202
        """Postings in regions that may be above so many texts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 200):
                    batch = whole.slice(start, 200)
                    regions, bodies = [], []
                    for tid, kind, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                        items = elements(words)
                        near, position, times = _prefix(items, sent.value, likeness)
                        chosen = times > least
                        if not chosen.any():
                            continue
                        near, position = near[chosen], position[chosen]
                        rows = np.zeros(len(near), dtype=BODY)
                        rows["tid"], rows["size"], rows["left"], rows["sketch"] = tid, len(items), len(items) - position, sketch(items)
                        regions.append(_mix(near + _mix(np.array([_word(kind)], dtype=np.uint64))).view(np.int64))
                        bodies.append(rows)
                    if regions:
                        yield _packed(np.concatenate(regions), np.concatenate(bodies))

        return run

    postings = kinds.select("tid", "kind", "words").mapInArrow(post(0), POSTINGS)
    if (counts > region_texts).any():
        may_be_large = kinds.select("tid", "kind", "words").mapInArrow(post(region_texts), POSTINGS)
        postings = divided(may_be_large, kinds, likeness, region_texts, BLOCK_REGIONS * region_texts, postings)
    long = spark.sparkContext.broadcast(_long_sketches(kinds, pairs))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = postings.repartition(parts, "region").sortWithinPartitions("region").mapInArrow(_join(likeness, long), "a bigint, b bigint").distinct()
    met = materialize(met)
    # Only texts that met another are fetched for the verification.
    involved = met.select(F.explode(F.array("a", "b")).alias("tid")).distinct()
    kinds = kinds.join(F.broadcast(involved) if small_enough(involved, BROADCAST_ROWS) else involved, "tid", "left_semi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, like = [], [], []
            for i, j, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                p, q = _cached(x), _cached(y)
                common = len(np.intersect1d(p, q, assume_unique=True))
                if common >= least_common(max(len(p), len(q)), likeness):
                    a.append(i)
                    b.append(j)
                    like.append(round(common / max(len(p), len(q)), 6))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(like, pa.float64())], names=["a", "b", "likeness"])

    both = met.join(kinds.select(F.col("tid").alias("a"), F.col("words").alias("wa")), "a").join(kinds.select(F.col("tid").alias("b"), F.col("words").alias("wb")), "b")
    return both.select("a", "b", "wa", "wb").mapInArrow(verify, "a bigint, b bigint, likeness double")


@lru_cache(maxsize=4000)
def _cached(words: str) -> np.ndarray:
    return elements(words)


def similar_records(records: DataFrame, likeness: float = LIKENESS, region_texts: int = REGION_TEXTS) -> DataFrame:
    """(kind, id_a, id_b) of all pairs of different ids of one kind whose texts are alike, id_a < id_b.

    ``records`` has kind, id and text. Lists every pair of a group, copies included, as the output is defined so; see
    :func:`groups` for one row per record.
    """
    members, texts = distinct_texts(records)
    pairs = similar_texts(texts, likeness, region_texts).select("a", "b")
    copies = texts.where("copies > 1").select(F.col("tid").alias("a"), F.col("tid").alias("b"))
    keys = texts.select("tid", "kind", "key")
    known = pairs.unionByName(copies)
    left = known.join(keys.select(F.col("tid").alias("a"), "kind", F.col("key").alias("ka")), "a").join(keys.select(F.col("tid").alias("b"), F.col("key").alias("kb")), "b").select("kind", "ka", "kb")
    x = members.select("kind", F.col("key").alias("ka"), F.col("id").alias("x"))
    y = members.select("kind", F.col("key").alias("kb"), F.col("id").alias("y"))
    found = left.join(x, ["kind", "ka"]).join(y, ["kind", "kb"]).where((F.col("ka") != F.col("kb")) | (F.col("x") < F.col("y")))
    return found.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b): the least node of each component.

    Alternating large-star and small-star steps on written tables; a hub with any number of links is only ever
    aggregated, never collected. Ends only when nothing changes.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    links = materialize(links)
    while True:
        before = links
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = sides.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        links = materialize(small)
        if links.count() == before.count() and links.exceptAll(before).isEmpty():
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(records: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """One row per record of at least eight words: kind, id, group (the least text number of the group), links, copies.

    ``links`` counts the different texts that the record's text is alike to, ``copies`` the records of exactly its
    words. Records that resemble none form groups of their own.
    """
    members, texts = distinct_texts(records)
    pairs = materialize(similar_texts(texts, likeness).select("a", "b"))
    roots = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("links"))
    classed = texts.join(roots.withColumnRenamed("node", "tid"), "tid", "left").join(degree, "tid", "left")
    classed = classed.select("kind", "key", "copies", F.coalesce("root", "tid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least = members.join(classed, ["kind", "key"]).groupBy("kind", "root").agg(F.min("id").alias("group"))
    return members.join(classed, ["kind", "key"]).join(least, ["kind", "root"]).select("kind", "id", "group", "links", "copies")
