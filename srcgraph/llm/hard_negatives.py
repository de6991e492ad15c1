"""Hard negatives by filtered inner products.

Vectors are held as integers, x -> floor(SCALE * x). Each stored row has, for segments of every width in
WIDTHS, the segment's mean and its deviation. A segment of length L adds to an inner product L * mx * my plus or
minus at most L * dx * dy, so that sums over segments bound a score from both sides; pairs that pass the coarse
bound are refined by narrower segments, and only those that pass all of them are scored exactly.

Anchors are taken in blocks of BLOCK rows, each sent to all tasks; every task goes through its rows once and
keeps, for an anchor, the first rows of its own. Thresholds start from SEEDS rows that all tasks know: the
score that a row must reach, as so many of the seeds do. The first pass over the rows gives each anchor's
positives, the second the negatives within the window of each positive. What tasks kept is merged by anchor.

Defined cases: rows without an id, label or vector, or with a null or non-finite component take no part; of rows
that repeat an id one takes part, that of the smallest label and then vector; vectors of different lengths are
not compared; equal scores are in order of id; an empty table gives an empty result; very long vectors come in
smaller blocks; integers whose products may leave 2^53 are multiplied without rounding and scores beyond a long
are its ends; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import stored

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Widths of segments, coarse to fine; anchors and bytes of a block; rows that give the first thresholds.
WIDTHS, BLOCK, BLOCK_BYTES, SEEDS = (16, 4), 8192, 32 << 20, 2048
#: Rows and anchors that are compared at a time; share of pairs up to which they are scored one by one.
ROWS, ANCHORS, SPARSE = 1024, 512, 0.05
LONG = np.iinfo(np.int64)
NONE = LONG.min


def whole(value: list | None) -> np.ndarray | None:
    """floor(SCALE * x) of each component as a double, exact; None where a component is null or not finite."""
    if value is None:
        return None
    v = np.array([np.nan if x is None else x for x in value], np.float64)
    return np.floor(SCALE * v) + 0.0 if np.isfinite(SCALE * v).all() else None


def summary(vectors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of each row, both times the root of the segment's length."""
    starts = np.arange(0, vectors.shape[1], width)
    if not len(starts):
        return np.zeros((len(vectors), 0)), np.zeros((len(vectors), 0))
    lengths = np.diff([*starts, vectors.shape[1]])
    mean = np.add.reduceat(vectors, starts, axis=1) / lengths
    spread = np.add.reduceat((vectors - np.repeat(mean, lengths, axis=1)) ** 2, starts, axis=1)
    return mean * np.sqrt(lengths), np.sqrt(spread)


class Side(NamedTuple):
    """Rows or anchors of one length: ids, labels, vectors, their norms, and (means, deviations) for each width."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    def part(self, where: np.ndarray | slice) -> Side:
        return Side(self.ids[where], self.labels[where], self.vectors[where], self.norms[where], [(m[where], d[where]) for m, d in self.levels])


def sides(batch: pa.RecordBatch | pa.Table) -> dict[int, Side]:
    """(vec_id, label, dim, whole, levels) rows by length."""
    ids, labels, dims = (np.asarray(batch.column(i)) for i in range(3))
    out = {}
    for d in np.unique(dims).tolist():
        mine = np.flatnonzero(dims == d)
        some = batch.take(pa.array(mine))
        raw = some.column(3).to_pylist()
        vectors = np.stack([np.frombuffer(v, "<i4" if len(v) == 4 * d else "<f8").astype(np.float64) for v in raw]) if d else np.zeros((len(mine), 0))
        flat = np.stack([np.frombuffer(v, "<f4") for v in some.column(4).to_pylist()]).astype(np.float64) if d else np.zeros((len(mine), 0))
        levels, at = [], 0
        for width in WIDTHS:
            n = -(-d // width)
            levels.append((flat[:, at : at + n], flat[:, at + n : at + 2 * n]))
            at += 2 * n
        out[d] = Side(ids[mine], labels[mine], vectors, np.sqrt((vectors * vectors).sum(1)), levels)
    return out


def prepared(vectors: DataFrame, relabel: int | None = None) -> DataFrame:
    """(vec_id, label, dim, whole, levels) of (vec_id, label, embedding). Where `relabel` is given, labels of
    the ids that it divides move on by one, modulo ten."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [whole(v) for v in batch.column(2).to_pylist()]
            good = [i for i, m in enumerate(made) if m is not None]
            levels = []
            for i in good:
                flat = [part[0] for width in WIDTHS for part in summary(made[i][None, :], width)]
                with np.errstate(over="ignore"):
                    levels.append(np.concatenate(flat).astype("<f4").tobytes())
            packed = [(made[i].astype("<i4") if not len(made[i]) or np.abs(made[i]).max() < 2**31 else made[i].astype("<f8")).tobytes() for i in good]
            kept = batch.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.array([len(made[i]) for i in good], pa.int32()), pa.array(packed, pa.binary()), pa.array(levels, pa.binary())], names=["vec_id", "label", "dim", "whole", "levels"]
            )

    label = F.col("label").cast("long")
    if relabel:
        label = F.when(F.col("vec_id") % relabel == 0, (label + 1) % 10).otherwise(label)
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    named = named.where("vec_id is not null and label is not null and embedding is not null")
    rows = stored(named.mapInArrow(run, "vec_id long, label long, dim int, whole binary, levels binary"), "prepared")
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "whole", "levels")).alias("r"))
    return stored(once.select("vec_id", "r.*"), "prepared")


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, rows x anchors, as longs."""
    most = (np.abs(rows).max(initial=0.0)) * (np.abs(anchors).max(initial=0.0)) * max(1, rows.shape[1])
    if most < 2**53:
        return (rows @ anchors.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in rows], object) @ np.array([[int(x) for x in a] for a in anchors], object).T
    return np.clip(exact, LONG.min + 1, LONG.max).astype(np.int64)


def scored(rows: Side, anchors: Side, allowed: np.ndarray, low: np.ndarray, high: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of allowed pairs whose score may be within low to high of the anchor: bounded by segments,
    coarse to fine, then scored exactly."""
    left = allowed.copy()
    # What rounding of the stored summaries may add to a bound.
    slack = 1e-5 * rows.norms[:, None] * anchors.norms[None, :] + 1.0
    sure = (rows.norms < 1e18)[:, None] & (anchors.norms < 1e18)[None, :]  # beyond, summaries may not be numbers
    for (rm, rd), (am, ad) in zip(rows.levels, anchors.levels, strict=True):
        density = left.mean() if left.size else 0.0
        if density > SPARSE:
            with np.errstate(invalid="ignore", over="ignore"):
                middle, spread = rm @ am.T, rd @ ad.T + slack
                left &= ~(sure & (middle + spread < low[None, :]))
                if high is not None:
                    left &= ~(sure & (middle - spread > high[None, :]))
        else:
            i, j = np.nonzero(left)
            with np.errstate(invalid="ignore", over="ignore"):
                middle, spread = np.einsum("md,md->m", rm[i], am[j]), np.einsum("md,md->m", rd[i], ad[j]) + slack[i, j]
                gone = sure[i, j] & (middle + spread < low[j])
                if high is not None:
                    gone |= sure[i, j] & (middle - spread > high[j])
            left[i[gone], j[gone]] = False
    i, j = np.nonzero(left)
    safe = (np.abs(rows.vectors).max(initial=0.0)) * (np.abs(anchors.vectors).max(initial=0.0)) * max(1, rows.vectors.shape[1]) < 2**53
    if safe and len(i) <= SPARSE * left.size:
        return i, j, np.einsum("md,md->m", rows.vectors[i], anchors.vectors[j]).astype(np.int64)
    return i, j, products(rows.vectors, anchors.vectors)[i, j]


class Firsts:
    """The first `most` (score, id) of each slot: higher scores, then smaller ids."""

    def __init__(self, slots: int, most: int) -> None:
        self.most = most
        self.scores = np.full((slots, most), NONE)
        self.ids = np.full((slots, most), LONG.max)

    def least(self) -> np.ndarray:
        """Scores that rows must reach to be among the first."""
        return self.scores[:, -1]

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.scores[slots, -1]
        slots, scores, ids = slots[keep], scores[keep], ids[keep]
        if not len(slots):
            return
        touched = np.unique(slots)
        held = self.scores[touched] > NONE
        slots = np.concatenate([np.repeat(touched, held.sum(1)), slots])
        scores = np.concatenate([self.scores[touched][held], scores])
        ids = np.concatenate([self.ids[touched][held], ids])
        order = np.lexsort((ids, -scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        first = place < self.most
        self.scores[slots[first], place[first]] = scores[first]
        self.ids[slots[first], place[first]] = ids[first]

    def rows(self, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id) of what is held and reaches the floor of its slot."""
        slot, place = np.nonzero((self.scores > NONE) & (self.scores >= floor[:, None]))
        return slot, self.scores[slot, place], self.ids[slot, place]


def windows(positives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest scores s with LOW * p <= 100 * s <= HIGH * p, for scores p of positives."""
    exact = positives.astype(object)
    return np.array([-(-LOW * p // 100) for p in exact.ravel()], object).reshape(exact.shape), np.array([HIGH * p // 100 for p in exact.ravel()], object).reshape(exact.shape)


def gather(rows: Side, anchors: Side, firsts: Firsts, floor: np.ndarray, spans: tuple[np.ndarray, np.ndarray] | None) -> None:
    """Add to firsts what rows give to anchors: of the anchor's label, or of others within the spans (least and
    largest score, anchors x positives; least over largest where there is no such positive)."""
    count = spans[0].shape[1] if spans else 1
    for a in range(0, len(anchors.ids), ANCHORS):
        some = anchors.part(slice(a, a + ANCHORS))
        at = np.arange(a, a + len(some.ids))
        for b in range(0, len(rows.ids), ROWS):
            mine = rows.part(slice(b, b + ROWS))
            same = mine.labels[:, None] == some.labels[None, :]
            if spans is None:
                low = np.maximum(firsts.least()[at], floor[at])
                i, j, s = scored(mine, some, same & (mine.ids[:, None] != some.ids[None, :]), low, None)
                keep = s >= low[j]
                firsts.add(at[j[keep]], s[keep], mine.ids[i[keep]])
                continue
            slots = at[:, None] * count + np.arange(count)
            low = np.maximum(np.maximum(firsts.least()[slots], floor[slots]), spans[0][at])
            high = spans[1][at]
            open_ = low <= high
            lowest = np.where(open_, low, LONG.max).min(1)
            highest = np.where(open_, high, LONG.min).max(1)
            i, j, s = scored(mine, some, ~same & open_.any(1)[None, :], lowest, highest)
            for k in range(count):
                keep = (s >= low[j, k]) & (s <= high[j, k])
                firsts.add(slots[j[keep], k], s[keep], mine.ids[i[keep]])


def _seeded(seeds: dict[int, Side], anchors: dict[int, Side], spans: dict[int, tuple] | None, most: int) -> dict[int, np.ndarray]:
    """For each slot the score that `most` of the seeds reach, or NONE."""
    out = {}
    for d, side in anchors.items():
        slots = len(side.ids) * (spans[d][0].shape[1] if spans else 1)
        firsts = Firsts(slots, most)
        if d in seeds:
            gather(seeds[d], side, firsts, np.full(slots, NONE), spans[d] if spans else None)
        out[d] = firsts.least().copy()
    return out


def _pass(rows: DataFrame, anchors: dict[int, Side], seeds: dict[int, Side], spans: dict[int, tuple] | None, most: int) -> DataFrame:
    """(anchor_id, slot, score, vec_id): the first `most` rows for each slot of an anchor, ranked as `rank`."""
    shared = rows.sparkSession.sparkContext.broadcast((anchors, _seeded(seeds, anchors, spans, most), spans))  # a block's rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, floors, spans = shared.value
        held: dict[int, Firsts] = {}
        for batch in batches:
            for d, mine in sides(batch).items():
                if d in anchors:
                    span = spans[d] if spans else None
                    firsts = held.setdefault(d, Firsts(len(floors[d]), most))
                    gather(mine, anchors[d], firsts, floors[d], span)
        for d, firsts in held.items():
            slot, score, ids = firsts.rows(floors[d])
            count = len(floors[d]) // len(anchors[d].ids)
            for a in range(0, len(slot), 1 << 16):
                cut = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors[d].ids[slot[cut] // count]), pa.array((slot[cut] % count).astype(np.int32)), pa.array(score[cut]), pa.array(ids[cut])], names=["anchor_id", "slot", "score", "vec_id"]
                )

    found = rows.mapInArrow(run, "anchor_id long, slot int, score long, vec_id long")
    # A slot has at most `most` rows from each task.
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _spans(anchors: dict[int, Side], positives: pa.Table, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Windows of each anchor's positives; where there is none, least over largest."""
    owner, rank, score = (np.asarray(positives.column(n)) for n in ("anchor_id", "rank", "score"))
    out = {}
    for d, side in anchors.items():
        low, high = np.full((len(side.ids), width), LONG.max), np.full((len(side.ids), width), LONG.min)
        order = np.argsort(side.ids)
        mine = np.isin(owner, side.ids)
        at = order[np.searchsorted(side.ids, owner[mine], sorter=order)]
        least, largest = windows(score[mine])
        low[at, rank[mine] - 1], high[at, rank[mine] - 1] = least.astype(np.int64), largest.astype(np.int64)
        out[d] = low, high
    return out


def mined(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over prepared rows, for the anchors
    among them."""
    spark = rows.sparkSession
    totals = anchors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("whole") * 2 + F.octet_length("levels") * 2 + 400).alias("bytes")).first()
    blocks = max(1, -(-totals["n"] // BLOCK), -(-(totals["bytes"] or 0) // BLOCK_BYTES))
    columns = ["vec_id", "label", "dim", "whole", "levels"]
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit("seeds")), "vec_id").limit(SEEDS).select(columns).where(F.octet_length("whole") <= BLOCK_BYTES // SEEDS)
    seeds = sides(drawn.toArrow().combine_chunks())
    out = None
    for k in range(blocks):
        block = sides(anchors.where(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)) == k).select(columns).toArrow().combine_chunks())
        near = stored(_pass(rows, block, seeds, None, positives), "positives")
        spans = _spans(block, near.select("anchor_id", "rank", "score").toArrow(), positives)
        hard = _pass(rows, block, seeds, spans, negatives)
        own = near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        part = hard.join(own, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        part = stored(part, "hard") if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out
