"""N-gram Jaccard join with filters under several global token orders.

A document's set holds its distinct 5-word shingles. Two sets with Jaccard similarity of at least
T/100 share a token among the first n - ceil(T n / 100) + 1 tokens of each, under any global order of
tokens. Orders here go by how frequent a token is in all documents (the level of a fixed-size count
sketch over every shingle), then by a hash of their own; so each starts with rare tokens, and tokens
of passages that many documents share come last.

1. One pass writes each document's size and 96-bit set key, and the sketch's counts.
2. Prefix tokens under the first order are shuffled and sorted; tokens that only one set has, or only
   sets of unlike sizes, end there. A token far more frequent than the others is dealt to parts, so
   that no task sorts it whole. Sets that have a token left are read once more for what the filters
   need.
3. Sets that share a token become candidates in rounds. First each set meets the pivot of each of its
   tokens, one row a set and token; a round joins near copies around the copy that was changed
   least. When little is left apart, or comparing it is cheap and lets no more pairs pass than would
   meet pivots, all pairs of different components that share a token are formed: sets outside a token's
   largest component ask, so what is joined already makes no pairs.
4. A candidate is dropped by size, by the place of its token, by parity bits (a lower bound of the
   difference of two sets), and where its prefixes do not meet under each of the other orders. Then
   parity bits that grow with the sets bound the difference closely. Only what passes all of them is
   verified by the whole sets.
5. Links make components by alternating star steps.

Every pair of different components passes or fails an exact bound or is verified in the last round, so
no link between components is lost. Tokens are 64-bit digests and set keys 96-bit ones, taken as equal
where the digests are.

Defined cases: null or empty texts, and texts without words, have an empty set and link with
nothing; texts with fewer than five words have one shingle, the whole sequence; very long texts are
hashed alone, in memory of some tens of times their size; rows without a doc_id take the component of
rows with the same set but link with nothing of their own; repeated rows are equal sets; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import dropped, released, stored, text_slices
from .components import components

#: Least similarity in hundredths; words of a shingle; buckets of the count sketch; orders in use.
SIMILARITY, WORDS, BUCKETS, ORDERS = 80, 5, 1 << 22, 3
#: Slices that the sketch and the key filter are summed in; least parity bits of a set; bits of the key filter
#: for each key, and at most; rows of a token that stay together; set keys that a task remembers.
SLICES, PARITY, KEY_BITS, MOST_KEY_BITS, HOT, SEEN = 256, 128, 32, 1 << 27, 1 << 16, 50_000
#: Rounds in which sets meet pivots only, before all that is apart is compared; comparisons by the filters that cost
#: less than such a round.
MOST_PIVOTS, CHEAP = 3, 1 << 24
#: Bytes of text hashed at a time: digests take some tens of times that. Ids whose places a task tells at a time.
SLICE, CHUNK = 1 << 20, 1 << 18
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LETTERS = (np.arange(256, dtype=np.uint64) + np.uint64(0x51ED)) * _M2
_LETTERS ^= _LETTERS >> np.uint64(31)
_LETTERS[65:91] = _LETTERS[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD1342543DE82EF95
_powers = [np.empty(0, np.uint64)] * 2


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * _M2
    x = (x ^ (x >> np.uint64(31))) * _M3
    return x ^ (x >> np.uint64(29))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << max(16, n.bit_length())
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[i] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])
    return _powers[0], _powers[1]


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle digests of each text, A-Z in lower case, words apart at ASCII space."""
    large = texts.cast(pa.large_string())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    data = np.frombuffer(large.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    n = len(data)
    power, inverse = _power_tables(n + 1)
    blank = _SPACE[data]
    border = np.zeros(n + 1, bool)
    border[at] = True
    before = np.r_[True, blank[:-1]] if n else blank
    after = np.r_[blank[1:], True] if n else blank
    starts = np.flatnonzero(~blank & (before | border[:n]))
    ends = np.flatnonzero(~blank & (after | border[1 : n + 1])) + 1
    total = np.r_[np.uint64(0), np.cumsum(_LETTERS[data] * power[:n], dtype=np.uint64)]
    words = mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _M1)
    first = np.searchsorted(starts, at)
    shingles = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS if len(shingles) else 0):
        shingles = (shingles + words[k : k + len(shingles)]) * _M1 + np.uint64(WORDS)
    shingles = mixed(shingles)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(shingles[a : b - WORDS + 1])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(a, b):
                h = (h + words[k : k + 1]) * _M1 + np.uint64(b - a)
            yield mixed(h)
        else:
            yield np.empty(0, np.uint64)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """96 bits that do not depend on the order; they travel with every token."""
    return int(mixed(shingles, 0x1234567).sum(dtype=np.uint64).view(np.int64)), int(mixed(shingles, 0x7654321).sum(dtype=np.uint64) >> np.uint64(32))


def prefix_length(n: int) -> int:
    return n - -(-SIMILARITY * n // 100) + 1


def prefix(shingles: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """The first tokens under one of the global orders: rare levels first, then by the order's own hash."""
    p = prefix_length(len(shingles))
    rank = levels[(shingles & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | mixed(shingles, order * 0x5851F42D) >> np.uint64(8)
    first = np.argpartition(rank, p - 1)[:p] if p < len(rank) else np.arange(len(rank))
    return shingles[first[np.argsort(rank[first])]]


def parity(shingles: np.ndarray, bits: int = PARITY) -> np.ndarray:
    """Bits, a power of two: how many tokens fall in each, odd or even. Two sets differ in at least as many
    tokens as these bits differ."""
    odd = np.bincount((mixed(shingles, 0xBADA55) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide(shingles: np.ndarray) -> bytes:
    """Two to four parity bits a token: so many do not fill up with sets that differ in a quarter."""
    return parity(shingles, max(PARITY, 1 << (2 * len(shingles) - 1).bit_length())).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many tokens two sets differ at least, by their wide bits; more bits fold to those of the smaller set."""
    x, y = sorted((np.frombuffer(v, np.uint64) for v in (a, b)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and the sketch's counts of this task in slices, compressed: most are small."""
    counts, press = np.zeros(BUCKETS, np.uint32), zstandard.ZstdCompressor(level=1)
    for batch in text_slices(batches, "text", SLICE):
        keys, sizes = [], []
        for shingles in sets_of(batch.column(1)):
            np.add.at(counts, (shingles & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
            sizes.append(len(shingles))
            keys.append(set_key(shingles))
        none = [None] * len(sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=SIZED)
    if counts.any():
        none = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SLICES), pa.int32()), pa.array([press.compress(p.tobytes()) for p in counts.reshape(SLICES, -1)], pa.binary())], names=SIZED)
    released()


SIZED = ["doc_id", "n", "f1", "f2", "slice", "counts"]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of whole slices, as what other tasks and the driver need: their levels, compressed, and their sum."""
    sums: dict[int, np.ndarray] = {}
    open_, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for i, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(open_.decompress(counts), np.uint32).astype(np.int64)
            sums[i] = sums[i] + part if i in sums else part
    made = [pa.array([press.compress(levels_of(s).tobytes()) for s in sums.values()], pa.binary()), pa.array([int(s.sum()) for s in sums.values()], pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *made], names=["slice", "levels", "n"])


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Levels of counts, eight for each doubling."""
    return np.minimum(np.floor(8 * np.log2(counts + 1)), 255).astype(np.uint8)


def sketch_of(sized: DataFrame) -> tuple[np.ndarray, int]:
    """The levels of the sketch's BUCKETS counts over all documents, 4 MB whatever the corpus, and the count beyond
    which a token's rows are dealt to parts: only those of tokens far more frequent than the others. The counts
    themselves, eight times as large, stay with the tasks; the driver gets compressed levels as Arrow."""
    levels, n, open_ = np.zeros((SLICES, BUCKETS // SLICES), np.uint8), 0, zstandard.ZstdDecompressor()
    sums = sized.where("slice is not null").select("slice", "counts").repartition("slice")
    for batch in sums.mapInArrow(_summed, "slice int, levels binary, n long").toArrow().to_batches():
        for i, packed, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            levels[i] = np.frombuffer(open_.decompress(packed), np.uint8)
            n += k
    return levels.ravel(), max(HOT, 16 * (n // BUCKETS))


def _prefix_rows(sketch) -> object:  # noqa: ANN001
    """(h, f1, f2 and n, part + 1 and pos) for each prefix token under the first order, two numbers of 32 bits in one:
    these rows are most of what is shuffled. part is -1 where the token's rows stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, bound = sketch.value
        seen: set = set()
        for batch in text_slices(batches, "text", SLICE):
            out: list[list] = [[] for _ in range(4)]
            for shingles in sets_of(batch.column(0)):
                key = set_key(shingles)
                if not len(shingles) or key in seen:
                    continue
                if len(seen) < SEEN:  # copies in this task need to be told once
                    seen.add(key)
                tokens = prefix(shingles, levels, 0)
                split = np.ceil(np.exp2((levels[(tokens & np.uint64(BUCKETS - 1)).astype(np.int64)] + 1.0) / 8) / bound).astype(np.int64)
                out[0].append(tokens.view(np.int64))
                out[1].append(np.full(len(tokens), key[0], np.int64))
                out[2].append(np.full(len(tokens), key[1] << 32 | len(shingles), np.uint64).view(np.int64))
                out[3].append(np.where(split > 1, (key[0] & 0x7FFFFFFF) % split + 1, 0) << 32 | np.arange(len(tokens)))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["h", "f1", "sized", "placed"])
        released()

    return run


PACKED = "h long, f1 long, sized long, placed long"


def unpacked(rows: DataFrame) -> DataFrame:
    """(h, part, n, f1, f2, pos) of _prefix_rows."""
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    return rows.select("h", (F.shiftright("placed", 32) - 1).alias("part").cast("long"), low("sized").alias("n"), "f1", F.shiftrightunsigned("sized", 32).alias("f2"), low("placed").alias("pos"))


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The overlap that sets of a and b tokens need."""
    return -(-SIMILARITY * (a + b) // (100 + SIMILARITY))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (h, part, n, f1, f2). Equal ones count once. A row stays if the set before or
    behind it has a size near enough, which decides for all of its token. Where a token has two sets only
    they are a pair at once, (g1, g2) being the other one, if the token's place leaves room in both. Rows
    of a token in parts stay in any case. Three rows are carried from batch to batch, however large a
    token's group is."""
    held: list[np.ndarray] | None = None
    open_from, more = 0, False  # the first row not written yet; whether its token had rows before those held

    def decided(rows: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray], int, bool]:
        h, part, n, _, _, pos = rows
        same = (h[1:] == h[:-1]) & (part[1:] == part[:-1])
        fits = same & (SIMILARITY * n[1:] <= 100 * n[:-1])
        begins = np.flatnonzero(np.r_[True, ~same])
        sizes = np.diff(np.r_[begins, len(h)])
        if more:
            sizes[0] += 2
        size = np.repeat(sizes, np.diff(np.r_[begins, len(h)]))
        room = np.minimum(n[1:] - pos[1:], n[:-1] - pos[:-1]) >= needed(n[1:], n[:-1])
        two = np.r_[False, fits & room] & (size == 2) & (part < 0)
        keep = (np.r_[False, fits] | np.r_[fits, False]) & (size > 2) | (part >= 0) | two
        begin, full = int(begins[-1]), int(sizes[-1])
        stop = len(h) if last else begin if full <= 2 else len(h) - 1
        keep[:open_from] = keep[stop:] = False
        context = max(begin, stop - 1)
        others = [pa.array(np.r_[0, rows[i][:-1]][keep], mask=~two[keep]) for i in (3, 4)]
        out = pa.RecordBatch.from_arrays([*(pa.array(rows[i][keep]) for i in (0, 2, 3, 4, 5)), *others], names=["h", "n", "f1", "f2", "pos", "g1", "g2"])
        return out, [c[context:] for c in rows], stop - context, full > 2

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.asarray(c) for c in batch.columns]
        if held is not None:
            rows = [np.r_[a, b] for a, b in zip(held, rows, strict=True)]
        changed = np.zeros(len(rows[0]) - 1, bool)
        for c in rows[:5]:
            changed |= c[1:] != c[:-1]
        rows = [c[np.r_[True, changed]] for c in rows]
        out, held, open_from, more = decided(rows, False)
        yield out
    if held is not None:
        yield decided(held, True)[0]


def _places(bits: int):  # noqa: ANN202
    """(slice, places in it) of the two bits of each id, from the halves of its digest; a task tells a place once a CHUNK."""

    def told(digests: np.ndarray) -> pa.RecordBatch:
        at = np.unique(np.r_[digests & (bits - 1), (digests >> 32) & (bits - 1)])
        slices, begins = np.unique(at // (bits // SLICES), return_index=True)
        places = [p.astype(np.uint32).tobytes() for p in np.split(at % (bits // SLICES), begins[1:])]
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array(places, pa.binary())], names=["slice", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.asarray(batch.column(0)))
            if sum(map(len, held)) >= CHUNK:
                yield told(np.concatenate(held))
                held = []
        if held:
            yield told(np.concatenate(held))

    return run


def _bits(bits: int):  # noqa: ANN202
    """Bit arrays of SLICES slices from rows of (slice, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.frombuffer(places, np.uint32)
                np.bitwise_or.at(found.setdefault(s, np.zeros(bits // SLICES // 8, np.uint8)), at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([f.tobytes() for f in found.values()], pa.binary())], names=["slice", "bits"])

    return run


def marked(digests: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether both bits of each id are set."""
    set_at = lambda at: marks[at >> 3] >> (at & 7) & 1 == 1
    mask = 8 * len(marks) - 1
    return set_at(digests & mask) & set_at((digests >> 32) & mask)


def key_filter(ids: DataFrame) -> np.ndarray:
    """Two bits for each id, at most MOST_KEY_BITS in all (16 MB): texts without a mark need not be hashed
    again; a wrong mark costs no more than that. What is shuffled grows with the ids, which may repeat;
    they are read twice, so they come best from a table."""
    bits = min(MOST_KEY_BITS, 1 << max(16, (KEY_BITS * ids.count()).bit_length()))
    rows = ids.select(F.xxhash64("id")).mapInArrow(_places(bits), "slice long, places binary")
    total = np.zeros((SLICES, bits // SLICES // 8), np.uint8)
    for batch in rows.repartition("slice").mapInArrow(_bits(bits), "slice long, bits binary").toArrow().to_batches():
        for i, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[i] |= np.frombuffer(found, np.uint8)
    return total.ravel()


ATTRIBUTES = ", ".join(["n long", *(f"q{i} long" for i in range(PARITY // 64)), "wide binary", *(f"p{k} array<smallint>" for k in range(1, ORDERS))])
KEYS = ["f1", "f2"]


def _attributes(shingles: list[np.ndarray], levels: np.ndarray) -> list[pa.Array]:
    """What the filters need of each set: its size, parity bits and the prefixes under the further
    orders, a token as 16 bits of its hash (which may only let a pair pass that does not meet; of
    large sets many do, and the wide bits drop them)."""
    bits = np.array([parity(s) for s in shingles], np.int64).reshape(len(shingles), PARITY // 64)
    lists = [pa.array([(prefix(s, levels, k) >> np.uint64(48)).astype(np.uint16).view(np.int16) for s in shingles], pa.list_(pa.int16())) for k in range(1, ORDERS)]
    return [pa.array([len(s) for s in shingles], pa.int64()), *(pa.array(b) for b in bits.T), pa.array([wide(s) for s in shingles], pa.binary()), *lists]


def _whole(shingles: list[np.ndarray], _: np.ndarray) -> list[pa.Array]:
    return [pa.array([s.tobytes() for s in shingles], pa.binary())]


def _sets(texts: DataFrame, ids: DataFrame, sketch, made, schema: str) -> DataFrame:  # noqa: ANN001
    """f1, f2 and what `made` makes of the sets of the documents in ids (id), and of a few others; only the
    texts of marked ids are hashed, one for each set and task that has it."""
    marks = key_filter(ids)
    marks_of = texts.sparkSession.sparkContext.broadcast(marks)
    names = [*KEYS, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, bits = sketch.value[0], marks_of.value
        seen: set = set()
        for batch in batches:
            for part in text_slices(iter([batch.filter(pa.array(marked(np.asarray(batch.column(0)), bits)))]), "text", SLICE):
                sets, keys = [], []
                for s in sets_of(part.column(1)):
                    key = set_key(s)
                    if len(s) and key not in seen:
                        sets.append(s)
                        keys.append(key)
                        if len(seen) < SEEN:
                            seen.add(key)
                yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), *made(sets, levels)], names=names)
        released()

    return texts.select(F.xxhash64("doc_id").alias("digest"), "text").mapInArrow(run, f"f1 long, f2 long, {schema}")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, their keys, sizes and wide bits) whose difference leaves room for the overlap that they need."""
    for batch in batches:
        na, nb = (np.asarray(batch.column(i)) for i in (6, 7))
        least = [differing(a, b) for a, b in zip(batch.column(8).to_pylist(), batch.column(9).to_pylist(), strict=True)]
        keep = np.array(least, np.int64) <= na + nb - 2 * needed(na, nb)
        yield batch.filter(pa.array(keep)).select(range(6))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verification: the pairs whose whole sets are similar enough."""
    for batch in batches:
        sides = [[np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(i)] for i in (2, 3)]
        keep = []
        for i, (a, b) in enumerate(zip(*sides, strict=True)):
            both = np.intersect1d(a, b, assume_unique=True).size
            if 100 * both >= SIMILARITY * (len(a) + len(b) - both):
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64())).select([0, 1])
    released()


BITS = [f"q{i}" for i in range(PARITY // 64)]


def _needed(a: str, b: str) -> Column:
    return F.floor((F.lit(SIMILARITY) * (F.col(f"{a}.n") + F.col(f"{b}.n")) + (99 + SIMILARITY)) / (100 + SIMILARITY))


def alike(a: str, b: str) -> Column:
    """Filters by sizes and parity bits between the row structs a and b."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.{q}").bitwiseXOR(F.col(f"{b}.{q}"))) for q in BITS))
    return (F.lit(SIMILARITY) * F.greatest(na, nb) <= 100 * F.least(na, nb)) & (differ <= na + nb - 2 * _needed(a, b))


def able(a: str, b: str) -> Column:
    """The same, and the place of the shared token: of a pair's first shared token it leaves room for the
    overlap that the pair needs."""
    room = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return (room >= _needed(a, b)) & alike(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, wholes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The links among pairs (a, b): prefixes must meet under each further order, and wide bits must leave room for
    a link; only then are the whole sets of what is left made, brought together and compared. One exchange of
    the whole sets by their keys serves both sides of the pairs."""
    orders = [f"p{k}" for k in range(1, ORDERS)]
    side = lambda c: sets.select(F.col("id").alias(c), F.col("f1").alias(f"{c}1"), F.col("f2").alias(f"{c}2"), *(F.col(x).alias(f"{x}{c}") for x in ("n", "wide", *orders)))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    for p in orders:
        met = met.where(F.arrays_overlap(f"{p}a", f"{p}b"))
    near = met.select("a", "b", "a1", "a2", "b1", "b2", "na", "nb", "widea", "wideb").mapInArrow(_near, "a long, b long, a1 long, a2 long, b1 long, b2 long")
    met = stored(near, "met")
    if not met.count():
        return met.select("a", "b")
    whole = wholes(met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id")))).groupBy(*KEYS).agg(F.first("shingles").alias("shingles"))
    part = lambda c: whole.select(F.col("f1").alias(f"{c}1"), F.col("f2").alias(f"{c}2"), F.col("shingles").alias(f"s{c}"))
    both = met.join(part("a"), ["a1", "a2"]).join(part("b"), ["b1", "b2"]).select("a", "b", "sa", "sb")
    links = stored(both.mapInArrow(_similar, "a long, b long"), "links")
    dropped(met)
    return links


COLUMNS = ["id", "n", "pos", *BITS]


def _pairs(met: DataFrame, x: str, y: str) -> DataFrame:
    return met.select(F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b"))


def _beside_pivots(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """Each row (h, r) beside the pivot p of its token, and the token's size. The pivot comes from pool:
    the set with the fewest rarer tokens before the shared one; of near copies, the one that was changed
    least. Pivots are written first, so that both sides of the join are exchanges and the rows of a hot
    token can be split."""
    first = F.min(F.struct((F.col("pos") / F.col("n")).alias("o"), *COLUMNS))
    pivots = stored(pool.groupBy("h").agg(first.alias("p"), F.count(F.lit(1)).alias("pool")), "pivots")
    return stored(rows.select("h", F.struct(*COLUMNS).alias("r")).join(pivots, "h").where("r.id <> p.id"), "beside")


def _apart(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows of tokens whose sets are in different components, with the component c and `big`, the
    component of most rows of the token, which has `size` rows."""
    named = rows.join(joined, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    per = named.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("big"), F.max("k").alias("most"), F.sum("k").alias("size"))
    return stored(named.join(stored(per.where("most < size"), "mixed"), "h"), "apart")


def _all_apart(apart: DataFrame) -> DataFrame:
    """All pairs (a, b) of a token whose sets are in different components and pass the filters. Only sets
    outside a token's largest component ask, so that what has been joined costs nothing."""
    asking = apart.where("c <> big").select("h", F.struct(*COLUMNS, "c").alias("x"))
    asked = apart.select("h", F.struct(*COLUMNS, "c").alias("y"), (F.col("c") == F.col("big")).alias("main"))
    return _pairs(asking.join(asked, "h").where((F.col("x.c") != F.col("y.c")) & (F.col("main") | (F.col("x.id") < F.col("y.id"))) & able("x", "y")), "x", "y")


def _linked(tokens: DataFrame, direct: DataFrame, sets: DataFrame, wholes: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """(id, component) of the sets that have a link. direct: pairs that join the first round. A pivot meets
    all others of its token and is done. A round costs some twenty exchanges however little it joins, so all
    that is apart is compared at once where that is cheap and no more pairs pass than a round would make."""
    links, joined, rows, last = None, None, tokens, False
    for turn in range(MOST_PIVOTS + 1):
        if turn:
            apart = _apart(rows, joined)
            left = apart.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("c") != F.col("big")).cast("long") * F.col("size")).alias("work")).first()
            if not left["n"]:
                break
            last = turn == MOST_PIVOTS or left["work"] <= 8 * left["n"]
            if last or left["work"] <= CHEAP:
                pairs = stored(_all_apart(apart).distinct(), "pairs")
                last = last or pairs.count() <= left["n"]
                if not last:
                    dropped(pairs)
        if not last:
            # Later rounds take the pivots from outside a token's largest component.
            beside = _beside_pivots(apart, apart.where("c <> big")) if turn else _beside_pivots(rows, rows)
            pairs = _pairs(beside.where(able("r", "p")), "r", "p")
            pairs = stored((pairs if turn else pairs.unionByName(direct)).distinct(), "pairs")
            rows = beside.select("h", "r.*")
        found = _verified(pairs, sets, wholes)
        dropped(pairs)
        if joined is None or found.count():
            links = found if links is None else links.unionByName(found)
            joined = components(links, "a", "b")
        if last:
            break
    return joined


def clustered(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))
    sized = stored(texts.mapInArrow(_sized, "doc_id long, n long, f1 long, f2 long, slice int, counts binary"), "sized")
    sketch = spark.sparkContext.broadcast(sketch_of(sized))
    rows = sized.where("slice is null").select("doc_id", "n", "f1", "f2")
    node = rows.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("id"))
    named = texts.where("doc_id is not null")
    tokens = named.select("text").mapInArrow(_prefix_rows(sketch), PACKED)
    shared = stored(unpacked(tokens.repartition(F.col("h"), F.shiftright("placed", 32))).sortWithinPartitions("h", "part", "n", "f1", "f2").mapInArrow(_shared, "h long, n long, f1 long, f2 long, pos long, g1 long, g2 long"), "shared")
    twos = stored(shared.where("g1 is not null").select(*KEYS, "g1", "g2").distinct(), "twos")
    several = shared.where("g1 is null")
    keys = several.select(*KEYS).unionByName(twos.select(*KEYS)).unionByName(twos.select(F.col("g1").alias("f1"), F.col("g2").alias("f2"))).distinct()
    ends = stored(keys.join(node, KEYS), "ends")
    sets = stored(_sets(named, ends.select("id"), sketch, _attributes, ATTRIBUTES).join(ends, KEYS).dropDuplicates(KEYS), "sets")
    known = stored(several.select("h", *KEYS, "pos").join(sets.select(*KEYS, "id", "n", *BITS), KEYS).select("h", *COLUMNS), "tokens")
    side = lambda x, a, b: sets.select(F.col("f1").alias(a), F.col("f2").alias(b), F.struct("id", "n", *BITS).alias(x))
    direct = _pairs(twos.join(side("x", "f1", "f2"), KEYS).join(side("y", "g1", "g2"), ["g1", "g2"]).where(alike("x", "y")), "x", "y")
    joined = _linked(known, direct, sets, lambda wanted: _sets(named, wanted, sketch, _whole, "shingles binary"))
    dropped(shared)
    ids = node.join(joined, "id", "left").withColumn("__c", F.coalesce("component", "id"))
    labelled = rows.join(ids.select("f1", "f2", "__c"), ["f1", "f2"], "left")
    for table in (twos, ends, sets, known):
        dropped(table)
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("__c")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, column: str = "text") -> DataFrame:
    """The documents, one of each component: that of its smallest doc_id. Rows without a doc_id stay."""
    decided = clustered(docs, column).where("doc_id is null or component_id is null or doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    none = docs.where("doc_id is null")
    kept = docs.join(decided, F.col("doc_id") == F.col("__id")).drop("__id").dropDuplicates(["doc_id", column])
    return kept.select(*docs.columns).unionByName(none)
