"""Suffix-array dedup: every byte covered by a WINDOW-byte string that also starts elsewhere goes.

Suffixes are ordered only through WINDOW bytes, by most-significant-digit passes over shuffles, and
equal groups at that depth are the repeated windows:

1. Equal texts are one class with a count (all windows of a class of two or more are repeated).
2. The pass that is shuffled takes GRAM bytes. Only one suffix in about 70 needs it: each window is
   filed under the gram of least hash that it holds, its anchor, which equal windows choose alike.
   Anchors that occur once end here; so do all their windows. (A row for each suffix of the corpus
   would be some twenty times the input.)
3. An anchor that occurs again brings the bytes of the windows filed under it. The suffixes that start
   these windows go through digit after digit (DIGITS), most significant first: a suffix that is alone
   after a digit leaves, the others are ordered by the next, up to WINDOW bytes. Anchors with more than
   HOT occurrences are salted; windows that are alone in their part then meet by their own digest,
   one row for each part.
4. Repeated windows come back to their class as runs of starts, and spans are cut out of the text.

A digit is taken as its 64-bit digest; equal windows agree in three of them, equal texts in 128 bits.
No group is collected whole: anchors are counted with map-side aggregation, the counts are written,
and both sides of the join are exchanges, so that adaptive execution splits a hot anchor's rows;
salted parts are bounded, and runs of one text are bounded by that text.

Defined cases: a null text is the empty one; texts under WINDOW bytes keep all bytes; matches inside
one text count, overlapping ones too; repeated rows and equal texts are copies of each other, so
each loses all its windows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import released, stored, text_slices

WINDOW, GRAM = 200, 64
#: Bytes where a digit begins and ends.
DIGITS = ((0, 64), (64, 128), (128, 200))
#: Occurrences of an anchor that one task compares; bytes hashed at a time, which takes some fifty times that.
HOT, CHUNK = 20_000, 1 << 19
PLACES = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _powers(data: np.ndarray, *sizes: int) -> dict[int, np.ndarray]:
    """Digests of all substrings of each of these sizes (powers of two); no others are kept."""
    h, n = _mixed((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), 1
    found = {n: h} if n in sizes else {}
    factor = 0xBF58476D1CE4E5B9
    while n < max(sizes) and len(h) > n:
        longer = h[:-n] * np.uint64(factor)
        longer += h[n:]
        h = longer
        factor = (factor * factor | 1) & ((1 << 64) - 1)
        n *= 2
        if n in sizes:
            found[n] = h
    return found


def grams(data: np.ndarray) -> np.ndarray:
    return _mixed(_powers(data, GRAM)[GRAM]) if len(data) >= GRAM else np.empty(0, np.uint64)


def digits_of(data: np.ndarray) -> list[np.ndarray]:
    """Digests of the digits of each window that starts in data, one array for each of DIGITS."""
    p, n = _powers(data, 64, *(z - a - 64 for a, z in DIGITS if z - a > 64)), len(data) - WINDOW + 1
    return [p[64][a : a + n] if z - a == 64 else p[64][a : a + n] * np.uint64(0x94D049BB133111EB) + p[z - a - 64][a + 64 : a + 64 + n] for a, z in DIGITS]


def digits_of_contexts(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The same for the windows of contexts, which lie in data between the places `at`. About CHUNK bytes are
    hashed at a time, so that a group of any size takes no more than its windows' own digests."""
    ends = np.r_[0, np.cumsum(np.diff(at) - WINDOW + 1)]
    out = [np.empty(ends[-1], np.uint64) for _ in DIGITS]
    a = 0
    while a < len(at) - 1:
        z = max(a + 1, int(np.searchsorted(at, at[a] + CHUNK, "right")) - 1)
        place = np.arange(ends[a], ends[z]) + np.repeat(at[a:z] - at[a] - ends[a:z], np.diff(ends[a : z + 1]))
        for digests, found in zip(out, digits_of(data[at[a] : at[z]]), strict=True):
            digests[ends[a] : ends[z]] = found[place]
        a = z
    return out


def window_digests(digits: list[np.ndarray]) -> np.ndarray:
    h = digits[0]
    for d in digits[1:]:
        h = _mixed(h) * np.uint64(0xA0761D6478BD642F) + d
    return _mixed(h)


def equal_groups(digits: list[np.ndarray]) -> np.ndarray:
    """The group of each suffix that equals another through all digits, -1 for the others. Most significant
    digit first; what is alone after a digit takes no part in the next."""
    group = np.zeros(len(digits[0]), np.int64)
    left = np.arange(len(group))
    for digit in digits:
        order = np.lexsort((digit[left], group[left]))
        ordered = left[order]
        same = (group[ordered[1:]] == group[ordered[:-1]]) & (digit[ordered[1:]] == digit[ordered[:-1]])
        group[ordered] = np.cumsum(np.r_[True, ~same][: len(ordered)])
        left = ordered[np.r_[False, same][: len(ordered)] | np.r_[same, False][: len(ordered)]]
    out = np.full(len(group), -1, np.int64)
    out[left] = group[left]
    return out


def filed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts that lie in data end to end: (text, anchor digest, anchor, first window, last window)
    for each run of windows with one anchor; places count from the text's start."""
    h = grams(data)
    span = WINDOW - GRAM + 1
    n = len(data) - WINDOW + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    least = (h & ~PLACES) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    anchor = (np.minimum(least[:n], least[span - step : span - step + n]) & PLACES).astype(np.int64)
    owner = np.full(n, -1, np.int64)
    for i in np.flatnonzero(ends - starts >= WINDOW):
        owner[starts[i] : ends[i] - WINDOW + 1] = i
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:], n] - 1
    whole = owner[first] >= 0
    first, last = first[whole], last[whole]
    text, place = owner[first], anchor[first]
    at = starts[text]
    return text, h[place], place - at, first - at, last - at


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, row, offset in the row) with at most about CHUNK bytes; a longer text
    comes in parts that share WINDOW - 1 bytes."""
    texts = batch.column(column)
    texts = texts.cast(pa.large_binary()) if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) else texts
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        if stop > row + 1 or offsets[stop] - offsets[row] <= 2 * CHUNK:
            at = offsets[row : stop + 1] - offsets[row]
            yield data[offsets[row] : offsets[stop]], at[:-1], at[1:], np.arange(row, stop), np.zeros(stop - row, np.int64)
        else:
            for a in range(int(offsets[row]), int(offsets[stop]) - WINDOW + 1, CHUNK):
                part = data[a : min(a + CHUNK + WINDOW - 1, offsets[stop])]
                yield part, np.array([0]), np.array([len(part)]), np.array([row]), np.array([a - offsets[row]])
        row = stop


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
        for data, starts, ends, rows, offset in _chunks(batch, 2):
            text, digest, place, _, _ = filed(data, starts, ends)
            row = rows[text]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digest.view(np.int64), k1[row], k2[row], place + offset[text])], names=["h", "k1", "k2", "p"])
    released()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the windows filed under the anchors that occur again. A text of which there are
    copies needs no answer itself (own = false) but may answer others."""
    for batch in text_slices(batches, "text"):
        k1, k2, copies = (np.asarray(batch.column(i)) for i in (0, 1, 3))
        listed = batch.column(4)
        flat, at = np.asarray(listed.values.field(0)), np.asarray(listed.offsets)
        parts = np.asarray(listed.values.field(1))
        for data, starts, ends, rows, offset in _chunks(batch, 2):
            text, digest, place, first, last = filed(data, starts, ends)
            row = rows[text]
            out: list[list] = [[] for _ in range(8)]
            for r in np.unique(row):
                mine = np.flatnonzero(row == r)
                wanted, n_parts = flat[at[r] : at[r + 1]], parts[at[r] : at[r + 1]]
                order = np.argsort(wanted, kind="stable")
                found = np.searchsorted(wanted[order], place[mine] + offset[text[mine]])
                found = np.minimum(found, len(wanted) - 1)
                hit = wanted[order][found] == place[mine] + offset[text[mine]]
                mine, split = mine[hit], n_parts[order][found][hit]
                at_start = starts[text[mine]]
                spot = (int(k1[r]) & 0x7FFFFFFF) + place[mine] * 2654435761
                columns = (digest[mine].view(np.int64), spot % split, split, np.full(len(mine), k1[r]), np.full(len(mine), k2[r]), first[mine] + offset[text[mine]], np.full(len(mine), copies[r] == 1))
                for values, made in zip(out, columns, strict=False):
                    values.append(made)
                out[7] += [data[x:y].tobytes() for x, y in zip((at_start + first[mine]).tolist(), (at_start + last[mine] + WINDOW).tolist(), strict=True)]
            if not out[0]:
                continue
            out[:7] = [np.concatenate(v) for v in out[:7]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["h", "part", "parts", "k1", "k2", "lo", "own", "context"])
    released()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (h, part). Runs of repeated windows; in salted parts also each window that
    is alone in its part, and one mark for each digest that is not, under the window's digest."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= HOT:
            joined = pa.Table.from_batches(held).combine_chunks()
            h, part = (np.asarray(joined.column(i).chunk(0)) for i in (0, 1))
            border = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1]))
            if len(border):
                cut = int(border[-1]) + 1
                yield from _equal(joined.slice(0, cut))
                held = joined.slice(cut).to_batches()
                size = joined.num_rows - cut
    if held:
        yield from _equal(pa.Table.from_batches(held).combine_chunks())
    released()


def _equal(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    h, part, parts, k1, k2, lo, own = (np.asarray(rows.column(i).combine_chunks()) for i in range(7))
    begins = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])])
    # Groups go through in blocks, so that digests take bounded memory.
    blocks = [0]
    for b in begins[1:]:
        if b - blocks[-1] >= 4000:
            blocks.append(int(b))
    blocks.append(rows.num_rows)
    texts = rows.column(7).combine_chunks()
    for a, z in zip(blocks, blocks[1:], strict=False):
        piece = texts.slice(a, z - a).cast(pa.large_binary())
        offsets = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1]
        data = np.frombuffer(piece.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        counts = np.diff(at) - WINDOW + 1
        row = np.repeat(np.arange(a, z), counts)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        digits = digits_of_contexts(data, at)
        digest = window_digests(digits)
        group = equal_groups(digits)
        repeated = group >= 0
        # Runs of repeated windows in rows that want an answer.
        wanted = repeated & own[row]
        edge = np.r_[True, (row[1:] != row[:-1]) | (wanted[1:] != wanted[:-1])] if len(row) else np.empty(0, bool)
        first = np.flatnonzero(edge)
        last = np.r_[first[1:], len(row)] - 1
        first, last = first[wanted[first]], last[wanted[first]]
        out = [k1[row[first]], k2[row[first]], lo[row[first]] + shift[first], lo[row[first]] + shift[last], np.ones(len(first), bool), _mixed(first.astype(np.uint64) + digest[first]).view(np.int64)]
        # Salted parts: windows that are alone here, and one mark for each digest that is not.
        salted = parts[row] > 1
        alone = np.flatnonzero(salted & ~repeated)
        some = np.flatnonzero(salted & repeated)
        marks = some[np.unique(group[some], return_index=True)[1]]
        for some, asks in ((alone, own[row[alone]]), (marks, np.zeros(len(marks), bool))):
            out = [np.r_[x, y] for x, y in zip(out, [k1[row[some]], k2[row[some]], lo[row[some]] + shift[some], np.where(asks, lo[row[some]] + shift[some], -1), np.zeros(len(some), bool), digest[some].view(np.int64)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["k1", "k2", "lo", "hi", "known", "w"])


def spans_of(runs: np.ndarray) -> np.ndarray:
    """Merged byte spans [start, end) of runs of window starts (rows: first, last)."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(runs[:, 1] + WINDOW)
    new = np.r_[True, runs[1:, 0] > ends[:-1]]
    return np.stack([runs[new, 0], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(runs) - 1]]], axis=1)


def _cut(with_text: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            k1, k2, texts, copies = (batch.column(i) for i in range(4))
            runs = batch.column(4)
            out: list[list] = [[] for _ in range(5)]
            for i, text in enumerate(texts.to_pylist()):
                data = text.encode()
                listed = runs[i].values if runs[i].is_valid else None
                if copies[i].as_py() > 1 and len(data) >= WINDOW:
                    spans = np.array([[0, len(data)]])
                elif listed is not None and len(listed):
                    spans = spans_of(np.stack([np.asarray(listed.field(0)), np.asarray(listed.field(1))], axis=1))
                else:
                    spans = np.empty((0, 2), np.int64)
                kept, at = [], 0
                for a, b in spans.tolist():
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                kept = b"".join(kept)
                # A character that is cut through is not text any more. A text that keeps all its bytes does not travel.
                rest = kept.decode("utf-8", "ignore") if with_text and len(spans) else None
                for values, value in zip(out, (len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans.ravel().tolist(), rest), strict=True):
                    values.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([k1, k2, *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
        released()

    return run


KEYS = "k1 long, k2 long"


def classes_of(docs: DataFrame, column: str = "text") -> DataFrame:
    """One row for each text: its 128-bit key, the text, how often it occurs."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    keyed = docs.select(text.alias("text")).select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), "text")
    return keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def removed_by_class(classes: DataFrame, with_text: bool = False) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept_sha256, spans, kept) for each text; kept is null without with_text, and for a text that
    keeps all its bytes."""
    long = classes.where(F.octet_length("text") >= WINDOW)
    # All three readers of the texts take the same columns, so that one exchange serves them.
    anchors = long.select("k1", "k2", "text", "copies").mapInArrow(_anchors, "h long, k1 long, k2 long, p long")
    often = stored(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    again = anchors.join(often, "h").select("k1", "k2", "p", F.ceil(F.col("n") / HOT).alias("parts"))
    by_text = again.groupBy("k1", "k2").agg(F.collect_list(F.struct("p", "parts")).alias("anchors"))
    contexts = long.join(by_text, ["k1", "k2"]).select("k1", "k2", "text", "copies", "anchors").mapInArrow(
        _contexts, "h long, part long, parts long, k1 long, k2 long, lo long, own boolean, context binary"
    )
    compared = contexts.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(_compared, f"{KEYS}, lo long, hi long, known boolean, w long")
    # A known run has a digest of its own; a window of a salted part meets its equals in other parts.
    met = compared.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("w", "known")))
    runs = met.where("known or (__n > 1 and hi >= 0)").groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    return classes.join(runs, ["k1", "k2"], "left").select("k1", "k2", "text", "copies", "runs").mapInArrow(
        _cut(with_text), f"{KEYS}, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept string"
    )


def removed(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end, start, end ...)."""
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    keyed = docs.drop(*made).withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(7), text), "n_bytes": F.octet_length(text).cast("long")})
    found = removed_by_class(classes_of(docs, column)).withColumnsRenamed({"k1": "__k1", "k2": "__k2"})
    return keyed.join(found.drop("kept"), ["__k1", "__k2"]).drop("__k1", "__k2")


def cleaned(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with the repeated bytes cut out of the text; bytes of a character that is cut through go too."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    found = removed_by_class(classes_of(docs, column), True).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("kept").alias("__kept"), F.col("n_removed").alias("__removed"))
    keyed = docs.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(7), text)})
    return keyed.join(found, ["__k1", "__k2"]).withColumn(column, F.when(F.col("__removed") == 0, F.col(column)).otherwise(F.col("__kept"))).select(*docs.columns)
