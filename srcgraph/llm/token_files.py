"""Token ids in binary files: ids ranked by frequency, in byte-aligned codes of one to four bytes.

1. Texts are encoded by the tokenizers library. Stretches between white space and their words are encoded once, in lower
   case where the text is plain, and kept in bounded tables of the worker; no token of a vocabulary that drops white
   space goes across one, which Encoder checks with the library, and encodes whole texts where it does not hold. An
   end id follows each document.
2. Ids are counted over the whole corpus, in tables no longer than the vocabulary, and ranked: the most
   frequent is 0.
3. Rows are dealt by ranges of doc_id, and each task writes blocks, one after another, through Spark's own file
   writer, so that a lost executor's files are made anew and only whole ones are seen.
4. A block holds, little-endian: the mark, part, number of documents, number of ids, ids of the part before this
   block, length of the data; then the doc_ids, which of them are null, the number of ids of each document,
   control bytes (two bits for each id: its bytes less one, four ids a byte, first id in the lowest bits) and the
   bytes of the ranks. The line end of the writer closes it. A document is never split.
5. Readers take lengths from the control bytes by a table of 256 rows and gather all ranks at once.

Defined cases: a null or empty text has the end id alone; very long texts are one document of one block; rows
without a doc_id come first and rows that repeat one are in order of a digest of their ids, so equal rows have
equal counts and following places; an empty table writes no block and gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import dropped, scratch_dir, stored, text_slices
from .bpe import byte_symbols

END_ID = 1
#: Stretches and words of a generation that a worker keeps, and their longest; ids of a block; bytes of packed ids that one task writes.
KEPT, LONGEST, BLOCK_IDS, PART_BYTES = 200_000, 48, 1 << 16, 16 << 20
MARK = b"SVB1"
HEADER = struct.Struct("<4sIIQQQ")
# Words in lower case, white space aside: contractions, letters, one digit, other signs (fixed values).
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^\sa-zÀ-ÖØ-öø-ɏ0-9]+")
_PLAIN = re.compile(r"[ \t\n\r\x0b\x0c!-~À-ɏ]+").fullmatch
_ID = attrgetter("id")
# White space that str.split() knows and Unicode's White_Space does not (fixed values).
SEPARATORS = "\x1c\x1d\x1e\x1f"
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.int64)


class Kept:
    """A bounded table: when `now` is full it becomes `old`, and what is asked for again moves on."""

    def __init__(self) -> None:
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.now) > KEPT:
            self.now, self.old = {}, self.now


class Encoder:
    """Texts to ids, packed as unsigned little-endian integers of `width`. Stretches between white space are looked up
    in one table, their words in another; words that neither knows go to the library's model. Words are found
    here only where all characters of a stretch are ASCII or Latin letters up to U+024F; other stretches go to
    the library whole. A text of such characters alone, with no special token, is put in lower case first."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = "<u2" if self.size <= 1 << 16 else "<u4"
        self.stretches, self.words = Kept(), Kept()
        self.unit = "H" if self.width == "<u2" else "I"
        self.signs = {b: s for b, s in byte_symbols().items() if chr(b) != s}
        # White space must part tokens and leave none behind, alone or between two words; so must what parts words.
        whole = self.ids("a")
        self.parted = all(self.ids(f"{s}a{s}{s}a{s}") == whole * 2 for s in " \t\n\r\x0b\x0c\x85\xa0  　")
        probes = ("don't", "A1b22", "--x..y", "'s'tt'", "É×é÷", "we'll've", "a_b", "<|x|>", "ǅİ")
        self.split = self.parted and all(np.frombuffer(b"".join(map(self.word, _WORD.findall(p.lower()))), self.width).tolist() == self.ids(p) for p in probes)

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> bytes:
        """A lower-case word's ids by the model, which takes bytes as signs."""
        tokens = self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.signs))
        return array(self.unit, map(_ID, tokens)).tobytes()

    def known(self, word: str) -> bytes:
        """A lower-case word's ids. One that stands as a stretch is not kept a second time."""
        ids = self.words.now.get(word)
        if ids is None:
            ids = self.stretches.now.get(word)
            if ids is None:
                ids = self.words.old.get(word) or self.stretches.old.get(word) or self.word(word)
                if len(word) <= LONGEST:
                    self.words.now[word] = ids
        return ids

    def low(self, stretch: str) -> bytes:
        """The ids of a stretch of plain characters in lower case, which is not in the table of stretches."""
        if stretch.isalpha():
            return self.words.now.get(stretch) or self.words.old.get(stretch) or self.word(stretch)
        first = stretch[:-1]
        if first.isalpha():
            return self.known(first) + self.known(stretch[-1])
        return b"".join(map(self.known, _WORD.findall(stretch)))

    def stretch(self, stretch: str) -> bytes:
        if not (self.split and (stretch.isascii() or _PLAIN(stretch))) or "<|" in stretch:
            return np.array(self.ids(stretch), self.width).tobytes()
        return self.low(stretch.lower())

    def packed(self, text: str) -> bytes:
        if not self.parted or any(c in text for c in SEPARATORS):
            return np.array(self.ids(text), self.width).tobytes()
        self.stretches.turn()
        self.words.turn()
        if self.split and "<|" not in text and (text.isascii() or _PLAIN(text)):
            # So that a word is learnt once, in whatever case it stands; no stretch need be looked at again.
            return b"".join(looked_up(text.lower().split(), self.stretches, self.low))
        return b"".join(looked_up(text.split(), self.stretches, self.stretch))


def looked_up(parts: list[str], table: Kept, made: Callable[[str], bytes]) -> list[bytes]:
    """The ids of each part: known ones by one pass, the others from an older generation or by `made`."""
    now, old = table.now, table.old
    found = list(map(now.get, parts))
    at = -1
    for _ in range(found.count(None)):
        at = found.index(None, at + 1)
        p = parts[at]
        ids = now.get(p)  # an earlier place of this text may have learnt it
        if ids is None:
            ids = old.get(p)
            if ids is None:
                ids = made(p)
            if len(p) <= LONGEST:
                now[p] = ids
        found[at] = ids
    return found


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    return Encoder(path)


def encode(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids, digest) of (doc_id, text): packed ids, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, press = encoder(vocabulary), zstandard.ZstdCompressor(level=1)
        end = b"" if end_id is None else np.array([end_id], machine.width).tobytes()
        for batch in text_slices(batches, "text"):
            made = [machine.packed(text) + end for text in batch.column(1).to_pylist()]
            width = np.dtype(machine.width).itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(m) // width for m in made], pa.int64()), pa.array([press.compress(m) for m in made], pa.binary()), pa.array([zlib.crc32(m) for m in made], pa.int64())],
                names=["doc_id", "n_tokens", "ids", "digest"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids binary, digest long")


def unpacked(column: pa.Array, width: str) -> list[np.ndarray]:
    open_ = zstandard.ZstdDecompressor()
    return [np.frombuffer(open_.decompress(v), width) for v in column.to_pylist()]


def frequencies(encoded: DataFrame, size: int, width: str) -> DataFrame:
    """(id, n) over all documents; a task gives one row for each id it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                counts += np.bincount(np.concatenate(unpacked(batch.column(0), width)), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def ranking(counts: DataFrame) -> np.ndarray:
    """Ids in order of rank: frequent ones first, ties by id. No longer than the vocabulary."""
    rows = counts.toArrow()
    ids, n = np.asarray(rows.column("id")), np.asarray(rows.column("n"))
    return ids[np.lexsort((ids, -n))].astype(np.uint32)


def coded(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of ranks: one to four bytes each."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    fours = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    fours[: len(ranks)] = extra
    fours = fours.reshape(-1, 4)
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    kept = np.arange(4) <= extra[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decoded(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks behind control and data bytes, by table lookup."""
    lengths = _LENGTHS[control].ravel()[:n]
    at = np.cumsum(lengths) - lengths
    out = data[at].astype(np.uint32)
    for k in range(1, int(lengths.max()) if n else 0):
        more = np.flatnonzero(lengths > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(part: int, before: int, docs: list[int | None], lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = coded(ranks)
    names = np.array([d or 0 for d in docs], "<i8").tobytes() + np.array([d is None for d in docs], np.uint8).tobytes()
    return HEADER.pack(MARK, part, len(docs), len(ranks), before, len(data)) + names + np.array(lengths, "<u8").tobytes() + control + data


def blocks(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(part, ids before, doc_ids, lengths, ranks) of each block of a file."""
    at, end = 0, len(content)
    while at < end:
        mark, part, n_docs, n, before, size = HEADER.unpack_from(content, at)
        if mark != MARK:
            raise ValueError(f"no block begins at byte {at}")
        at += HEADER.size
        docs = np.frombuffer(content, "<i8", n_docs, at)
        none = np.frombuffer(content, np.uint8, n_docs, at + 8 * n_docs)
        at += 9 * n_docs
        lengths = np.frombuffer(content, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        control = np.frombuffer(content, np.uint8, -(-n // 4), at)
        data = np.frombuffer(content, np.uint8, size, at + len(control))
        at += len(control) + size + 1  # the writer's line end
        yield part, before, [None if z else d for d, z in zip(docs.tolist(), none.tolist(), strict=True)], lengths, decoded(control, data, n)


def write(encoded: DataFrame, order: np.ndarray, width: str, folder: str) -> None:
    """Blocks of (doc_id, n_tokens, ids, digest) in ascending order of doc_id, file after file."""
    spark = encoded.sparkSession
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, open_ = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            made = block(part, before, docs, [len(h) for h in held], ranks.value[np.concatenate(held)])
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["block"])

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(name)
                held.append(np.frombuffer(press.decompress(ids.as_buffer()), width))
                open_ += len(held[-1])
                if open_ >= BLOCK_IDS:
                    yield closed()
                    before, open_, docs, held = before + open_, 0, [], []
        if docs:
            yield closed()

    size = encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    dealt = encoded.select("doc_id", "digest", "ids").repartitionByRange(parts, "doc_id", "digest").sortWithinPartitions("doc_id", "digest", "ids")
    made = dealt.select("doc_id", "ids").mapInArrow(run, "block binary")
    made.select(F.col("block").cast("string")).write.text(folder, lineSep="\n")


def read(spark: SparkSession, folder: str, order: np.ndarray, one: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """(doc_id, start, n_tokens, what `one` gives for a document's ids) from the files."""
    ids_of = spark.sparkContext.broadcast(order.astype("<u4"))
    names, kinds = zip(*(p.split() for p in schema.split(", ")), strict=True)
    types = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for part, before, docs, lengths, ranks in blocks(batch.column(0)[i].as_py()):
                    ids, ends = ids_of.value[ranks], np.cumsum(lengths)
                    made = zip(*(one(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64()), pa.array([part] * len(docs), pa.int32()), pa.array(before + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), *(pa.array(v, types[k]) for v, k in zip(made, kinds, strict=True))],
                        names=["doc_id", "part", "within", "n_tokens", *names],
                    )

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    rows = stored(files.mapInArrow(run, f"doc_id long, part int, within long, n_tokens long, {schema}"), "token_rows")
    # One row for each writing task.
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "part int, offset long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", *names)


def token_files(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID) -> tuple[str, np.ndarray]:
    """Write the ids of (doc_id, text) in a new folder; the folder, and the ids in order of rank."""
    spark = docs.sparkSession
    encoded = stored(encode(docs, vocabulary, end_id), "encoded")
    machine = encoder(vocabulary)
    order = ranking(frequencies(encoded, max(machine.size, (end_id or 0) + 1), machine.width))
    folder = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(encoded, order, machine.width, folder)
    dropped(encoded)
    return folder, order


def checksums(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files."""
    folder, order = token_files(docs, vocabulary, end_id)
    return read(docs.sparkSession, folder, order, lambda ids: (zlib.crc32(ids.tobytes()),), "ids_crc32 long")
