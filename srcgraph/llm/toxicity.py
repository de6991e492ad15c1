"""Toxicity by compression distance: windows of a text are compressed with two zstandard
dictionaries, and a text is toxic where its windows get shorter with the toxic one.

Training, on a bounded sample of labelled rows (MAX_TOXIC, MAX_ORDINARY, MAX_TEXT_BYTES):
both dictionaries come from zstandard's trainer. The ordinary one is trained on windows of ordinary
texts (MAX_WINDOWS of them). The toxic one is trained on the words of toxic texts that hold a piece
whose support among toxic texts is significant by a likelihood ratio: the trainer ranks by frequency
alone, and whole toxic texts would give it ordinary language again. The ordinary dictionary stands
behind the toxic one, so that both give ordinary language the same length and only toxic matter makes
a difference. Both are used as content dictionaries. The windows' length differences are held against
thresholds (GAINS) and calibrated by a logistic curve on labelled rows that took no part in choosing
the words; those rows are compressed by Spark tasks.

Scoring reads every whole text once, with no shuffle; only the text goes to Python and only the score
comes back. The model (two dictionaries of some KB and a few numbers) is a constant of the task.

Defined cases: null and empty texts have no windows and get the curve's value for that; very long
texts are read whole, window by window; rows without a doc_id count as held out; labels that are null
are left out, repeated ones count once (a doc_id is toxic if any of its labels says so); repeated rows
are scored alike; without labelled rows of both classes every score is 0; an empty table gives an
empty result; an older column `score` is replaced, other columns stay.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import dropped, gathered, released, stored

#: The bounded sample that the model is fitted on: rows of each class, bytes of a text, windows of the
#: ordinary trainer, bytes of the pieces that mark the toxic trainer's words.
MAX_TOXIC, MAX_ORDINARY, MAX_TEXT_BYTES, MAX_WINDOWS, MARK_BYTES = 2000, 4000, 1 << 15, 20_000, 1024
#: Words of a window; bytes of the dictionaries; the trainer's segment and the substring it counts.
WINDOW_WORDS, ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, COUNTED = 40, 8192, 3072, 16, 6
#: A shorter dictionary is little more than its header: the trainer had too few samples.
LEAST_TRAINED = 512
FOLDS = 5
#: Tasks that measure the sample.
SPREAD = 16
#: Bytes by which a window is shorter with the toxic dictionary.
GAINS = (1, 2, 3, 5)


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def pieces(text: bytes) -> set[bytes]:
    """Words with a space before, their beginnings, and whole words with a space behind."""
    found = set()
    for word in set(text.split()):
        word = b" " + word[:24]
        found.add(word + b" ")
        found.update(word[:k] for k in range(5, min(len(word), 13)))
    return found


def significant(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Pieces more frequent in toxic texts than chance allows, the strongest first."""
    in_toxic: Counter = Counter()
    for text in toxic:
        in_toxic.update(pieces(text))
    in_toxic = Counter({p: n for p, n in in_toxic.items() if n >= 3})
    in_ordinary: Counter = Counter()
    for text in ordinary:
        in_ordinary.update(p for p in pieces(text) if p in in_toxic)
    n1, n2 = len(toxic), len(ordinary)

    def ratio(piece: bytes) -> float:
        a, b = in_toxic[piece], in_ordinary[piece]
        if a / n1 < 6 * (b + 0.5) / n2:
            return 0.0
        part = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n - k else 0)
        p = (a + b) / (n1 + n2)
        return 2 * (part(a, n1, a / n1) + part(b, n2, b / n2) - part(a, n1, p) - part(b, n2, p))

    least = max(10.0, 2 * math.log(max(2, len(in_toxic))))
    ranked = sorted(((r, p) for p in in_toxic if (r := ratio(p)) >= least), reverse=True)
    return [p for _, p in ranked]


def trained(samples: list[bytes], size: int, **shape: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples' end."""
    try:
        made = zstandard.train_dictionary(size, samples, **shape).as_bytes()
    except zstandard.ZstdError:
        made = b""
    return made if len(made) >= LEAST_TRAINED else b"".join(samples)[-size:]


def toxic_dictionary(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """Trained on the words that hold one of the strongest significant pieces (MARK_BYTES of them), once for
    each text. The trainer takes a segment from each stretch of its samples, so these come mixed."""
    marks: set[bytes] = set()
    size = 0
    for piece in significant(toxic, ordinary):
        if not any(piece in longer for longer in marks):
            size += len(piece)
            if size > MARK_BYTES:
                break
            marks.add(piece)
    samples = []
    for text in toxic:
        for word in sorted(set(text.split())):
            word = b" " + word[:24]
            if word + b" " in marks or any(word[:k] in marks for k in range(5, min(len(word), 13))):
                samples.append(word + b" ")
    random.Random(1).shuffle(samples)
    return trained(samples, TOXIC_BYTES, k=SEGMENT, d=COUNTED)


def lowered(text: str) -> bytes:
    return text.encode().lower()


def windows(text: bytes) -> Iterator[bytes]:
    """Word windows of the whole text; a window holds WINDOW_WORDS words, long ones are cut."""
    words = text.split()
    for i in range(0, len(words), WINDOW_WORDS):
        window = b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" "
        for at in range(0, len(window), 1024):
            yield window[at : at + 1024]


@lru_cache(maxsize=2)
def compressors(ordinary: bytes, toxic: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    made = []
    for content in (ordinary, toxic + ordinary):
        params = zstandard.ZstdCompressionParameters(
            window_log=15, hash_log=13, chain_log=14, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTULTRA,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        made.append(zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
    return made[0], made[1]


def features(model: Model, text: str) -> list[float]:
    """1, the windows that gain at least 1, 2, 3 and 5 bytes as counts and shares, and the text's size."""
    a, b = (c.compress for c in compressors(model.ordinary, model.toxic))
    counts, n = [0] * len(GAINS), 0
    for window in windows(lowered(text)):
        n += 1
        d = len(a(window)) - len(b(window))
        if d > 0:
            for k, least in enumerate(GAINS):
                counts[k] += d >= least
    return [1.0, *(math.log1p(c) for c in counts), *(math.log1p(100 * c / (n + 2)) for c in counts), math.log1p(n)]


def logistic(rows: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a small ridge; classes weigh as they come."""
    w = np.zeros(rows.shape[1])
    ridge = np.diag([1e-3] + [0.3] * (rows.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (p - labels) + ridge @ w
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p) + 1e-9)[:, None]) + ridge, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def digest_of(text: str) -> bytes:
    """Texts that are equal in lower case are one text; its last bit deals it to a half."""
    return hashlib.sha256(lowered(text)).digest()


#: (digest, toxic, features) of each row, with the draft that the other half gave.
Measured = list[tuple[bytes, int, list[float]]]


def measured_here(rows: list[tuple[str, int, int]], drafts: tuple[Model, Model]) -> Measured:
    return [(d := digest_of(text), toxic, features(drafts[d[-1] & 1], text)) for text, toxic, _ in rows]


def fit_rows(rows: list[tuple[str, int, int]], measured: Callable[[list, tuple[Model, Model]], Measured] = measured_here) -> Model | None:
    """rows: (text, toxic, a number that orders the rows). Texts that are equal in lower case and have
    the same label count once."""
    unique = {}
    for text, toxic, number in rows:
        unique.setdefault((digest_of(text), toxic), (text, toxic, number))
    rows = sorted(unique.values(), key=lambda r: (r[2], r[0]))
    if not rows or len({toxic for _, toxic, _ in rows}) < 2:
        return None
    halves: list[list[list[bytes]]] = [[[], []], [[], []]]
    for text, toxic, _ in rows:
        halves[digest_of(text)[-1] & 1][toxic].append(lowered(text))
    ordinary = halves[0][0] + halves[1][0]
    samples = (w[i : i + 256] for t in ordinary for w in [b" ".join(t.split())] for i in range(0, len(w), 256))
    base = trained(list(islice(samples, MAX_WINDOWS)), ORDINARY_BYTES)
    # Two halves: each is measured with the words that the other one gave.
    drafts = tuple(Model(base, toxic_dictionary(halves[1 - k][1], halves[1 - k][0]), ()) for k in (0, 1))
    found = {(digest, toxic): row for digest, toxic, row in measured(rows, drafts)}
    keys = sorted(found)
    weights = logistic(np.array([found[k] for k in keys]), np.array([float(k[1]) for k in keys]))
    return Model(base, toxic_dictionary(halves[0][1] + halves[1][1], ordinary), weights)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on labelled rows outside the held-out fold."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    )
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    texts = docs.select("doc_id", F.col("text").alias("__text")).where(F.octet_length("text") <= MAX_TEXT_BYTES)
    parts = []
    for toxic, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY)):
        # The sample's ids are bounded by `most`, so they can go to every task.
        chosen = known.where(F.col("__toxic") == toxic).orderBy(order, "doc_id").limit(most)
        parts.append(texts.join(F.broadcast(chosen), "doc_id").select("__text", F.lit(toxic).alias("__toxic"), order.alias("__n")).orderBy("__n", "__text").limit(most))
    sample = stored(parts[0].unionByName(parts[1]), "toxicity-sample")

    def measured(_: list, drafts: tuple[Model, Model]) -> Measured:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = measured_here([(t or "", y, 0) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], drafts)
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), batch.column(1), pa.array([f[2] for f in found], pa.list_(pa.float64()))], names=["digest", "toxic", "row"])

        spread = sample.select("__text", "__toxic").repartition(SPREAD)
        return [tuple(r) for r in spread.mapInArrow(run, "digest binary, toxic int, row array<double>").collect()]

    model = fit_rows(list(gathered(sample)), measured)
    dropped(sample)
    released()
    return model


def score_of(model: Model | None, text: str) -> float:
    if model is None:
        return 0.0
    z = sum(w * x for w, x in zip(model.weights, features(model, text), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(df: DataFrame, model: Model | None, column: str = "text") -> DataFrame:
    """df with a `score` between 0 and 1; an older column of that name is replaced."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([score_of(model, t.as_py() or "") for t in texts], pa.float64())

    return df.withColumn("score", scored(F.col(column).cast("string")))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are not toxic, with their columns."""
    names = docs.columns
    return score(docs, model).where(F.col("score") < 0.5).select(*names)
