"""Chat formatting by quotation links.

Each message is parsed into its own text and its quoted passages with their nesting level. Own
paragraphs and lines, and quoted ones, are normalised and hashed; a quoted passage belongs to the
first message of its conversation that holds it as its own text. A message replies to the message
of its least nested, then longest passage that is found. Following replies up gives each message its
thread, and conversations come in reply order, without the quotes: a message is followed by its replies,
the earliest first, each with all of its own replies. conversations() writes them as texts of PIECE messages
at most, as a conversation may be long.

Passages are looked up by (conversation, hash) against one row for each of them, made with map-side
aggregation, so that a phrase that many messages share costs no pairs. Threads and places are found by pointer
doubling: rounds grow with the logarithm of the longest chain. Replies to one message are put in order by a
sort over all rows, so that neither a conversation nor the replies to one message are one task's work.

Defined cases: null and empty texts have an empty body; a quote of nothing that was said before, or
of the message itself, links with nothing; messages without a link start a thread of their own;
null conversations or turns link with nothing and are conversations of their own; repeated (conversation, turn)
rows are one message for links; those of one role and text come once in a conversation, others one after
another in order of a digest; passages that several messages of a turn hold tie and mean that turn; very long
texts are parsed whole, one at a time; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import dropped, stored, text_slices

QUOTED = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: Lines that announce a quote: "On ... wrote:" and its like.
ANNOUNCES = re.compile(r"^\s*\S.{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$")
SPACES = re.compile(r"\s+")
#: Messages of one text; rounds of doubling, more than any chain of practical length needs.
PIECE, MOST_ROUNDS = 64, 48


def normal(text: str) -> str:
    return SPACES.sub(" ", text).strip().lower()


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def parts(lines: list[str]) -> set[str]:
    """Normalised whole, paragraphs and lines."""
    found = {normal(" ".join(lines))}
    paragraph: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            found.add(normal(line))
            paragraph.append(line)
        elif paragraph:
            found.add(normal(" ".join(paragraph)))
            paragraph = []
    return found - {""}


def parse(text: str) -> tuple[str, list[int], list[tuple[int, int, int]]]:
    """(own text, hashes of its parts, (level, hash, characters) of quoted parts)."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    open_level = 0
    for line in text.replace("\r\n", "\n").split("\n"):
        m = QUOTED.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            if open_level == 0:  # an announcement before a quote is not own text
                last = next((i for i in range(len(own) - 1, -1, -1) if own[i].strip()), None)
                if last is not None and ANNOUNCES.match(own[last]):
                    del own[last:]
            if level != open_level:
                passages.append((level, []))
            passages[-1][1].append(line[m.end() :])
        open_level = level
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip() for line in own)).strip("\n")
    quoted = {(level, digest(part), len(part)) for level, lines in passages for part in parts(lines)}
    return body, sorted(map(digest, parts(own))), sorted(quoted)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quote = pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("chars", pa.int32())])
    for batch in text_slices(batches, "text"):
        rows = [parse(t) for t in batch.column(3).to_pylist()]
        quotes = [[{"level": a, "hash": b, "chars": c} for a, b, c in r[2]] for r in rows]
        made = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array(quotes, pa.list_(quote))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["conv_id", "turn", "role", "body", "own", "quotes"])


def threaded(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) of each reply, by pointer doubling over (conv_id, turn, reply_turn)."""
    state = stored(links.select("conv_id", "turn", F.col("reply_turn").alias("thread_turn"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(MOST_ROUNDS):
        up = state.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("__next"), F.col("depth").alias("__more"))
        joined = state.join(up, ["conv_id", "thread_turn"], "left")
        if joined.where("__next is not null").isEmpty():
            return state
        following = stored(
            joined.select("conv_id", "turn", F.coalesce("__next", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("__more", F.lit(0))).alias("depth")), "threads"
        )
        dropped(state)
        state = following
    raise RuntimeError(f"threads are not followed to their ends after {MOST_ROUNDS} rounds")


def following(rows: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """rows with `next`, the value of a column in the next row of the same group: all rows are sorted by group and order
    over the cluster, and the first row of each part, which the driver sees, continues the part before it."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    at = [rows.columns.index(c) for c in (*group, column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True

        def given(table: pa.Table, following_row: tuple | None) -> pa.RecordBatch:
            keys = [tuple(r) for r in zip(*(table.column(i).to_pylist() for i in at[:-1]), strict=True)]
            values = table.column(at[-1]).to_pylist()
            behind = [*zip(keys[1:], values[1:], strict=True), following_row]
            found = [b[1] if b and b[0] == k else None for k, b in zip(keys, behind, strict=True)]
            ends = [first and i == 0 for i in range(len(keys))]
            columns = [*table.columns, pa.array(found, table.schema.field(at[-1]).type), pa.array([part] * len(keys), pa.int32()), pa.array(ends), pa.array([following_row is None and i == len(keys) - 1 for i in range(len(keys))])]
            return pa.Table.from_arrays(columns, names=[*table.schema.names, "next", "part", "first", "last"]).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                head = tuple(table.column(i)[0].as_py() for i in at)
                yield given(held, (head[:-1], head[-1]))
                first = False
            held = table
        if held is not None:
            yield given(held, None)

    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + f", next {kinds[column]}, part int, first boolean, last boolean"
    sorted_rows = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    found = stored(sorted_rows.mapInArrow(run, schema), "following")
    heads = sorted(found.where("first").select("part", F.struct(*group).alias("g"), column).collect(), key=lambda r: r["part"])  # a row for each part
    patches = [(a["part"], tuple(b["g"]), b[column]) for a, b in zip(heads, heads[1:], strict=False)]
    inner = ", ".join(f"`{g}`: {kinds[g]}" for g in group)
    patch = rows.sparkSession.createDataFrame(patches, f"part int, __g struct<{inner}>, __v {kinds[column]}").withColumn("last", F.lit(True))
    same = F.struct(*group).eqNullSafe(F.col("__g"))
    return found.join(F.broadcast(patch), ["part", "last"], "left").withColumn("next", F.when(F.col("last") & same, F.col("__v")).otherwise(F.col("next"))).select(*rows.columns, "next")


def placed(elements: DataFrame) -> DataFrame:
    """(conv_id, id, place) of (conv_id, turn, id, reply_turn): places in reply order, from 0. A message is followed by
    its first reply, else by the next reply to what it answers, or to what that answers, and so on."""
    heads = elements.groupBy("conv_id", "turn").agg(F.min("id").alias("parent"))
    named = elements.join(heads.withColumnRenamed("turn", "reply_turn"), ["conv_id", "reply_turn"], "left").select("conv_id", "turn", "id", "parent")
    beside = stored(following(stored(named, "named"), ["conv_id", "parent"], ["turn", "id"], "id"), "beside")
    child = beside.where("parent is not null").groupBy("conv_id", F.col("parent").alias("id")).agg(F.min(F.struct("turn", "id"))["id"].alias("child"))
    # Where there is no next sibling, ask the parent, and so on.
    state = stored(beside.select("conv_id", "id", "next", F.when(F.col("next").isNull(), F.col("parent")).alias("up")), "after")
    state = _doubled(state, "up", lambda own, other: {"next": F.coalesce(own("next"), other("next"))}, "after")
    chain = state.join(child, ["conv_id", "id"], "left").select("conv_id", "id", F.coalesce("child", "next").alias("next"), F.lit(1).cast("long").alias("left"))
    ranked = _doubled(stored(chain, "chain"), "next", lambda own, other: {"left": own("left") + F.coalesce(other("left"), F.lit(0))}, "chain")
    totals = ranked.groupBy("conv_id").agg(F.max("left").alias("total"))
    return ranked.join(totals, "conv_id").select("conv_id", "id", (F.col("total") - F.col("left")).alias("place"))


def _doubled(state: DataFrame, pointer: str, combined, name: str) -> DataFrame:  # noqa: ANN001
    """Pointer doubling over (conv_id, id): until no pointer is left, each row takes in what its pointer's row knows,
    and that row's pointer."""
    kept = [c for c in state.columns if c not in ("conv_id", "id", pointer)]
    for _ in range(MOST_ROUNDS):
        if state.where(F.col(pointer).isNotNull()).isEmpty():
            return state
        other = state.select("conv_id", F.col("id").alias(pointer), *(F.col(c).alias(f"__{c}") for c in kept), F.col(pointer).alias("__pointer"))
        made = combined(lambda c: F.col(c), lambda c: F.col(f"__{c}"))
        # Rows without a pointer are done; only the others ask.
        joined = state.where(F.col(pointer).isNotNull()).join(other, ["conv_id", pointer], "left")
        values = {c: made.get(c, F.col(c)).alias(c) for c in kept}
        # What is found needs no pointer any more, where the pointer leads to a value and not along a chain.
        rest: Column = F.when(values["next"].isNull(), F.col("__pointer")) if "next" in values else F.col("__pointer")
        columns = ["conv_id", "id", *kept, pointer]
        asked = joined.select("conv_id", "id", *values.values(), rest.alias(pointer)).select(columns)
        following_state = stored(asked.unionByName(state.where(F.col(pointer).isNull()).select(columns)), name)
        dropped(state)
        state = following_state
    raise RuntimeError(f"{name} is not followed to its ends after {MOST_ROUNDS} rounds")


def conversations(messages: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, piece, n_messages, turns, text): each conversation in reply order, in texts of `piece` messages at most."""
    rows = stored(linked(messages), "linked")
    whole = rows.where("conv_id is not null and turn is not null").withColumn("id", F.xxhash64("turn", "role", "body"))
    elements = whole.groupBy("conv_id", "turn", "id").agg(F.min("reply_turn").alias("reply_turn"), F.first("message").alias("message"))
    elements = stored(elements, "elements")
    places = placed(elements.select("conv_id", "turn", "id", "reply_turn"))
    put = elements.join(places, ["conv_id", "id"]).withColumn("piece", F.floor(F.col("place") / piece))
    texts = put.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "message"))).alias("m"))  # `piece` messages at most
    made = texts.select("conv_id", "piece", F.size("m").alias("n_messages"), F.transform("m", lambda x: x.turn).alias("turns"), F.array_join(F.transform("m", lambda x: x.message), "").alias("text"))
    alone = rows.where("conv_id is null or turn is null").select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit(1).alias("n_messages"), F.array("turn").alias("turns"), F.col("message").alias("text"))
    return made.unionByName(alone)


def linked(messages: DataFrame) -> DataFrame:
    """Each message of (conv_id, turn, role, text) without its quotes: body, n_quotes, reply_turn,
    thread_turn and depth, and `message`, as the chat format writes it."""
    parsed = stored(
        messages.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(
            _parsed,
            f"conv_id {messages.schema['conv_id'].dataType.simpleString()}, turn {messages.schema['turn'].dataType.simpleString()}, role string, body string, own array<long>, quotes array<struct<level:int,hash:long,chars:int>>",
        ),
        "parsed",
    )
    first = parsed.select("conv_id", "turn", F.explode("own").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("first_turn"))
    quotes = parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    hits = quotes.join(first, ["conv_id", "hash"]).where("first_turn < turn")
    best = F.max(F.struct((-F.col("level")).alias("l"), "chars", "first_turn"))
    links = stored(hits.groupBy("conv_id", "turn").agg(best["first_turn"].alias("reply_turn")), "replies")
    threads = threaded(links)
    rows = parsed.join(links, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
    return rows.select(
        "conv_id", "turn", "role", "body", F.size("quotes").alias("n_quotes"), "reply_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "body", F.lit("\n")).alias("message"),
    )
