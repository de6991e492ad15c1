"""Embedding near-dedup over a robust-pruned flat graph.

1. Equal vectors are one node with a count; vectors that are null, zero or hold null or non-finite
   components link with nothing.
2. Centroids come from spherical k-means on a bounded, hash-ordered sample (SAMPLE vectors, at most
   SAMPLE_BYTES). Each node belongs to the shards of its OVERLAP nearest centroids; the nearest is its
   home. Shards over MAX_SHARD nodes are dealt to parts.
3. Within its home each node joins the ball of a leader so near (BALL, half of the linking angle) that
   all members of a ball are linked, or leads one itself. A large group of near copies so shrinks to a
   few leaders, and links inside balls are counts; nothing in such a group is compared with all of it.
   Balls of different parts meet in further rounds, until they no longer get fewer.
4. Each part builds a graph over leaders by insertion: a walk from the entry, robust pruning with slack
   ALPHA among the nodes that the walk reached, and edges back. The adjacency lists of a leader over
   all its shards are united into one flat graph.
5. Each leader searches the part of the flat graph around its home: that shard's leaders and the
   neighbours that their united lists name in other shards. A greedy walk from the medoid comes
   first, then the range is expanded through all leaders whose balls may hold linked nodes.
6. Found pairs of leaders are verified by the double-precision cosine; where balls have members, angles
   to the leaders decide, or the members are compared where those leave it open.

The audit compares the links of sampled vectors with brute force over all of them and gives the mean
share of a vector's links that was found, over sampled vectors that have any, so that vectors with one
link count as much as those of a large group. All that is counted as a link is one (verified, or by the
triangle inequality of angles), so the share of the number is the share of the links themselves. The sample
grows until AUDIT vectors with links are in it, up to MOST_AUDIT vectors; where none of them has a link, nothing
was measured and audit_recall is null. deduplicated() doubles OVERLAP
until the audit reaches LEAST_RECALL; where MOST_OVERLAP does not reach it, all vectors are compared with
all, which is exact and quadratic.

Defined cases: an empty table gives an empty result; rows without a vec_id take part only as copies;
repeated rows are copies of each other; vectors of different lengths never link; very long vectors are
taken in smaller samples and batches; ties go to the smaller id; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored
from .components import components

COSINE = 0.9
#: Nodes a shard is to have and may have, shards of a node, vectors that centroids are fitted on, and bytes.
SHARD, MAX_SHARD, OVERLAP, SAMPLE, SAMPLE_BYTES, MAX_CENTROIDS = 1000, 3000, 2, 20_000, 64 << 20, 4096
#: Candidates and edges of a node, pruning slack, steps of the greedy walk, slack of the range, nodes
#: inserted and searched at a time, rounds in which balls meet.
POOL, DEGREE, ALPHA, WALK, SLACK, BATCH, QUERY_BLOCK, BALL_ROUNDS = 48, 24, 1.2, 32, 0.1, 64, 128, 4
#: The linking angle; a ball's radius, with a margin for rounding; similarity of what was not reached.
MARGIN = 1e-6
THETA = float(np.arccos(COSINE))
BALL, UNSEEN = THETA / 2 - MARGIN, -9.0
AUDIT, MOST_AUDIT, LEAST_RECALL, MOST_OVERLAP = 200, 4000, 0.95, 8
#: Bytes of unit vectors that all others are compared with at a time, where all pairs are compared.
BLOCK_BYTES = 32 << 20


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, unit): the unit vector's doubles, null where a vector cannot link."""
    for batch in batches:
        dims, units = [], []
        for value in batch.column(1).to_pylist():
            v = np.array([np.nan if x is None else x for x in value], np.float64) if value else np.empty(0)
            # Scaled first, so that very large and very small components neither overflow nor vanish.
            top = np.abs(v).max() if len(v) else 0.0
            good = bool(np.isfinite(top) and top > 0)
            if good:
                v = v / top
                v = v / np.sqrt(v @ v)
            dims.append(len(v) if good else 0)
            units.append((v + 0.0).tobytes() if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int64()), pa.array(units, pa.binary())], names=["vec_id", "dim", "unit"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = [np.frombuffer(v, np.float64) for v in column.to_pylist()]
    return np.stack(rows) if rows else np.empty((0, 1))


def centroids_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means; the first rows of the sample, which is in hash order, are the seeds."""
    centers = sample[:count]
    for _ in range(8):
        nearest = np.concatenate([(part @ centers.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 2000))])
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, sample)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centers = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centers)
    return centers


def _assigned(centers_of, overlap: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = centers_of.value
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_matrix(batch.column(1)) @ centers.T), axis=1, kind="stable")[:, :overlap]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "shards"])

    return run


class Graph:
    """A flat graph over rows of unit vectors that grows by insertion. Out-edges are robust-pruned among
    the nodes that a walk has reached; nothing is compared that no walk reaches."""

    def __init__(self, unit: np.ndarray) -> None:
        self.unit = unit
        self.edges = np.full((len(unit), DEGREE), -1)
        self.near = np.full((len(unit), DEGREE), 2.0)  # similarity of each edge; 2: none
        self.entry = -1

    def walk(self, queries: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
        """Similarities of queries x nodes, UNSEEN where a walk has not come: greedy from the medoid, then
        the range is expanded through all nodes of similarity low (queries x nodes) or more."""
        q = len(queries)
        sim, done, rows = np.full((q, len(self.unit)), UNSEEN), np.zeros((q, len(self.unit)), bool), np.arange(q)
        sim[:, self.entry] = queries @ self.unit[self.entry]
        for _ in range(WALK):
            open_ = np.where(done, UNSEEN, sim)
            best = open_.argmax(1)
            live = open_[rows, best] > UNSEEN
            if not live.any():
                break
            done[rows[live], best[live]] = True
            self._reach(queries, sim, rows[live], best[live])
        while low is not None:
            who, where = np.nonzero(~done & (sim >= low))
            if not len(who):
                break
            done[who, where] = True
            for a in range(0, len(who), 4096):
                self._reach(queries, sim, who[a : a + 4096], where[a : a + 4096])
        return sim

    def _reach(self, queries: np.ndarray, sim: np.ndarray, who: np.ndarray, where: np.ndarray) -> None:
        ends = self.edges[where]
        flat = (who[:, None] * sim.shape[1] + ends)[ends >= 0]
        flat = np.unique(flat[sim.ravel()[flat] == UNSEEN])
        i, j = np.divmod(flat, sim.shape[1])
        sim[i, j] = np.einsum("md,md->m", queries[i], self.unit[j])

    def insert(self, nodes: np.ndarray, sim: np.ndarray) -> None:
        """Insert nodes whose similarities to the graph, as far as a walk came, are in sim."""
        if self.entry < 0:
            self.entry = int(nodes[0])
        sim = sim.copy()
        sim[:, nodes] = self.unit[nodes] @ self.unit[nodes].T  # one batch: these are compared with each other
        sim[np.arange(len(nodes)), nodes] = UNSEEN
        size = min(POOL, sim.shape[1])
        pool = np.argpartition(-sim, size - 1, axis=1)[:, :size]
        near = np.take_along_axis(sim, pool, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        pool, near = np.take_along_axis(pool, order, 1), np.take_along_axis(near, order, 1)
        between = np.einsum("mpd,mqd->mpq", self.unit[pool], self.unit[pool])
        alive, rows = near > UNSEEN, np.arange(len(nodes))
        for k in range(DEGREE // 2):  # the other half is for edges that come back
            left = alive.any(1)
            if not left.any():
                break
            pick = alive.argmax(1)
            some = rows[left]
            self.edges[nodes[some], k], self.near[nodes[some], k] = pool[some, pick[some]], near[some, pick[some]]
            alive &= ~(ALPHA * (1 - between[rows, pick]) <= 1 - near)
            alive[rows, pick] = False
        for i in nodes.tolist():
            for j, s in zip(self.edges[i].tolist(), self.near[i].tolist(), strict=True):
                if j >= 0 and i not in self.edges[j]:
                    # A free place, or that of the least similar edge if this one is nearer.
                    at = int(self.near[j].argmax()) if self.near[j].max() > 1.5 else int(self.near[j].argmin())
                    if self.near[j, at] > 1.5 or self.near[j, at] < s:
                        self.edges[j, at], self.near[j, at] = i, s


def _ordered(rows: pa.Table, *names: str) -> list[np.ndarray]:
    """Ids, units and further columns in an order that says nothing about the vectors."""
    ids = np.asarray(rows.column("id"))
    order = np.lexsort((ids, (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)))
    return [ids[order], _matrix(rows.column("unit"))[order], *(np.asarray(rows.column(n))[order] for n in names)]


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _balls(rows: pa.Table) -> pa.Table:
    """(id, leader, beta): each node joins the ball of a leader so near that all members of a ball are
    within COSINE of each other, or leads a ball itself. beta is the angle to the leader; a node that comes
    with a ball of its own brings that ball's radius."""
    ids, unit, radius = _ordered(rows, "radius")
    graph, leader, beta = Graph(unit), np.arange(len(ids)), np.zeros(len(ids))
    for a in range(0, len(ids), BATCH):
        batch = np.arange(a, min(a + BATCH, len(ids)))
        sim = graph.walk(unit[batch]) if graph.entry >= 0 else np.full((len(batch), len(ids)), UNSEEN)
        best = sim.argmax(1)
        far = angle(sim[np.arange(len(batch)), best]) + radius[batch]
        joins = (sim.max(1) > UNSEEN) & (far <= BALL)
        leader[batch[joins]], beta[batch[joins]] = best[joins], far[joins]
        new: list[int] = []
        for i in batch[~joins].tolist():
            if new:
                own = angle(unit[new] @ unit[i]) + radius[i]
                k = int(own.argmin())
                if own[k] <= BALL:
                    leader[i], beta[i] = new[k], own[k]
                    continue
            new.append(i)
        if new:
            graph.insert(np.array(new), sim[np.array(new) - a])
    return pa.table({"id": pa.array(ids), "leader": pa.array(ids[leader]), "beta": pa.array(np.maximum(beta, radius))})


def _adjacency(rows: pa.Table) -> pa.Table:
    """(id, neighbours) within one part."""
    ids, unit = _ordered(rows)
    graph = Graph(unit)
    for a in range(0, len(ids), BATCH):
        batch = np.arange(a, min(a + BATCH, len(ids)))
        graph.insert(batch, graph.walk(unit[batch]) if graph.entry >= 0 else np.full((len(batch), len(ids)), UNSEEN))
    lists = [ids[e[e >= 0]] for e in graph.edges]
    return pa.table({"id": pa.array(ids), "neighbours": pa.array(lists, pa.list_(pa.int64()))})


def _ranges(rows: pa.Table) -> pa.Table:
    """(a, b, cosine): pairs of leaders whose balls may hold linked nodes, as far as the walks come."""
    asks = np.asarray(rows.column("asks"))
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
    if not asks.any() or asks.all():
        return none
    nodes = rows.filter(pa.array(~asks)).sort_by("id").combine_chunks()
    ids, unit, beta = np.asarray(nodes.column("id")), _matrix(nodes.column("unit")), np.asarray(nodes.column("beta"))
    graph = Graph(unit)
    # United lists, as far as their ends are here: members of the part and the neighbours it brought.
    lists = nodes.column("neighbours").combine_chunks()
    source, target = np.repeat(np.arange(len(ids)), np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten())
    place = np.minimum(np.searchsorted(ids, target), len(ids) - 1)
    here = ids[place] == target
    source, place = source[here], place[here]
    width = int(np.bincount(source, minlength=len(ids)).max()) if len(source) else 1
    graph.edges = np.full((len(ids), max(1, width)), -1)
    graph.edges[source, np.arange(len(source)) - np.searchsorted(source, np.arange(len(ids)))[source]] = place
    graph.entry = int((unit @ unit.mean(0)).argmax())
    asking = rows.filter(pa.array(asks))
    q_ids, q_unit, q_beta = np.asarray(asking.column("id")), _matrix(asking.column("unit")), np.asarray(asking.column("beta"))
    found = []
    for a in range(0, len(q_ids), QUERY_BLOCK):
        block = slice(a, a + QUERY_BLOCK)
        low = np.cos(np.minimum(np.pi, THETA + q_beta[block, None] + beta[None, :]))
        sim = graph.walk(q_unit[block], low - SLACK)
        who, where = np.nonzero((sim >= low - 1e-9) & (q_ids[block, None] != ids[None, :]))
        x, y = q_ids[block][who], ids[where]
        found.append((np.minimum(x, y), np.maximum(x, y), sim[who, where]))
    a, b, cosine = (np.concatenate(f) for f in zip(*found, strict=True))
    return pa.table({"a": pa.array(a), "b": pa.array(b), "cosine": pa.array(cosine)})


def _forest(rows: np.ndarray) -> pa.Table:
    """Sum the links; of the edges (id, root) keep a spanning forest."""
    ids, inverse = np.unique(rows[:, [0, 2]].ravel(), return_inverse=True)
    a, b = inverse.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, rows[:, 1])
    return pa.table({"id": pa.array(ids), "links": pa.array(links), "root": pa.array(ids[label])})


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with their node's keys, and the nodes (id, n, unit, dim)."""
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = named.mapInArrow(_units, "vec_id long, dim long, unit binary").withColumns({"k1": F.xxhash64("unit"), "k2": F.xxhash64(F.lit(7), "unit")})
    units = stored(units, "units")
    nodes = units.where("unit is not null and vec_id is not null").groupBy("k1", "k2", "dim").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"))
    return units, stored(nodes, "nodes")


def _linked(nodes: DataFrame, overlap: int) -> DataFrame:
    """(id, links, root) rows over all shards of nodes of one length."""
    spark = nodes.sparkSession
    count = nodes.count()
    # Shards keep their size up to MAX_CENTROIDS of them; beyond that, larger ones are dealt to parts.
    wanted = min(MAX_CENTROIDS, max(1, count // SHARD))
    width = nodes.select(F.octet_length("unit").alias("w")).first()["w"]
    drawn = min(SAMPLE, max(64, SAMPLE_BYTES // max(1, width)))
    sample = _matrix(nodes.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(drawn).select("unit").toArrow().column(0))
    centers_of = spark.sparkContext.broadcast(centroids_of(sample, min(wanted, len(sample))))
    overlap = min(overlap, len(centers_of.value))
    placed = stored(nodes.select("id", "unit", "n").mapInArrow(_assigned(centers_of, overlap), "id long, unit binary, n long, shards array<int>"), "placed")
    return _searched(placed)


def _in_parts(rows: DataFrame, shard: str, salt: str) -> DataFrame:
    """rows with the number of parts of their shard and their own part."""
    sizes = rows.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / MAX_SHARD).cast("int").alias("parts"))
    # At most MAX_CENTROIDS rows, or one for each length of few nodes.
    return rows.join(F.broadcast(sizes), shard).withColumn("part", F.pmod(F.xxhash64("id", F.lit(salt)), F.col("parts")).cast("int"))


def _collapsed(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaders (id, unit, shards, radius, weight) and the members (id, n, unit, leader)."""
    leaders = placed.select("id", "unit", "shards", F.lit(0.0).alias("radius"))
    lead = placed.select("id", F.col("id").alias("leader"))
    count = None
    for turn in range(BALL_ROUNDS):
        homes = _in_parts(leaders.withColumn("home", F.col("shards")[0]), "home", f"ball{turn}")
        found = stored(homes.groupBy("home", "part").applyInArrow(_balls, "id long, leader long, beta double"), "balls")
        radius = found.groupBy("leader").agg(F.max("beta").alias("radius"))
        leaders = stored(leaders.drop("radius").join(radius.withColumnRenamed("leader", "id"), "id"), "leaders")
        lead = stored(lead.join(found.select(F.col("id").alias("leader"), F.col("leader").alias("__up")), "leader").select("id", F.col("__up").alias("leader")), "lead")
        before, count = count, leaders.count()
        if homes.where("parts > 1").isEmpty() or (before is not None and count > 0.9 * before):
            break
    members = stored(placed.select("id", "n", "unit").join(lead, "id"), "members")
    weight = members.groupBy("leader").agg(F.sum("n").alias("weight"))
    return stored(leaders.join(weight.withColumnRenamed("leader", "id"), "id"), "leaders"), members


def _searched(placed: DataFrame) -> DataFrame:
    """(id, links, root) rows over the shards of nodes (id, unit, n, shards)."""
    leaders, members = _collapsed(placed)
    spread = stored(_in_parts(leaders.select("id", "unit", "radius", F.explode("shards").alias("shard")), "shard", "part"), "spread")
    lists = spread.groupBy("shard", "part").applyInArrow(_adjacency, "id long, neighbours array<long>")
    united = stored(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")), "united")
    # Around each part: the neighbours that its leaders' united lists name elsewhere.
    own = spread.select("shard", "part", "parts", "id")
    beside = own.join(united, "id").select("shard", "part", "parts", F.explode("neighbours").alias("id")).distinct().join(own, ["shard", "part", "id"], "left_anti")
    nodes = own.unionByName(beside).join(leaders.select("id", "unit", F.col("radius").alias("beta")), "id").join(united, "id")
    nodes = nodes.select("shard", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("asking"), "id", "unit", "beta", "neighbours", F.lit(False).alias("asks"))
    homes = leaders.select("id", "unit", F.col("radius").alias("beta"), F.col("shards")[0].alias("shard")).join(own.select("id", "shard", "parts", F.col("part").alias("asking")), ["id", "shard"])
    asks = homes.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "asking", "id", "unit", "beta", F.array().cast("array<long>").alias("neighbours"), F.lit(True).alias("asks"))
    ranges = nodes.unionByName(asks).groupBy("shard", "part", "asking").applyInArrow(_ranges, "a long, b long, cosine double")
    pairs = ranges.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    ball = lambda c: leaders.select(F.col("id").alias(c), F.col("radius").alias(f"r{c}"), F.col("weight").alias(f"w{c}"))
    pairs = pairs.join(ball("a"), "a").join(ball("b"), "b")
    single = (F.col("ra") == 0) & (F.col("rb") == 0)
    sure = F.when(single, F.col("cosine") >= COSINE).otherwise(F.acos(F.least(F.col("cosine"), F.lit(1.0))) + F.col("ra") + F.col("rb") <= THETA - MARGIN)
    pairs = stored(pairs.select("a", "b", "wa", "wb", sure.alias("sure"), (~single & ~sure).alias("open")), "ranges")
    linked = pairs.where("sure")
    gained = linked.select(F.col("a").alias("leader"), F.col("wb").alias("w")).unionByName(linked.select(F.col("b").alias("leader"), F.col("wa").alias("w"))).groupBy("leader").agg(F.sum("w").alias("gained"))
    inside = members.join(leaders.select(F.col("id").alias("leader"), "weight"), "leader").join(gained, "leader", "left")
    rows = inside.select("id", (F.col("weight") - F.col("n") + F.coalesce("gained", F.lit(0))).alias("links"), F.col("leader").alias("root"))
    side = lambda c: members.select(F.col("leader").alias(c), F.col("id").alias(f"id{c}"), F.col("n").alias(f"n{c}"), F.col("unit").alias(f"u{c}"))
    met = stored(pairs.where("open").select("a", "b").join(side("a"), "a").join(side("b"), "b").select("ida", "na", "ua", "idb", "nb", "ub").mapInArrow(_near, "ida long, na long, idb long, nb long"), "met")
    rows = rows.unionByName(linked.select(F.col("a").alias("id"), F.lit(0).cast("long").alias("links"), F.col("b").alias("root")))
    return rows.unionByName(met.select(F.col("ida").alias("id"), F.col("nb").alias("links"), F.col("idb").alias("root"))).unionByName(met.select(F.col("idb").alias("id"), F.col("na").alias("links"), F.col("ida").alias("root")))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of members whose cosine is COSINE or more."""
    for batch in batches:
        for part in (batch.slice(a, 2000) for a in range(0, batch.num_rows, 2000)):
            near = np.einsum("md,md->m", _matrix(part.column(2)), _matrix(part.column(5))) >= COSINE
            yield part.filter(pa.array(near)).select([0, 1, 3, 4])


def _by_dim(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, weights and unit vectors of (id, dim, n, unit) by length."""
    ids, dims, weight = (np.asarray(rows.column(i)) for i in range(3))
    return {int(d): (ids[dims == d], weight[dims == d], _matrix(rows.column(3).filter(pa.array(dims == d)))) for d in np.unique(dims)}


def audit_sample(nodes: DataFrame) -> dict[int, int]:
    """The true number of links of sampled nodes that have any, by brute force over all nodes."""
    spark = nodes.sparkSession
    drawn = nodes.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(MOST_AUDIT).select("id", "dim", "n", "unit").toArrow()
    found: dict[int, int] = {}
    at, size = 0, AUDIT
    while at < drawn.num_rows and len(found) < AUDIT:
        asked_of = spark.sparkContext.broadcast(_by_dim(drawn.slice(at, size)))

        def count(batches: Iterator[pa.RecordBatch], asked_of=asked_of) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            totals: dict[int, int] = {}
            for batch in batches:
                own, dim, weight = (np.asarray(batch.column(i)) for i in range(3))
                for d, (asked_ids, _, asked_units) in asked_of.value.items():
                    mine = np.flatnonzero(dim == d)
                    units = _matrix(batch.column(3).take(pa.array(mine)))
                    for a in range(0, len(asked_ids) if len(mine) else 0, 250):
                        ids = asked_ids[a : a + 250]
                        near = (asked_units[a : a + 250] @ units.T >= COSINE) & (ids[:, None] != own[mine][None, :])
                        for i, k in zip(ids.tolist(), (near @ weight[mine]).tolist(), strict=True):
                            totals[i] = totals.get(i, 0) + int(k)
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["id", "wanted"])

        wanted = nodes.select("id", "dim", "n", "unit").mapInArrow(count, "id long, wanted long").groupBy("id").agg(F.sum("wanted").alias("wanted"))
        found |= {r["id"]: r["wanted"] for r in wanted.where("wanted > 0").collect()}
        at, size = at + size, 5 * AUDIT
    return found


def recall_of(wanted: dict[int, int], links: DataFrame) -> float | None:
    """Mean share of the links of sampled nodes that (id, links) holds; None where no sampled node has one,
    as nothing was measured then."""
    if not wanted:
        return None
    got = {r["id"]: r["links"] for r in links.where(F.col("id").isin(*wanted)).collect()}
    return sum(min(1.0, got.get(i, 0) / n) for i, n in wanted.items()) / len(wanted)


def _against(block_of):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, dim = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            rows = [np.stack([own, np.zeros(len(own), np.int64), own], axis=1)]
            for d, (ids, weight, unit) in block_of.value.items():
                mine = np.flatnonzero(dim == d)
                units = _matrix(batch.column(2).take(pa.array(mine)))
                for a in range(0, len(mine), 500):
                    these = own[mine[a : a + 500]]
                    for b in range(0, len(ids), 3000):
                        those = ids[b : b + 3000]
                        linked = (units[a : a + 500] @ unit[b : b + 3000].T >= COSINE) & (these[:, None] != those[None, :])
                        who, whom = np.nonzero(linked)
                        if not len(who):
                            continue
                        # Rows of one query are in order of whom: its first neighbour holds the others together.
                        first = whom[np.searchsorted(who, who)]
                        x, y = np.divmod(np.unique(whom * len(those) + first), len(those))
                        some, at = np.unique(who, return_index=True)
                        rows.append(np.stack([these[some], (linked[some] @ weight[b : b + 3000]).astype(np.int64), those[whom[at]]], axis=1))
                        rows.append(np.stack([those[x], np.zeros(len(x), np.int64), those[y]], axis=1))
            if len(own):
                yield from _forest(np.concatenate(rows)).to_batches()

    return run


def exact(nodes: DataFrame) -> DataFrame:
    """(id, links, root) rows by comparing all nodes with all: each block of them goes to every task."""
    spark = nodes.sparkSession
    size = nodes.agg(F.sum(F.octet_length("unit"))).first()[0] or 0
    blocks, found = max(1, -(-size // BLOCK_BYTES)), None
    for k in range(blocks):
        block = nodes.where(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)) == k).select("id", "dim", "n", "unit").toArrow()
        block_of = spark.sparkContext.broadcast(_by_dim(block))
        part = stored(nodes.select("id", "dim", "unit").mapInArrow(_against(block_of), "id long, links long, root long"), "exact")
        block_of.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def deduplicated(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) for each row of (vec_id, embedding)."""
    units, nodes = _nodes(vectors)
    # Lengths of so few nodes that they are one shard run together, the length being the shard's key.
    # The others, each of 2 * SHARD nodes or more, have centroids of their own.
    lengths = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("count"))
    large = [r["dim"] for r in lengths.where(F.col("count") >= 2 * SHARD).orderBy("dim").collect()]
    small = None
    if not lengths.where(F.col("count") < 2 * SHARD).isEmpty():
        small = stored(nodes.where(~F.col("dim").isin(large)).select("id", "unit", "n", F.array(F.col("dim").cast("int")).alias("shards")), "placed")
    overlap, wanted = OVERLAP, audit_sample(nodes)
    while True:
        if overlap <= MOST_OVERLAP:
            parts = [_linked(nodes.where(F.col("dim") == d), overlap) for d in large] + ([_searched(small)] if small is not None else [])
            found = parts[0] if parts else nodes.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("root")).limit(0)
            for more in parts[1:]:
                found = found.unionByName(more)
        else:
            found = exact(nodes)
        found = stored(found, "found")
        links = stored(found.groupBy("id").agg(F.sum("links").alias("links")), "counts")
        recall = recall_of(wanted, links)
        if recall is None or recall >= LEAST_RECALL or overlap > MOST_OVERLAP:
            break
        overlap *= 2
    joined = components(found.where("root <> id"), "id", "root")
    by_node = nodes.select("k1", "k2", "dim", "id", "n").join(links, "id", "left").join(joined, "id", "left")
    by_node = by_node.select("k1", "k2", "dim", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("__links"), F.coalesce("component", "id").alias("__component"))
    rows = units.select("vec_id", "dim", "k1", "k2").join(by_node, ["k1", "k2", "dim"], "left")
    component = F.coalesce("__component", "vec_id")
    return rows.select(
        "vec_id", F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audit_recall")
    )
