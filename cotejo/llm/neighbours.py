"""Approximate nearest neighbours by largest inner product: a neighbour graph by NN-descent, greedy search over it.

Equal vectors are one node. For the graph, a coordinate is added that gives all nodes the length of the longest, so that
inner products order them as distances do. Random-projection trees, fitted on a bounded sample (``SAMPLE``), deal the
nodes into leaves, whose members meet first; then each round joins neighbours of neighbours in Spark: every node gathers
a few of its neighbours in both directions with their vectors, and these learn of each other. A search starts from a
node's own neighbours and expands the best unexpanded ones of a bounded beam, for a few rounds. Candidates are scored in
blocks of nodes, so vectors move once per block and not once per pair. Final scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cotejo.plans.staging import staged

#: Vectors that the projection trees are fitted on, at most.
SAMPLE = 20_000
TREES = 10
LEAF = 4096
NEIGHBOURS = 40
#: Neighbours of a node that meet in one round, at most.
MEET = 20
#: Rounds of neighbours of neighbours end when fewer than this share of all neighbours are new, and at the latest after these.
SETTLED = 0.002
ROUNDS = 4
BEAM = 100
EXPAND = 40
HOPS = 3
BLOCK = 512

_NODE = "node bigint, vec binary, near binary, sims binary, fresh int"


def _rows(batches: Iterable[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float32).reshape(len(packed), -1)


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k distinct ids of largest similarity; ties to the smaller id."""
    ids, first = np.unique(ids, return_index=True)
    sims = sims[first]
    order = np.lexsort((ids, -sims))[:k]
    return ids[order], sims[order]


def _collected(rows: Iterable[tuple], schema: list[tuple[str, pa.DataType]], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    yield batch()


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors that take part: not null, not zero, all components finite, and as
    long as most vectors are."""
    good = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists(column, lambda x: x != 0)
    rows = vectors.filter(good & F.col(key).isNotNull()).select(
        F.col(key).alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    usual = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "d").first()
    return rows.filter(F.size("embedding") == (usual.d if usual else 0))


def _trees(sample: np.ndarray, leaves: int, trees: int, seed: int) -> list[list]:
    """Projection trees as nested lists: (direction, median, left, right), or the number of a leaf."""
    random = np.random.default_rng(seed)

    def grow(rows: np.ndarray, want: int, counter: list[int]):
        if want <= 1 or len(rows) < 2:
            counter[0] += 1
            return counter[0] - 1
        direction = random.standard_normal(sample.shape[1]).astype(np.float32)
        along = sample[rows] @ direction
        middle = float(np.median(along))
        low, high = rows[along <= middle], rows[along > middle]
        if not len(high):
            counter[0] += 1
            return counter[0] - 1
        return direction, middle, grow(low, want // 2, counter), grow(high, want - want // 2, counter)

    return [grow(np.arange(len(sample)), leaves, [0]) for _ in range(trees)]


def _leaf_of(tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)

    def walk(node, rows: np.ndarray) -> None:
        if isinstance(node, int):
            out[rows] = node
        elif len(rows):
            high = x[rows] @ node[0] > node[1]
            walk(node[2], rows[~high])
            walk(node[3], rows[high])

    walk(tree, np.arange(len(x)))
    return out


def _dealt(df: DataFrame, parts: int, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)


def neighbour_graph(nodes: DataFrame, count: int, k: int = NEIGHBOURS, trees: int = TREES, rounds: int = ROUNDS,
                    seed: int = 1) -> DataFrame:
    """``node, vec, near, sims`` for ``node, vec`` (32-bit floats, packed): up to ``k`` neighbours by inner product, nearest
    first, packed as 64-bit ids and 32-bit floats."""
    spark = nodes.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, 1.1 * SAMPLE / max(count, 1))
    chosen = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(SAMPLE)
    sample = _matrix([bytes(r.vec) for r in chosen.select("vec").collect()]) if count else np.zeros((0, 1), np.float32)
    leaves = max(1, -(-count // LEAF))
    forest = _trees(sample, leaves, trees if leaves > 1 else 1, seed)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec").to_pylist())
            for t, tree in enumerate(forest):
                place = _leaf_of(tree, x) * len(forest) + t
                yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("node"), batch.column("vec")],
                                                 names=["leaf", "node", "vec"])

    few = max(8, k * 5 // 8) if leaves > 1 else k

    def meet_in_leaf(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, group in groupby(_rows(batches, ("leaf", "node", "vec")), lambda r: r[0]):
                while held := list(islice(group, 2 * LEAF)):
                    ids = np.array([r[1] for r in held])
                    x = _matrix([r[2] for r in held])
                    for at in range(0, len(held), 512):
                        sims = x[at:at + 512] @ x.T
                        sims[np.arange(len(sims)), at + np.arange(len(sims))] = -np.inf
                        n = min(few, len(held) - 1)
                        if n < 1:
                            continue
                        top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                        for i, row in enumerate(top):
                            yield int(ids[at + i]), ids[row].tobytes(), sims[i, row].tobytes()
        yield from _collected(rows(), [("node", pa.int64()), ("near", pa.binary()), ("sims", pa.binary())])

    dealt = _dealt(nodes.mapInArrow(deal, "leaf bigint, node bigint, vec binary"), parts, "leaf")
    first = dealt.mapInArrow(meet_in_leaf, "node bigint, near binary, sims binary")
    graph = _merged(nodes, first, k, parts, "graph-0")
    for step in range(rounds):
        graph = _merged(graph, _met(graph, seed + step, parts), k, parts, f"graph-{step + 1}")
        if (graph.agg(F.sum("fresh")).first()[0] or 0) <= SETTLED * k * count:
            break
    return graph


def _merged(nodes: DataFrame, news: DataFrame, k: int, parts: int, name: str) -> DataFrame:
    """The nodes with the best of their neighbours so far and the new ones, and ``fresh``, how many of them are new."""
    old = nodes if "near" in nodes.columns else nodes.withColumns(
        {"near": F.lit(None).cast("binary"), "sims": F.lit(None).cast("binary")})
    both = old.select("node", "vec", "near", "sims").union(
        news.select("node", F.lit(None).cast("binary"), "near", "sims"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for node, group in groupby(_rows(batches, ("node", "vec", "near", "sims")), lambda r: r[0]):
                vec, ids, sims, old = None, [], [], np.zeros(0, np.int64)
                for _, v, near, sim in group:
                    if v is not None:
                        vec, old = v, old if near is None else np.frombuffer(near, np.int64)
                    if near is not None:
                        ids.append(np.frombuffer(near, np.int64))
                        sims.append(np.frombuffer(sim, np.float32))
                if vec is None:
                    continue
                best = _best(np.concatenate(ids), np.concatenate(sims), k) if ids else (np.zeros(0, np.int64),
                                                                                       np.zeros(0, np.float32))
                yield node, vec, best[0].tobytes(), best[1].tobytes(), len(best[0]) - int(np.isin(best[0], old).sum())
        yield from _collected(rows(), [("node", pa.int64()), ("vec", pa.binary()), ("near", pa.binary()),
                                       ("sims", pa.binary()), ("fresh", pa.int32())])

    return staged(_dealt(both, parts, "node").mapInArrow(run, _NODE), name)


def _edges(graph: DataFrame, both_ways: bool) -> DataFrame:
    """``at, other`` for every neighbour of every node, and for the reverse direction, which is ``back``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [np.frombuffer(b, np.int64) for b in batch.column("near").to_pylist()]
            other = np.concatenate([*near, np.zeros(0, np.int64)])
            at = np.repeat(batch.column("node").to_numpy(), [len(n) for n in near])
            back = np.zeros(len(at), bool)
            if both_ways:
                at, other = np.concatenate((at, other)), np.concatenate((other, at))
                back = np.append(back, ~back)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(other), pa.array(back)], names=["at", "other", "back"])

    return graph.select("node", "near").mapInArrow(run, "at bigint, other bigint, back boolean")


def _met(graph: DataFrame, seed: int, parts: int) -> DataFrame:
    """What neighbours of a node learn of each other: ``node, near, sims`` with the gains only."""
    chance = F.xxhash64(F.lit(seed), "at", "other")
    place = F.row_number().over(W.partitionBy("at").orderBy(chance, "other"))
    gathered = _edges(graph, True).withColumn("place", place).filter(F.col("place") <= MEET).select("at", "other")
    worst = F.substring("sims", -4, 4)
    known = graph.select(F.col("node").alias("id"), "vec", worst.alias("worst"), F.octet_length("near").alias("held"))
    gathered = gathered.join(known, gathered.other == known.id).select("at", "other", "vec", "worst", "held")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gains() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for _, group in groupby(_rows(batches, ("at", "other", "vec", "worst", "held")), lambda r: r[0]):
                group = list(group)
                ids, start = np.unique([r[1] for r in group], return_index=True)
                group = [group[i] for i in start]
                x = _matrix([r[2] for r in group])
                floor = np.array([np.frombuffer(r[3], np.float32)[0] if r[4] >= 8 * NEIGHBOURS else -np.inf for r in group])
                sims = x @ x.T
                better = sims > floor[:, None]
                np.fill_diagonal(better, False)
                i, j = np.nonzero(better)
                yield ids[i], ids[j], sims[i, j]

        def rows() -> Iterator[tuple]:
            held, size = [], 0
            for gain in gains():
                held.append(gain)
                size += len(gain[0])
                if size > 500_000:
                    yield from _by_node(held)
                    held, size = [], 0
            if held:
                yield from _by_node(held)

        yield from _collected(rows(), [("node", pa.int64()), ("near", pa.binary()), ("sims", pa.binary())])

    return _dealt(gathered, parts, "at").mapInArrow(run, "node bigint, near binary, sims binary")


def _by_node(gains: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple]:
    """Gains of one task gathered by node, at most ``NEIGHBOURS`` of each."""
    node, other, sims = (np.concatenate(c) for c in zip(*gains))
    order = np.lexsort((-sims, node))
    node, other, sims = node[order], other[order], sims[order]
    bounds = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
    for a, b in zip(bounds, np.append(bounds[1:], len(node))):
        ids, best = _best(other[a:b], sims[a:b], NEIGHBOURS)
        yield int(node[a]), ids.tobytes(), best.astype(np.float32).tobytes()


_BEAM = "query bigint, vec binary, beam binary, scores binary, done binary"


def search(queries: DataFrame, graph: DataFrame, count: int, hops: int = HOPS, expand: int = EXPAND,
           width: int = BEAM) -> DataFrame:
    """``query, beam``: packed node ids, best first, for ``query, vec, start`` (packed ids of the nodes to start from)."""
    spark = queries.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-count // BLOCK))
    block = F.pmod(F.xxhash64("node"), F.lit(blocks))
    nodes = graph.select(block.alias("block"), F.lit(0).alias("kind"), F.col("node").alias("id"), "vec",
                         F.lit(None).cast("binary").alias("ids"), F.lit(0.0).cast("float").alias("floor"))

    def scored(wanted: DataFrame) -> DataFrame:
        """``query, ids, scores`` for ``query, vec, floor, node``: candidates that beat the floor, a row for each block."""
        asked = wanted.groupBy(block.alias("block"), "query", "vec", "floor").agg(F.collect_set("node").alias("ids"))
        asked = asked.select("block", F.lit(1).alias("kind"), F.col("query").alias("id"), "vec", "ids", "floor")
        listed = nodes.withColumn("ids", F.lit(None).cast("array<bigint>"))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for _, group in groupby(_rows(batches, ("block", "kind", "id", "vec", "ids", "floor")), lambda r: r[0]):
                    ids, vecs, order, x = [], [], None, None
                    for _, kind, id_, vec, wanted_, floor in group:
                        if kind == 0:
                            ids.append(id_)
                            vecs.append(vec)
                            continue
                        if order is None:
                            order = np.argsort(ids) if ids else np.zeros(0, np.int64)
                            ids = np.array(ids, np.int64)[order]
                            x = _matrix(vecs)[order] if vecs else np.zeros((0, len(vec) // 4), np.float32)
                        got = np.array(wanted_, np.int64)
                        scores = x[np.searchsorted(ids, got)] @ np.frombuffer(vec, np.float32)
                        keep = scores > floor
                        if keep.any():
                            yield id_, got[keep].tobytes(), scores[keep].astype(np.float32).tobytes()
            yield from _collected(rows(), [("query", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary())])

        return _dealt(listed.union(asked), parts, "block", order=("kind",)).mapInArrow(
            run, "query bigint, ids binary, scores binary")

    def merge(state: DataFrame, found: DataFrame, name: str) -> DataFrame:
        both = state.select("query", "vec", "beam", "scores", "done").union(
            found.select("query", F.lit(None).cast("binary"), "ids", "scores", F.lit(None).cast("binary")))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for query, group in groupby(_rows(batches, ("query", "vec", "beam", "scores", "done")), lambda r: r[0]):
                    vec, done, ids, scores = None, b"", [], []
                    for _, v, i, s, d in group:
                        vec, done = (v, d) if v is not None else (vec, done)
                        ids.append(np.frombuffer(i, np.int64))
                        scores.append(np.frombuffer(s, np.float32))
                    ids, scores = _best(np.concatenate(ids), np.concatenate(scores), width)
                    yield query, vec, ids.tobytes(), scores.tobytes(), done
            yield from _collected(rows(), [("query", pa.int64()), ("vec", pa.binary()), ("beam", pa.binary()),
                                           ("scores", pa.binary()), ("done", pa.binary())])

        return staged(_dealt(both, parts, "query").mapInArrow(run, _BEAM), name)

    begun = queries.select("query", "vec", F.lit(b"").alias("beam"), F.lit(b"").alias("scores"), F.lit(b"").alias("done"))

    def starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b, np.int64) for b in batch.column("start").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(ids)), [len(i) for i in ids]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query").take(at), batch.column("vec").take(at),
                 pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]))], names=["query", "vec", "node"])

    first = queries.select("query", "vec", "start").mapInArrow(starts, "query bigint, vec binary, node bigint")
    state = merge(begun, scored(first.withColumn("floor", F.lit(float("-inf")).cast("float"))), "beam-0")

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the nodes it expands next; they count as done from then on."""
        def rows() -> Iterator[tuple]:
            for query, vec, beam, scores, done in _rows(batches, ("query", "vec", "beam", "scores", "done")):
                ids, old = np.frombuffer(beam, np.int64), np.frombuffer(done, np.int64)
                fresh = ids[~np.isin(ids, old)][:expand]
                yield query, vec, beam, scores, np.concatenate((old, fresh)).tobytes(), fresh.tobytes()
        yield from _collected(rows(), [(n, pa.int64() if n == "query" else pa.binary()) for n in (
            "query", "vec", "beam", "scores", "done", "fresh")])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b, np.int64) for b in batch.column("fresh").to_pylist()]
            scores = [np.frombuffer(b, np.float32) for b in batch.column("scores").to_pylist()]
            floor = np.array([s[-1] if len(s) >= width else -np.inf for s in scores], np.float32)
            at = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
            yield pa.RecordBatch.from_arrays(
                [batch.column("query").take(pa.array(at)), pa.array(floor[at], pa.float32()),
                 pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]))], names=["query", "floor", "at"])

    edges = staged(_limited(_edges(graph, True)), "search-edges")
    for hop in range(hops):
        picked = staged(state.mapInArrow(pick, f"{_BEAM}, fresh binary"), f"picked-{hop}")
        fresh = picked.select("query", "fresh", "scores").mapInArrow(spread, "query bigint, floor float, at bigint")
        wanted = fresh.join(edges, "at").select("query", "floor", F.explode("others").alias("node")).distinct()
        wanted = wanted.join(picked.select("query", "vec"), "query")
        state = merge(picked, scored(wanted), f"beam-{hop + 1}")
    return state.select("query", "beam")


def _limited(edges: DataFrame) -> DataFrame:
    """``at, others``: the neighbours of every node in both directions; of a hub's reverse ones only as many as it has room for
    beside its own, by chance."""
    once = edges.groupBy("at", "other").agg(F.min("back").alias("back"))
    place = F.row_number().over(W.partitionBy("at").orderBy("back", F.xxhash64("at", "other")))
    return (once.withColumn("place", place).filter(F.col("place") <= 2 * NEIGHBOURS)
            .groupBy("at").agg(F.collect_list("other").alias("others")))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every id divisible by ``every``, the ``k`` nearest other rows found.

    Nearest is the largest inner product in double precision, computed on the original vectors; ties go to the smaller id.
    Vectors that are null, zero, hold null or non-finite components or differ in length from most take no part. Ids are
    meant to be unique; null ids take no part, and rows that repeat an id and vector answer as one. With fewer rows than
    ``k + 1`` all others are returned; an empty table gives an empty one. Other columns are not read.
    """
    rows = staged(usable(vectors, key, column).distinct(), "vectors")
    lowest = rows.groupBy("embedding").agg(F.min("vec_id").alias("node"))
    members = staged(rows.join(lowest, "embedding").select("vec_id", "node"), "vector-members")
    longest = rows.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), F.count(F.lit(1))).first()
    bound, count = float(longest[0] or 1.0), int(longest[1])

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("embedding").to_pylist(), float) / bound**0.5
                rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
                full = np.column_stack((x, rest)).astype(np.float32)
                flat = np.column_stack((x, np.zeros(len(x)))).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array([r.tobytes() for r in full], pa.binary()),
                     pa.array([r.tobytes() for r in flat], pa.binary())], names=["node", "vec", "flat"])

    alone = rows.join(members.filter("vec_id = node").select("vec_id"), "vec_id", "left_semi")
    nodes = staged(alone.mapInArrow(packed, "node bigint, vec binary, flat binary"), "vector-nodes")
    graph = neighbour_graph(nodes.select("node", "vec"), count)
    asked = members.filter(F.col("vec_id") % every == 0).select("node").distinct()
    queries = nodes.join(asked, "node").select("node", "flat").join(graph.select("node", "near"), "node").select(
        F.col("node").alias("query"), F.col("flat").alias("vec"), F.col("near").alias("start"))
    found = search(staged(queries, "vector-queries"), graph, count)

    def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query, beam in _rows(batches, ("query", "beam")):
            ids = np.append(np.frombuffer(beam, np.int64)[:2 * k], query)
            ids = np.unique(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query)), pa.array(ids)], names=["qnode", "cnode"])

    pairs = found.mapInArrow(opened, "qnode bigint, cnode bigint")
    vectors_of = rows.join(members.filter("vec_id = node").select("vec_id"), "vec_id", "left_semi")
    left = vectors_of.select(F.col("vec_id").alias("qnode"), F.col("embedding").alias("x"))
    right = vectors_of.select(F.col("vec_id").alias("cnode"), F.col("embedding").alias("y"))
    score = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    pairs = pairs.join(left, "qnode").join(right, "cnode").select("qnode", "cnode", score.alias("score"))
    # Of a node's copies only the k + 1 smallest ids can be among the k nearest.
    turn = F.row_number().over(W.partitionBy("node").orderBy("vec_id"))
    copies = members.withColumn("turn", turn).filter(F.col("turn") <= k + 1).select(F.col("node").alias("cnode"), "vec_id")
    asked = members.filter(F.col("vec_id") % every == 0).select(F.col("node").alias("qnode"), F.col("vec_id").alias("query_id"))
    # Copies of a query node search once; each gets its own list, without itself.
    place = F.row_number().over(W.partitionBy("qnode").orderBy(F.col("score").desc(), "vec_id"))
    short = pairs.join(copies, "cnode").withColumn("place", place).filter(F.col("place") <= k + 1).drop("place", "cnode")
    answers = asked.join(short, "qnode").filter("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
