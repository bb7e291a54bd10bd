"""Nearest neighbours by cosine: a neighbour graph by NN-descent, then greedy graph search.

The graph starts from neighbours within blocks along random directions. In each round every node looks at pairs among
its neighbours and the nodes it is a neighbour of, where one of the two is new, and offers each to the other: joins of
neighbours of neighbours. Nodes keep the nearest ``DEGREE``. A query starts at its own node and expands all open nodes
among its nearest ``BEAM``, round by round, until none is open.

Graph and search compare directions rounded to one byte per component, so that what is joined is small; the nearest
few of a search are compared on the original vectors in double precision. Equal vectors are one node, however many
rows have them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medloom.llm.base import settle

DEGREE = 20
REVERSE = 20
ROUNDS = 6
ENOUGH = 0.1
DIRECTIONS = 2
BLOCK = 128
BEAM = 512
COMPARED = 32
PAIRS_AT_ONCE = 1 << 20


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors in double precision that can be compared.

    Left out are null, empty and zero vectors, those with a null or non-finite component or with a squared length that
    is no positive finite double, rows without an id, and vectors that do not have the most frequent number of
    components (the larger one of equally frequent ones). Of several vectors of one id the least array counts.
    """
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False))).filter(F.coalesce(finite, F.lit(False)))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.filter((norm > 0) & (norm < float("inf")))
    size = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.filter(F.size(v) == (size[0]["d"] if size else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _nodes(rows: DataFrame, members: int) -> DataFrame:
    """One node per different vector: (id, v, members), named by its smallest id, with its smallest ids."""
    order = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= members)
    return first.groupBy("v").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("members"))


def _coded(nodes: DataFrame) -> DataFrame:
    """(id, code): directions, one signed byte per component, the largest one 127."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                x = np.rint(x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8)
                yield pa.record_batch([batch.column("id"), pa.array([row.tobytes() for row in x], pa.binary())], names=["id", "code"])

    return nodes.select("id", "v").mapInArrow(run, "id long, code binary")


def _directions(codes: pa.Array) -> np.ndarray:
    """Unit vectors of the codes."""
    n = len(codes)
    offsets = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + n + 1]
    x = np.frombuffer(codes.buffers()[2], np.int8)[offsets[0] : offsets[-1]].reshape(n, -1).astype(np.float32)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _whole_groups(batches, key: str, shrink: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Rows ordered by ``key``, dealt so that the rows of a key are in one batch; ``shrink`` makes an open batch smaller."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or keys[0] != held[-1].column(key)[-1].as_py()):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
        if shrink and len(held) > 1:
            held = [shrink(pa.Table.from_batches(held).combine_chunks().to_batches()[0])]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _list(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def _nearest(a, b, sim, limit: int, *more):
    """Of offers of b to a the nearest ``limit`` different ones per a, nearest first, ties to the smaller b.

    Of repeated offers the first counts. Gives the different a, how many each has, and the columns kept.
    """
    order = np.lexsort((np.arange(len(a)), b, a))
    a, b = a[order], b[order]
    once = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    order = order[once]
    a, b, sim = a[once], b[once], sim[order]
    by = np.lexsort((b, -sim, a))
    a, b, sim, order = a[by], b[by], sim[by], order[by]
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    kept = rank < limit
    counts = np.diff(np.append(first, len(a)))
    return a[first], np.minimum(counts, limit), b[kept], sim[kept], *[m[order][kept] for m in more]


_OFFERS = "a long, ids array<long>, sims array<float>"


def _offers(a, b, sim, limit: int) -> pa.RecordBatch:
    a, counts, b, sim = _nearest(a, b, sim, limit)
    return pa.record_batch([pa.array(a), _list(b, counts), _list(sim.astype(np.float32), counts)], names=["a", "ids", "sims"])


def _first_offers(codes: DataFrame, size: int, parts: int, degree: int) -> DataFrame:
    """Neighbours within blocks of rows along random directions."""
    found = None
    for k in range(DIRECTIONS):
        direction = np.random.Generator(np.random.PCG64(k)).standard_normal(size).astype(np.float32)

        def place(batches, direction=direction):
            for batch in batches:
                if batch.num_rows:
                    at = pa.array((_directions(batch.column("code")) @ direction).astype(np.float32))
                    yield pa.record_batch([*batch.columns, at], names=["id", "code", "at"])

        def run(batches):
            before: list[pa.RecordBatch] = []
            for batch in batches:
                # The last rows go with the next ones too, so that only a lone row of a task has no neighbour.
                rows = pa.Table.from_batches([*before, batch]).combine_chunks().to_batches()
                for a in range(0, rows[0].num_rows if rows else 0, BLOCK):
                    part = rows[0].slice(max(0, min(a, rows[0].num_rows - BLOCK)), BLOCK)
                    x, ids = _directions(part.column("code")), part.column("id").to_numpy()
                    i, j = np.nonzero(~np.eye(len(ids), dtype=bool))
                    if len(i):
                        yield _offers(ids[i], ids[j], (x @ x.T)[i, j], degree)
                before = [rows[0].slice(max(0, rows[0].num_rows - BLOCK))] if rows else before

        placed = codes.mapInArrow(place, "id long, code binary, at float")
        offers = placed.repartitionByRange(parts, "at", "id").sortWithinPartitions("at", "id").mapInArrow(run, _OFFERS)
        found = offers if found is None else found.unionByName(offers)
    return found


_GRAPH = "a long, code binary, ids array<long>, sims array<float>, fresh array<boolean>"


def _merged(graph: DataFrame, offers: DataFrame, parts: int, degree: int) -> DataFrame:
    """The graph with the nearest of its own neighbours and the offered ones; what was offered is fresh."""

    def flat(batch):
        """Columns of neighbours; rows of the graph come before offers."""
        own = batch.column("code").is_valid().to_numpy(zero_copy_only=False)
        counts = batch.column("ids").value_lengths().to_numpy()
        a = np.repeat(batch.column("a").to_numpy(), counts)
        old = np.repeat(own, counts)
        order = np.argsort(~old, kind="stable")
        return a[order], batch.column("ids").flatten().to_numpy()[order], batch.column("sims").flatten().to_numpy()[order], ~old[order]

    def whole(batch):
        a, counts, ids, sims, fresh = _nearest(*flat(batch)[:3], degree, flat(batch)[3])
        nodes = batch.filter(batch.column("code").is_valid())
        names = nodes.column("a").to_numpy()
        # Nodes without any neighbour yet are not among a.
        full = np.zeros(len(names), np.int64)
        full[np.searchsorted(names, a)] = counts
        return pa.record_batch([nodes.column("a"), nodes.column("code"), _list(ids, full), _list(sims, full), _list(fresh, full)], names=["a", "code", "ids", "sims", "fresh"])

    def shrink(batch):
        """Offers to one node, made one row; a row of the graph stays."""
        own, other = (batch.filter(mask) for mask in (batch.column("code").is_valid(), batch.column("code").is_null()))
        counts = other.column("ids").value_lengths().to_numpy()
        a, counts, ids, sims = _nearest(np.repeat(other.column("a").to_numpy(), counts), other.column("ids").flatten().to_numpy(), other.column("sims").flatten().to_numpy(), 2 * degree)
        less = pa.record_batch([pa.array(a), pa.nulls(len(a), pa.binary()), _list(ids, counts), _list(sims, counts)], names=["a", "code", "ids", "sims"])
        return pa.Table.from_batches([own, less.cast(own.schema)]).combine_chunks().to_batches()[0]

    def run(batches):
        for batch in _whole_groups(batches, "a", shrink):
            yield whole(batch)

    both = graph.select("a", "code", "ids", "sims").unionByName(offers, allowMissingColumns=True)
    return both.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(run, _GRAPH)


def _around(graph: DataFrame, parts: int, turn: int) -> DataFrame:
    """Offers among the neighbours of each node, forwards and backwards, where one of the two is fresh."""
    forward = graph.select(F.col("a").alias("v"), F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("v", F.col("e.ids").alias("u"), F.col("e.fresh").alias("fresh"))
    back = forward.select(F.col("u").alias("v"), F.col("v").alias("u"), "fresh")
    order = Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("v", "u", F.lit(turn)))
    back = back.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= REVERSE).drop("k")
    # A neighbour is offered only what is nearer than its last one.
    last = F.when(F.size("sims") >= DEGREE, F.element_at("sims", -1)).otherwise(F.lit(-2.0)).cast("float")
    about = graph.select(F.col("a").alias("u"), "code", last.alias("last"))
    pairs = forward.unionByName(back).join(about, "u")

    def run(batches):
        for batch in _whole_groups(batches, "v"):
            v, u = batch.column("v").to_numpy(), batch.column("u").to_numpy()
            fresh, last = batch.column("fresh").to_numpy(zero_copy_only=False), batch.column("last").to_numpy()
            order = np.lexsort((~fresh, u, v))
            once = np.concatenate(([True], (v[order][1:] != v[order][:-1]) | (u[order][1:] != u[order][:-1])))
            order = order[once]
            x, v, u, fresh, last = _directions(batch.column("code"))[order], v[order], u[order], fresh[order], last[order]
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            counts = np.diff(np.append(first, len(v)))
            width = int(counts.max())
            step = max(1, PAIRS_AT_ONCE // (width * width))
            for a in range(0, len(first), step):
                n, start = counts[a : a + step], first[a : a + step]
                at = start[:, None] + np.minimum(np.arange(width), n[:, None] - 1)
                real = np.arange(width) < n[:, None]
                y = x[at]
                sim = y @ y.transpose(0, 2, 1)
                good = (fresh[at][:, :, None] | fresh[at][:, None, :]) & real[:, :, None] & real[:, None, :] & ~np.eye(width, dtype=bool)
                good &= sim > last[at][:, :, None]
                g, i, j = np.nonzero(good)
                if len(g):
                    yield _offers(u[at[g, i]], u[at[g, j]], sim[g, i, j], DEGREE)

    return pairs.repartition(parts, "v").sortWithinPartitions("v").mapInArrow(run, _OFFERS)


def neighbour_graph(codes: DataFrame, size: int, parts: int) -> DataFrame:
    """(a, code, ids, sims, fresh): about the nearest ``DEGREE`` nodes of each node, nearest first."""
    # Enough rows in each task for whole blocks.
    ranges = max(1, min(parts, codes.count() // (4 * BLOCK)))
    empty = codes.select(F.col("id").alias("a"), "code", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("sims"))
    graph = settle(_merged(empty, _first_offers(codes, size, ranges, DEGREE), parts, DEGREE))
    for turn in range(ROUNDS):
        # Neighbours kept from before are not fresh any more.
        graph = settle(_merged(graph, _around(graph, parts, turn), parts, DEGREE))
        share = graph.agg(F.avg(F.size(F.filter("fresh", lambda x: x)) / F.lit(float(DEGREE)))).first()[0]
        if not share or share < ENOUGH:
            break
    return graph


_STATE = "q long, code binary, ids array<long>, sims array<float>, done array<boolean>"


def _search(starts: DataFrame, graph: DataFrame, parts: int, beam: int) -> DataFrame:
    """The nearest ``beam`` nodes found for each start: (q, ids, sims), itself first."""
    edges = graph.select("a", F.posexplode("ids").alias("k", "u")).join(graph.select(F.col("a").alias("u"), "code"), "u")
    rows = edges.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("k", "u", "code"))).alias("e"))
    links = settle(rows.select("a", F.col("e.u").alias("ids"), F.array_join(F.transform("e.code", lambda c: F.hex(c)), "").alias("h")).select("a", "ids", F.unhex("h").alias("codes")).repartition(parts, "a"))
    state = starts.select(F.col("a").alias("q"), "code", F.array("a").alias("ids"), F.array(F.lit(2.0).cast("float")).alias("sims"), F.array(F.lit(False)).alias("done"))
    state = settle(state.repartition(parts, "q"))

    def expand(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _directions(batch.column("code"))
            counts = batch.column("ids").value_lengths().to_numpy()
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, batch.column("codes").buffers(), offset=batch.column("codes").offset)
            offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
            y = np.frombuffer(packed.buffers()[2], np.int8)[offsets[0] : offsets[-1]].reshape(-1, x.shape[1]).astype(np.float32)
            row = np.repeat(np.arange(batch.num_rows), counts)
            sims = np.empty(len(y), np.float32)
            for a in range(0, len(y), PAIRS_AT_ONCE // 8):
                part = y[a : a + PAIRS_AT_ONCE // 8]
                sims[a : a + len(part)] = np.einsum("ij,ij->i", part, x[row[a : a + len(part)]]) / np.sqrt((part * part).sum(1))
            near = sims > batch.column("last").to_numpy()[row]
            q = batch.column("q").to_numpy()[row]
            if near.any():
                yield _offers(q[near], batch.column("ids").flatten().to_numpy()[near], sims[near], beam)

    def merge(batches):
        for batch in _whole_groups(batches, "q"):
            own = batch.column("code").is_valid().to_numpy(zero_copy_only=False)
            counts = batch.column("ids").value_lengths().to_numpy()
            q, ids, sims = np.repeat(batch.column("q").to_numpy(), counts), batch.column("ids").flatten().to_numpy(), batch.column("sims").flatten().to_numpy()
            old = np.repeat(own, counts)
            order = np.argsort(~old, kind="stable")  # of a node found again the state's own entry counts, which is done
            q, counts, ids, sims, done = _nearest(q[order], ids[order], sims[order], beam, old[order])
            state = batch.filter(batch.column("code").is_valid())
            yield pa.record_batch([state.column("q"), state.column("code"), _list(ids, counts), _list(sims, counts), _list(done, counts)], names=["q", "code", "ids", "sims", "done"])

    finished = None
    while True:
        # All open nodes of a state are expanded now, so all it has are done after the round.
        last = F.when(F.size("sims") >= beam, F.element_at("sims", -1)).otherwise(F.lit(-2.0)).cast("float")
        open_nodes = F.filter(F.arrays_zip("ids", "done"), lambda e: ~e["done"])
        front = state.select("q", "code", last.alias("last"), F.explode(open_nodes).alias("e")).select("q", "code", "last", F.col("e.ids").alias("a"))
        found = front.repartition(parts, "a").join(links, "a").mapInArrow(expand, _OFFERS).select(F.col("a").alias("q"), "ids", "sims")
        both = state.select("q", "code", "ids", "sims").unionByName(found, allowMissingColumns=True)
        state = settle(both.repartition(parts, "q").sortWithinPartitions("q").mapInArrow(merge, _STATE))
        over = F.forall("done", lambda d: d)
        ended = state.filter(over).select("q", "ids", "sims")
        finished = ended if finished is None else finished.unionByName(ended)
        state = state.filter(~over)
        if state.isEmpty():
            return finished


def nearest(vectors: DataFrame, is_query, k: int = 5, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest vectors found for each query: (query_id, rank, vec_id, score).

    ``vectors`` has vec_id and embedding; rows with ``is_query`` of vec_id are queries. Nearest first, ties to the
    smaller id, the query itself left out; score is the cosine in double precision. With fewer than ``k`` others, all
    of them. What takes no part is told at ``clean``; other columns are ignored; an empty table gives no rows.
    """
    rows = settle(clean(vectors))
    nodes = settle(_nodes(rows, k + 1))
    some = nodes.select("v").first()
    size = len(some["v"]) if some else 1
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    codes = settle(_coded(nodes))
    graph = neighbour_graph(codes, size, parts)
    queries = settle(rows.filter(is_query).join(nodes.select("v", "id"), "v").select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")))
    starts = graph.join(queries.select(F.col("q").alias("a")).distinct(), "a").select("a", "code")
    found = _search(starts, graph, parts, beam)
    close = found.select("q", F.explode(F.slice("ids", 1, max(COMPARED, 4 * k))).alias("id"))
    close = close.join(nodes, "id").join(nodes.select(F.col("id").alias("q"), F.col("v").alias("w")), "q")

    def total(products):
        return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)

    cosine = total(F.zip_with("v", "w", lambda x, y: x * y)) / (F.sqrt(total(F.transform("v", lambda x: x * x))) * F.sqrt(total(F.transform("w", lambda x: x * x))))
    scored = close.select("q", "members", cosine.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A node's members that matter: the nearest of all nodes together, one more for the query itself.
    each = queries.join(scored, "q").select("query_id", F.explode("members").alias("vec_id"), "score").filter("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
