"""Embedding near-duplicates by NN-descent.

Equal vectors of a part are one vector with a weight.  A neighbour graph starts from
windows over sorted random-hyperplane codes and is refined: in each round every
vector's neighbours and reverse neighbours are compared with each other, and each
keeps its best.  Rounds end when few lists change.  Edges at the threshold or above,
checked in double precision, are links.  A list that holds nothing but links is
saturated, and its vector may have more, also outside its component: all members of
the component are compared with all vectors of their part, block by block, and the
links are counted, not listed.  Components that link are merged, and the members
that come in are compared in turn, until nothing changes.A recall audit compares
a sample that grows with the table with all rows; below the wanted recall the graph is
built again with lists of twice the length, and all links found stay.  If the last
build is still below it, all vectors are compared block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import cut
from kestrel.llm.graph import components

THRESHOLD = 0.93
NEIGHBOURS, TABLES, CODE_BITS, WINDOW = 10, 4, 30, 8
MAX_ROUNDS, FEW_CHANGES, TO_CENTRE = 6, 0.005, 6
BLOCK = 512
AUDIT_VECTORS, AUDIT_ONE_IN, WANTED_RECALL, MAX_BUILDS = 1024, 100, 0.98, 3


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``place, vec_id, part, unit, short``: unit vectors in double and single
    precision as bytes, and the part (label and length) they are compared in.

    All three are null for a null label and for vectors that are null, zero or
    hold null or non-finite components.
    """
    rows = vectors.select(
        F.monotonically_increasing_id().alias("place"), "vec_id",
        F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("part"),
        F.when(F.col("label").isNotNull(), F.col("embedding").cast("array<double>")).alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            parts, units, shorts = [], [], []
            for part, v in zip(batch.column(2).to_pylist(), batch.column(3)):
                unit = None
                if v.is_valid and v.values.null_count == 0 and len(v.values):
                    x = v.values.to_numpy()
                    if np.isfinite(x).all() and np.abs(x).max() > 0:
                        x = x / np.abs(x).max()  # no overflow or underflow of the squares
                        unit = x / np.sqrt(x @ x)
                parts.append(None if unit is None else part)
                units.append(None if unit is None else unit.tobytes())
                shorts.append(None if unit is None else unit.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(parts, pa.string()), pa.array(units, pa.binary()),
                 pa.array(shorts, pa.binary())], names=["place", "vec_id", "part", "unit", "short"])
    return rows.mapInArrow(run, f"place long, vec_id {kind}, part string, unit binary, short binary")


def _codes(tables: int, seed: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            shorts, out = batch.column(2).to_pylist(), []
            for s in shorts:
                x = np.frombuffer(s, np.float32)
                if len(x) not in planes:
                    draw = np.random.default_rng([seed, len(x)])
                    planes[len(x)] = draw.standard_normal((tables * CODE_BITS, len(x))).astype(np.float32)
                bits = (planes[len(x)] @ x > 0).reshape(tables, CODE_BITS)
                out.append(bits @ (1 << np.arange(CODE_BITS, dtype=np.int64))[::-1])
            n = batch.num_rows
            row = pa.array(np.repeat(np.arange(n), tables))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(tables), n), pa.int32()), batch.column(0).take(row),
                 batch.column(1).take(row), pa.array(np.concatenate(out) if out else [], pa.int64()),
                 batch.column(2).take(row)], names=["t", "place", "part", "code", "short"])
    return run


def _window_pairs(window: int, keep: int):
    """Over rows sorted by (t, part, code): the best of each row's neighbours in order."""
    def run(batches):
        for batch in batches:
            t, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part = np.array(batch.column(2).to_pylist(), dtype=object)
            start = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (part[1:] != part[:-1])))) if len(t) else []
            a, b, sim = [], [], []
            for s, e in zip(start, [*start[1:], len(t)]):
                x = np.frombuffer(b"".join(batch.column(4).slice(s, e - s).to_pylist()), np.float32).reshape(e - s, -1)
                n = e - s
                score = np.full((n, 2 * window), -2, np.float32)
                other = np.zeros((n, 2 * window), np.int64)
                for k in range(1, min(window, n - 1) + 1):
                    dots = np.einsum("ij,ij->i", x[k:], x[:-k])
                    score[k:, 2 * k - 2] = dots
                    other[k:, 2 * k - 2] = place[s:e - k]
                    score[:-k, 2 * k - 1] = dots
                    other[:-k, 2 * k - 1] = place[s + k:e]
                best = np.argpartition(-score, keep, axis=1)[:, :keep] if keep < 2 * window else np.tile(np.arange(2 * window), (n, 1))
                rows = np.repeat(np.arange(n), best.shape[1])
                cols = best.ravel()
                good = score[rows, cols] > -2
                a.append(place[s:e][rows[good]])
                b.append(other[rows[good], cols[good]])
                sim.append(score[rows[good], cols[good]])
            if a:
                yield _edges(a, b, sim)
    return run


def _edges(a, b, sim) -> pa.RecordBatch:
    join = lambda x, kind: pa.array(np.concatenate(x).astype(kind))
    return pa.RecordBatch.from_arrays([join(a, np.int64), join(b, np.int64), join(sim, np.float32)], names=["a", "b", "sim"])


def _centre_pairs(batches):
    """Over (centre, its neighbours both ways): pairs that better a neighbour's list."""
    for batch in batches:
        a, b, sim = [], [], []
        for members in batch.column(1):
            items = members.values
            place, worst = items.field("b").to_numpy(), items.field("worst").to_numpy()
            x = np.frombuffer(b"".join(items.field("short").to_pylist()), np.float32).reshape(len(place), -1)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            keep = min(TO_CENTRE, len(place) - 1)
            if keep < 1:
                continue
            best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            rows, cols = np.repeat(np.arange(len(place)), keep), best.ravel()
            good = s[rows, cols] > worst[rows]
            a.append(place[rows[good]])
            b.append(place[cols[good]])
            sim.append(s[rows[good], cols[good]])
        if a:
            yield _edges(a, b, sim)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """``a, list``: the k best of each vector's distinct candidates, the best first."""
    best = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return best.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "b")), asc=False), 1, k).alias("list"))


def _listed(graph: DataFrame) -> DataFrame:
    return graph.select("a", F.explode("list").alias("e")).select("a", "e.b", "e.sim")


def neighbour_graph(units: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES, seed: int = 1) -> DataFrame:
    """``a, list<sim, b>``: about the k nearest neighbours of each valid vector of a part."""
    valid = units.where(F.col("unit").isNotNull()).select("place", "part", "short")
    coded = valid.mapInArrow(_codes(tables, seed), "t int, place long, part string, code long, short binary")
    first = (coded.repartitionByRange("t", "part", "code").sortWithinPartitions("t", "part", "code", "place")
             .mapInArrow(_window_pairs(WINDOW, min(k, TO_CENTRE)), "a long, b long, sim float"))
    graph = cut(_best(first, k))
    for _ in range(MAX_ROUNDS):
        edges = _listed(graph)
        near = Window.partitionBy("b").orderBy(F.col("sim").desc(), F.xxhash64("a"))
        back = edges.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).select(F.col("b").alias("a"), F.col("a").alias("b"))
        around = (edges.select("a", "b").unionByName(back)
                  .unionByName(graph.select("a", F.col("a").alias("b"))).distinct())
        worst = graph.select(F.col("a").alias("b"), F.when(F.size("list") < k, F.lit(-2.0))
                             .otherwise(F.element_at("list", -1)["sim"]).cast("float").alias("worst"))
        members = (around.join(worst, "b").join(valid.select(F.col("place").alias("b"), "short"), "b")
                   .groupBy("a").agg(F.collect_list(F.struct("b", "worst", "short")).alias("m")))
        found = members.mapInArrow(_centre_pairs, "a long, b long, sim float")
        better = cut(_best(edges.unionByName(found), k))
        before = F.transform("list", lambda e: e["b"])
        changed = (better.select("a", before.alias("new")).join(graph.select("a", before.alias("old")), "a")
                   .agg(F.sum(F.size(F.array_except("new", "old"))).alias("c"), F.count("*").alias("n")).first())
        graph = better
        if (changed["c"] or 0) <= FEW_CHANGES * k * (changed["n"] or 0):
            break
    return graph


def _checked(edges: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` of the pairs whose cosine in double precision reaches the threshold."""
    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [np.frombuffer(p) @ np.frombuffer(q) >= threshold for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))
    of = lambda end: units.select(F.col("place").alias(end), F.col("unit").alias("unit_" + end))
    return (edges.join(of("a"), "a").join(of("b"), "b").select("a", "b", "unit_a", "unit_b")
            .mapInArrow(run, "a long, b long"))


def _block_links(batches):
    """Over (left, right, threshold): how many links each vector of the left block has in
    the right one, plain and by weight, and the pairs of components that link."""
    for batch in batches:
        a, b, n, w = [], [], [], []
        for left, right, threshold in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
            (place, group, _, x), (other, others, weight, y) = (
                (*(side.values.field(c).to_numpy() for c in ("place", "component", "weight")),
                 np.frombuffer(b"".join(side.values.field("unit").to_pylist())).reshape(len(side), -1)) for side in (left, right))
            near = (x @ y.T >= threshold) & (place[:, None] != other[None, :])
            a += place.tolist()
            b += [None] * len(place)
            n += near.sum(1).tolist()
            w += (near @ weight).tolist()
            rows, cols = np.nonzero(near & (group[:, None] != others[None, :]))
            for one, two in set(zip(group[rows].tolist(), others[cols].tolist())):
                a.append(one)
                b.append(two)
                n.append(None)
                w.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n, w)], names=["a", "b", "n", "w"])


def _compared(members: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """``a, b, n, w``: each of ``members`` against all ``vectors`` of its part, both with
    ``part, place, component, weight, unit``, in blocks of about ``BLOCK``.  Rows without
    ``b`` hold the links of vector ``a`` in a block; the others two components that link."""
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(members, "lefts").join(blocks(vectors, "rights"), "part")
    row = F.struct("place", "component", "weight", "unit")
    at = lambda n: F.pmod(F.xxhash64("place"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(sizes, "part").select("part", at("lefts").alias("i"), each("rights").alias("j"),
                                              F.lit(True).alias("is_left"), row.alias("v"))
    right = vectors.join(sizes, "part").select("part", each("lefts").alias("i"), at("rights").alias("j"),
                                               F.lit(False).alias("is_left"), row.alias("v"))
    pairs = left.unionByName(right).groupBy("part", "i", "j").agg(
        F.collect_list(F.when(F.col("is_left"), F.col("v"))).alias("left"),
        F.collect_list(F.when(~F.col("is_left"), F.col("v"))).alias("right"))
    return (pairs.where((F.size("left") > 0) & (F.size("right") > 0))
            .select("left", "right", F.lit(threshold).alias("threshold"))
            .mapInArrow(_block_links, "a long, b long, n long, w long"))


def _widened(vectors: DataFrame, edges: DataFrame, full: DataFrame, bridges: DataFrame, done: DataFrame,
             threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``star, bridges, done``: the components, the pairs of components found to link, and
    ``place, n, w`` of all members of the components of ``full(place)``, compared with
    all vectors of their part.  What ``bridges`` and ``done`` hold is not done again."""
    while True:
        star = cut(components(edges.unionByName(bridges)))
        placed = (vectors.join(star.withColumnRenamed("node", "place"), "place", "left")
                  .withColumn("component", F.coalesce("component", "place")))
        wide = placed.join(full, "place", "left_semi").select("component").distinct()
        members = cut(placed.join(wide, "component", "left_semi").join(done, "place", "left_anti"))
        if members.isEmpty():
            return star, bridges, done
        found = cut(_compared(members, placed, threshold))
        counts = found.where("b is null").groupBy(F.col("a").alias("place")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        done = cut(done.unionByName(counts))
        more = found.where("b is not null").select("a", "b").distinct()
        if more.isEmpty():
            return star, bridges, done
        bridges = cut(bridges.unionByName(more))


def audit(units: DataFrame, links: DataFrame, threshold: float = THRESHOLD, vectors: int = AUDIT_VECTORS) -> float:
    """The share of the true links of a sample that ``links(place, n)`` has: one valid
    vector in ``AUDIT_ONE_IN`` by hash, and the ``vectors`` of lowest hash.  The sample
    is compared with all rows; a sample without links gives 1."""
    valid = units.where(F.col("unit").isNotNull()).select(
        "place", "part", "unit", F.lit(1).cast("long").alias("weight"), F.lit(0).cast("long").alias("component"))
    mixed = F.xxhash64("place")
    last = valid.select(mixed.alias("h")).orderBy("h").limit(vectors).agg(F.max("h").alias("h")).first()["h"]
    sample = valid.where((mixed <= F.lit(last).cast("long")) | (F.pmod(mixed, F.lit(AUDIT_ONE_IN)) == 0))
    truth = _compared(sample, valid, threshold).groupBy(F.col("a").alias("place")).agg(F.sum("n").alias("truth"))
    r = (truth.join(links, "place", "left")
         .agg(F.sum("truth").alias("t"), F.sum(F.least("truth", F.coalesce("n", F.lit(0)))).alias("f")).first())
    return r["f"] / r["t"] if r["t"] else 1.0


def _links(edges: DataFrame, done: DataFrame, distinct: DataFrame) -> DataFrame:
    """``place, n, w``: the links of each distinct vector, plain and by weight, listed or counted."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    listed = (both.join(distinct.select(F.col("place").alias("b"), "weight"), "b").groupBy(F.col("a").alias("place"))
              .agg(F.count("*").alias("n"), F.sum("weight").alias("w")))
    return done.unionByName(listed.join(done, "place", "left_anti"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding, label)``.

    Vectors are compared within a label and a length.  Null labels and vectors that
    are null, zero or hold null or non-finite components link with nothing.
    Repeated rows are vectors of their own, linked by a cosine of 1; an empty table
    gives no rows; extra columns are left out.
    """
    units = cut(unit_vectors(vectors))
    distinct = cut(units.where(F.col("unit").isNotNull()).groupBy("part", "unit")
                   .agg(F.min("place").alias("place"), F.first("short").alias("short"), F.count("*").alias("weight")))
    vectors = distinct.select("place", "part", "unit", "weight")
    none = units.sparkSession.createDataFrame([], "a long, b long, place long, n long, w long")
    edges, bridges, done = none.select("a", "b"), none.select("a", "b"), none.select("place", "n", "w")
    for build in range(MAX_BUILDS):
        size = k << build
        graph = neighbour_graph(distinct, size, TABLES << build, seed=1 + build)
        near = (_listed(graph).where(F.col("sim") >= threshold - 1e-5)
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        edges = cut(edges.unionByName(_checked(near, distinct, threshold)).distinct())
        full = graph.where((F.size("list") >= size) & (F.element_at("list", size)["sim"] >= threshold - 1e-5))
        star, bridges, done = _widened(vectors, edges, full.select(F.col("a").alias("place")), bridges, done, threshold)
        links = cut(_links(edges, done, distinct))
        if audit(distinct, links, threshold) >= WANTED_RECALL:
            break
    else:
        star, bridges, done = _widened(vectors, edges, vectors.select("place"), bridges, done, threshold)
        links = cut(_links(edges, done, distinct))
    rows = (units.select("place", "vec_id", "part", "unit")
            .join(distinct.select("part", "unit", F.col("place").alias("model"), "weight"), ["part", "unit"], "left")
            .select("place", "vec_id", "weight", F.coalesce("model", "place").alias("model"))
            .join(links.select(F.col("place").alias("model"), "w"), "model", "left")
            .join(star.withColumnRenamed("node", "model"), "model", "left")
            .withColumn("component", F.coalesce("component", "model")))
    lowest = rows.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    n_links = F.coalesce("w", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))
    return (rows.join(lowest, "component")
            .select("vec_id", n_links.alias("n_links"), "component_id",
                    F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")))
