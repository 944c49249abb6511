"""NN-descent, SimHash and components against brute force."""

import random

import numpy as np
import xxhash

from kestrel.llm import graph, nn_descent, queries, simhash
from tests.conftest import SF001
from tests.llm import edges


def united(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(rnd.randint(100, 300), rnd.randint(100, 300)) for _ in range(130)] + [(7, 7), (1, 0)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == united(nodes, [(a, b) for a, b in links if a != b])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_simhash(text, shingle=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_equals_definition():
    for t in ["", None, "One", "a b c", "A a\nÀ à  b\tC d e f", "x\x1cy z\xa0w é" * 9, *[r[1] for r in edges.rows()[:6]]]:
        assert simhash.fingerprint(t) % (1 << 64) == slow_simhash(t)


def test_fingerprints_do_not_depend_on_slices(monkeypatch):
    texts = ["", "one", " ".join(f"w{i * i % 97}" for i in range(400)), edges.LONG]
    want = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert [simhash.fingerprint(t) for t in texts] == want


def test_masks_cover_every_pair_within_the_radius():
    rnd, all_masks = random.Random(5), simhash.masks(4)
    assert len(all_masks) == 31
    for _ in range(3000):
        bits = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(m % (1 << 64) & bits == 0 for m in all_masks)


def test_simhash_links_like_brute_force(spark):
    rnd = random.Random(9)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    dense = rnd.getrandbits(64)                      # a large group of near ones
    fps |= {dense ^ sum(1 << rnd.randrange(64) for _ in range(2)) for _ in range(400)}
    base = rnd.getrandbits(64)                       # a chain of links just in reach
    for _ in range(12):
        fps.add(base)
        base ^= sum(1 << b for b in rnd.sample(range(64), 4))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    near = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 4]
    got = {r["fp"]: r["component"] for r in simhash.link(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert {f: got.get(f, f) for f in signed} == united(signed, near)


def test_simhash_query(spark):
    got = {r["doc_id"]: r for r in queries.op8_simhash_covering(spark, SF001).collect()}
    fps = {r["doc_id"]: slow_simhash(r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    near = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4]
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {d: r["component_id"] for d, r in got.items()} == united(fps, near)


def test_simhash_edges(spark):
    docs = edges.docs(spark)
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(edges.rows())
    assert {r["component_id"] for r in out if r["fingerprint"] == "0" * 16} == {0}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] is None for r in kept.collect())[-1:] == [True]
    assert sum(r["doc_id"] == 4 for r in kept.collect()) == 1 and kept.where("doc_id in (1, 2, 5)").count() == 0
    assert simhash.near_duplicates(edges.empty(spark)).count() == 0 == simhash.keep_one(edges.empty(spark)).count()


def brute(rows, threshold=0.93):
    ok = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v):
            ok.append(i)
    unit = {i: np.array(rows[i][1], "f4").astype("f8") / np.linalg.norm(np.array(rows[i][1], "f4").astype("f8")) for i in ok}
    near = [(a, b) for a in ok for b in ok if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b])
            and unit[a] @ unit[b] >= threshold]
    group = united(range(len(rows)), near)
    least = {}
    for i, g in group.items():
        least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], sum(i in e for e in near), least[group[i]]) for i in range(len(rows)))


SCHEMA = "vec_id long, embedding array<float>, label int, part string, place long"


def test_nn_descent_equals_brute_force(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.standard_normal(16).tolist(), int(i % 3)) for i in range(400)]
    centre = rnd.standard_normal(16)
    rows += [(1000 + i, (centre + 0.05 * rnd.standard_normal(16)).tolist(), 1) for i in range(330)]  # saturated lists
    for j in range(40):
        c = rnd.standard_normal(16)
        rows += [(2000 + 5 * j + i, ((1 + i) * (c + 0.1 * rnd.standard_normal(16))).tolist(), 2) for i in range(4)]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [None] * 16, 1),
             (5004, [float("inf")] + [0.0] * 15, 1), (5005, rows[0][1], None), (5006, rows[0][1][:8], 0), (5007, [], 0),
             rows[0], rows[1000 - 600]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = nn_descent.near_duplicates(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_dense_groups_that_link_are_one_component(spark):
    rnd = np.random.default_rng(8)
    rows = [(i, rnd.standard_normal(64).tolist(), 0) for i in range(1500)]
    for label, cosine, noise in ((0, 0.95, 0.0), (0, 0.95, 0.001), (1, 0.93, 0.004), (1, 0.97, 0.002)):
        a, b = np.linalg.qr(rnd.standard_normal((64, 2)))[0].T
        b = cosine * a + (1 - cosine ** 2) ** 0.5 * b
        for centre in (a, b):
            rows += [(len(rows) + i, (centre + noise * rnd.standard_normal(64)).tolist(), label) for i in range(45)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = nn_descent.near_duplicates(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert sum(r["kept"] for r in got) == 1504


def test_missed_links_are_found_exactly_after_the_last_build(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    rows = [(i, rnd.standard_normal(8).tolist(), i % 2) for i in range(700)]
    for j in range(60):                              # chains of links, some across blocks
        rows += [(700 + 3 * j + i, (np.array(rows[j][1]) + 0.25 * rnd.standard_normal(8)).tolist(), rows[j][2]) for i in range(3)]
    poor = spark.createDataFrame([], "a long, list array<struct<sim float, b long>>")
    monkeypatch.setattr(nn_descent, "neighbour_graph", lambda *args, **named: poor)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = nn_descent.near_duplicates(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert sum(r["n_links"] for r in got) > 100


def test_links_of_an_earlier_build_stay(spark, monkeypatch):
    whole, asked = nn_descent.neighbour_graph, []

    def once(units, size, *args, **named):
        graph = whole(units, size, *args, **named)
        asked.append(size)
        return graph if len(asked) == 1 else graph.limit(0)
    monkeypatch.setattr(nn_descent, "neighbour_graph", once)
    recall = iter([0.5, 1.0])
    monkeypatch.setattr(nn_descent, "audit", lambda *args: next(recall))
    rows = [(i, [1.0, 0.001 * i, float(i // 5)], 0) for i in range(10)]
    got = nn_descent.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert asked == [10, 20]


def test_audit_sample_grows_with_the_table(spark):
    n = 20_000
    df = spark.range(n).selectExpr("id AS vec_id", "array(cast(cos(floor(id / 2) * 2) AS float), "
                                   "cast(sin(floor(id / 2) * 2) AS float)) AS embedding", "cast(floor(id / 2) AS int) AS label")
    units = nn_descent.unit_vectors(df)
    half = units.where("vec_id % 4 < 2").selectExpr("place", "1L AS n")
    assert 0.3 < nn_descent.audit(units, half, vectors=0) < 0.7 and nn_descent.audit(units, half.limit(0), vectors=0) == 0.0


def test_nn_descent_audit_and_empty(spark):
    assert nn_descent.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(i, [1.0, float(i % 2)], 0, "x", 1) for i in range(20)], SCHEMA)
    units = nn_descent.unit_vectors(df)
    none = spark.createDataFrame([], "place long, n long")
    assert nn_descent.audit(units, none) == 0.0


def test_op7_settles_long_chains_of_models(spark):
    """A chunk's copy overlaps the model of the next chunk, 12 times over: every chunk is
    settled, and no cut touches a model that another cut relies on."""
    from kestrel.llm.line_chunks import settled_cuts
    n, rows = 12, []
    for i in range(n):  # seen at the start of text 2i and twice inside text 2i + 2
        rows += [(2 * i, 2 * i, 0, 2, i), (2 * i + 2, 2 * i + 2, 1, 2, i), (2 * i + 1, 2 * i + 1, 0, 2, i)]
    table = spark.createDataFrame(rows, "place long, doc_id long, line int, lines int, h long")
    cuts = settled_cuts(table).collect()
    gone = {(r["place"], k) for r in cuts for k in range(r["line"], r["line"] + r["lines"])}
    kept = {(r["first_place"], k) for r in cuts for k in range(r["first_line"], r["first_line"] + r["lines"])}
    assert not gone & kept
    found = {(p, line): h for p, _, line, _, h in rows}
    assert {found[r["place"], r["line"]] for r in cuts} == set(range(n))
    for place, _, line, lines, h in rows:  # what stays is a model, or holds a line of one
        own = {(place, k) for k in range(line, line + lines)}
        assert own <= gone or own & kept
    assert settled_cuts(table.where("h < 0")).isEmpty()


def test_op7_reads_the_lines_of_settled_models_as_written(spark, monkeypatch):
    """What a round holds back is not joined anew in each of the rounds after it."""
    from kestrel.llm import line_chunks
    touching, plans = line_chunks._touching, []

    def watched(spans, lines, key):
        plans.append(lines._jdf.queryExecution().optimizedPlan().toString())
        return touching(spans, lines, key)
    monkeypatch.setattr(line_chunks, "_touching", watched)
    rows = []
    for i in range(4):
        rows += [(2 * i, 2 * i, 0, 2, i), (2 * i + 2, 2 * i + 2, 1, 2, i), (2 * i + 1, 2 * i + 1, 0, 2, i)]
    table = spark.createDataFrame(rows, "place long, doc_id long, line int, lines int, h long")
    assert line_chunks.settled_cuts(table).count() == 8
    assert len(plans) > 6 and not any("Join" in p for p in plans)


def test_op7_settles_models_that_wait_for_each_other(spark):
    from kestrel.llm.line_chunks import _first_waiting
    chosen = spark.createDataFrame([(1, 5, 0, 2), (2, 6, 0, 2)], "h long, place long, line int, lines int")
    pending = spark.createDataFrame([(1, 6, 1, 2, 5, 0), (2, 5, 1, 2, 6, 0)],
                                    "h long, place long, line int, lines int, first_place long, first_line int")
    assert [r["h"] for r in _first_waiting(chosen, pending).collect()] == [1]
