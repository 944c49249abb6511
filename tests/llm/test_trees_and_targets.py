"""Reply trees, whitening and target-distribution resampling."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import queries, reply_trees, target_sampling, whitening
from tests.conftest import SF001
from tests.llm import edges

TREE = "tree long, node long, parent long, role string, text string, score double, note string"
NASTY = ["", "\\", "\\\\b", "</turn>", "<\\e/turn>", "#### x", "### ### ", "\\### Assistant: </turn> ok", "a:\n### b</turn>\n", "日本</turn>é"]


def brute_paths(rows, branches):
    """Plain walk from each leaf to its root."""
    by = {(r[0], r[1]): r for r in rows}
    out = {}
    inner = {(r[0], r[2]) for r in rows if r[2] is not None and (r[0], r[2]) in by}
    for key in by:
        if key in inner:
            continue
        path, at, seen = [], key, set()
        while at in by and at not in seen:
            seen.add(at)
            path.append(by[at])
            at = (at[0], by[at][2])
        if at in seen:
            continue
        out.setdefault(key[0], []).append((-sum(r[5] or 0 for r in path), key[1], path[::-1]))
    return {(t, leaf): path for t, all_ in out.items() for _, leaf, path in sorted(all_, key=lambda x: x[:2])[:branches]}


@pytest.mark.parametrize("branches", [1, 3, None])
def test_reply_trees_equal_a_walk(spark, branches):
    rnd = random.Random(5)
    rows = []
    for tree in range(12):
        for node in range(rnd.choice([1, 2, 7, 40])):
            parent = None if node == 0 else rnd.choice([node - 1, rnd.randrange(node), 999 if rnd.random() < 0.1 else 0])
            rows.append((tree, node, parent, rnd.choice(["user", "assistant", "as:sist\\ant", None]), rnd.choice([*NASTY, None]),
                         rnd.choice([None, 0.0, 1.0, 2.5]), "x"))
    rows += [(50, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", 1.0, "x") for i in range(300)]   # a deep chain
    rows += [(60, i, 0 if i else None, "user", "s", 0.0, "x") for i in range(200)]                                      # a star
    rows += [(70, 1, 2, "user", "c", 1.0, "x"), (70, 2, 1, "user", "c", 1.0, "x"), (70, 3, 1, "user", "c", 1.0, "x")]   # a cycle
    got = reply_trees.read_back(reply_trees.format_trees(spark.createDataFrame(rows, TREE), branches)).collect()
    want = brute_paths(rows, branches)
    assert {(r["tree"], r["leaf"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        path = [(p[3] or "", p[4] or "") for p in want[r["tree"], r["leaf"]]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == path
        inside = [r["text"][s["start"]:s["end"]] for s in r["spans"]]
        assert [x.replace("\\h", "### ").replace("\\e", "</turn>").replace("\\b", "\\") for x in inside] == [t for _, t in path]
        assert [s["loss"] for s in r["spans"]] == [role == "assistant" for role, _ in path]
        assert r["text"].count("</turn>") == len(path)


def test_reply_trees_edges(spark):
    rows = [(None, 1, None, "user", "a", 1.0, "x"), (None, 2, 1, "assistant", "b", None, "x"), (1, None, None, None, None, None, "x"),
            (1, 4, None, "user", "q", 1.0, "x"), (1, 4, None, "user", "q", 1.0, "x"), (1, 4, None, "user", "low", 0.5, "x")]
    got = {(r["tree"], r["leaf"]): r["text"] for r in reply_trees.format_trees(spark.createDataFrame(rows, TREE), None).collect()}
    assert got == {(None, 2): "### user:\na</turn>\n### assistant:\nb</turn>\n", (1, None): "### :\n</turn>\n",
                   (1, 4): "### user:\nq</turn>\n"}
    assert reply_trees.format_trees(spark.createDataFrame([], TREE)).count() == 0


def test_conversations_equal_plain_python(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF001}/conversations.parquet").collect()]
    rows += [(-7, i, role, "\\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))]
    want = {}
    for c, _, role, text in sorted(rows):
        turns, learnt = want.setdefault(c, ([], []))
        turns.append(f"{role}\n{text}\n")
        if role == "assistant":
            learnt.append(text)

    def sha(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()
    want = {(c, len(t), sha(t), len("".join(a)), sha(a)) for c, (t, a) in want.items()}
    assert {tuple(r)[:5] for r in queries.op11_reply_trees(spark, SF001).collect()} == want
    schema = "conv_id long, turn long, role string, text string, tree string, node string"
    odd = [(1, 1, "user", "x", "", ""), (1, 1, "user", "x", "", ""), (1, None, None, None, "", ""), (None, 2, "assistant", edges.LONG, "", "")]
    got = reply_trees.digests(reply_trees.format_trees(reply_trees.as_tree(spark.createDataFrame(odd, schema)))).collect()
    assert {(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got} == {(1, 3, 0), (None, 1, len(edges.LONG))}


def whitened(rows):
    out = {}
    for r in rows:
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def check_whitening(rows, ids, x, components):
    """Against numpy's eigenvectors of the distinct vectors' covariance."""
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    xc = distinct - sums / n
    values, vectors = np.linalg.eigh(xc.T @ xc / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (x - sums / n) @ vectors[:, :components] / np.sqrt(values[:components])
    got = whitened(rows)
    y = np.array([[got[i][c + 1]["whitened"] for c in range(components)] for i in ids])
    y *= np.sign((y * want).sum(0))
    assert np.abs(y - want).max() < 1e-9
    for i, far in zip(ids, ((n * x - sums) ** 2).sum(1).tolist()):
        assert {(r["n"], r["deviation"]) for r in got[i].values()} == {(n, far)}
    for c in range(components):
        assert abs(got[ids[0]][c + 1]["explained"] / (values[c] / values.sum()) - 1) < 1e-9
    assert all(r["identity_error"] < 1e-9 for r in rows)


def test_whitening_equals_numpy(spark):
    rows = queries.op12_whitening(spark, SF001).collect()
    table = spark.read.parquet(f"{SF001}/embeddings.parquet").collect()
    x = np.floor(256 * np.array([r["embedding"] for r in table], float)).astype(np.int64)
    check_whitening(rows, [r["vec_id"] for r in table], x, 4)


def test_whitening_edges(spark):
    rng, schema = np.random.default_rng(1), "vec_id long, embedding array<double>, label int, x int"
    good = rng.standard_normal((40, 6)).tolist()
    odd = [(100, None), (101, [1.0, None, 0, 0, 0, 0]), (102, [float("nan"), 0, 0, 0, 0, 0]), (103, [float("inf"), 0, 0, 0, 0, 0])]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate([*good, good[0], good[0]])]
    df = spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], 1, 2) for i, v in rows + odd], schema)
    got = whitening.whiten(df).collect()
    check_whitening(got, list(range(42)), np.floor(256 * np.array([v for _, v in rows])).astype(np.int64), 4)
    assert {r["vec_id"] for r in got} == set(range(42))
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(df.where("vec_id = 0")).count() == 0                      # no variance
    line = spark.createDataFrame([(i, [float(i), 0.0], 1, 2) for i in range(5)] + [(9, [7.0], 1, 2), (None, [], 1, 2)], schema)
    out = whitening.whiten(line).collect()                                           # one component; short vectors end in zeros
    assert {r["vec_id"] for r in out} == {0, 1, 2, 3, 4, 9, None} and {r["component"] for r in out} == {1}
    huge = whitening.whiten(spark.createDataFrame([(i, [1e18 * i, 1.0], 1, 2) for i in range(3)], schema)).collect()
    assert {r["deviation"] for r in huge} == {None}
    assert whitening.deviations(np.array([[2 ** 30, 1]]), 3, [2 ** 30, 1]) == [4 * 2 ** 60 + 4]


def test_flat_spectrum_widens_the_block(spark):
    """Equal eigenvalues at the block's edge: the block doubles until it is the space."""
    d = 40
    rows = [(2 * i + s, [float((1 if s else -1) * (2.0 + (i < 4) * 1e-3 * (4 - i)) * (j == i)) for j in range(d)]) for i in range(d) for s in (0, 1)]
    rows, dim = whitening.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    blocks = whitening.blocks_of(rows.select("x").distinct(), dim)
    v = whitening.Covariance(blocks, *whitening.totals(blocks, dim))
    found = whitening.leading_pairs(v, guard=2)
    x = np.array([r["x"] for r in rows.collect()], float)
    assert np.allclose(found.values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:4], rtol=1e-12)


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_features_equal_plain_python(monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aB9 zé日\n-ÀßÉ\x00_'İ") for _ in range(rnd.choice([0, 1, 5, 400]))) for _ in range(200)]
    for size in (1, 7, 4_000_000):
        monkeypatch.setattr(target_sampling, "PIECE_BYTES", size)
        for t in texts:
            got = list(target_sampling.feature_buckets(t.encode()))
            n, want = plain_features(t)
            assert sum(k for k, _ in got) == n
            assert sorted(b for _, at in got for b in at.tolist()) == sorted(want)


def brute_resample(docs, target):
    feats = [(i, *plain_features(t)) for i, t in docs]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, _, f in feats:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, plain_features(x)[1], 1)
    gain = np.floor(1000 * np.log((t + 1) * (s.sum() + 10_000) / ((s + 1) * (t.sum() + 10_000)))).astype(int)
    rows = []
    for i, n, f in feats:
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = int(gain[f].sum()) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n, None])
    some = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(some[:5 * len(some) // 100], 1):
        r[5] = k
    return {(*r[:4], r[5]) for r in rows}


def test_resampling_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    got = {tuple(r) for r in queries.op13_target_resampling(spark, SF001).collect()}
    assert got == brute_resample(docs, target)
    assert sum(r[4] is not None for r in got) > 5


def test_rank_top_with_ties(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([-5, 0, 1, 1, 1, 7, 3_000_000_000]) + (i % 300), rnd.random() < 0.8) for i in range(3000)]
    rows += [(None, 1, True), (None, 1, True), (5, 7, True)]
    df = spark.createDataFrame(rows, "doc_id long, score long, eligible boolean")
    some = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    for k in (0, 1, 40, 1500, len(some), len(some) + 9):
        got = sorted((r["rank"], r["score"], r["doc_id"]) for r in target_sampling.rank_top(df, k).where("rank is not null").collect())
        assert got == [(j + 1, r[1], r[0]) for j, r in enumerate(some[:k])]
        assert target_sampling.rank_top(df, k).count() == len(rows)


def test_resampling_edges(spark):
    target = spark.createDataFrame([("one word",), (None,), ("",)], "text string")
    out = target_sampling.resample(edges.docs(spark), target, percent=100, min_words=0).collect()
    assert len(out) == len(edges.rows()) and sorted(r["rank"] for r in out) == list(range(1, len(out) + 1))
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["n_features"] == by[i]["weight"] == 0 for i in (0, 1, 2))
    n, features = plain_features(edges.LONG)
    assert by[6]["n_features"] == len(features) == 3 * n - 3
    assert target_sampling.resample(edges.empty(spark), target).count() == 0
    none = target_sampling.resample(edges.docs(spark), target.where(F.lit(False)))
    assert none.count() == len(edges.rows())
