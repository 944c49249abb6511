"""Byte-level BPE and packing against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from kestrel.llm import bpe, packing, queries
from tests.conftest import SF001
from tests.llm import edges

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ALPHABET = "ab'stre llvd M12é ñÉİIſK²½Σσς_-\x1c\x85\xa0́̇日本🎉<|endoftext|>ŉ×÷\x00\xad​　\n\t"


def fuzz(seed, n=300):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.choice([0, 1, 3, 9, 60, 700]))) for _ in range(n)]


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def library():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load(RANKS).ranks, special_tokens={})


def test_bpe_equals_library_and_round_trips():
    ref, enc = library(), bpe.Encoder(RANKS, P.PATTERN)
    texts = fuzz(1) + ["a" * 5001, " " * 3000, "ab" * 4000, "thththe" * 900, edges.LONG]
    got = enc.encode_batch(texts)
    assert got == [as_bytes(ref.encode_ordinary(t)) for t in texts]
    assert [enc.vocabulary.decode(g).decode() for g in got] == texts


def test_rank_queue_pops_in_order():
    q = bpe.RankQueue(50_256)
    ranks = np.array([50_000, 3, 64, 4096, 3, 63])
    q.push(ranks, np.arange(6))
    popped = []
    while (entry := q.pop()) is not None:
        popped += [(entry[0], p) for p in sorted(entry[1].tolist())]
    assert popped == [(3, 1), (3, 4), (63, 5), (64, 2), (4096, 3), (50_000, 0)]


def test_bpe_query_and_edges(spark):
    ref = library()
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    want = {}
    for r in docs:
        ids = as_bytes(ref.encode_ordinary(r["text"] or ""))
        want[r["doc_id"]] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op3_bpe_rank_queue(spark, SF001).collect()}
    assert got == want
    out = bpe.digests(edges.docs(spark), RANKS, P.PATTERN)
    assert out.count() == len(edges.rows())
    assert {r["n_tokens"] for r in out.where("doc_id in (0, 1)").collect()} == {0}
    assert bpe.digests(edges.empty(spark), RANKS, P.PATTERN).count() == 0
    pairs = bpe.decode(bpe.encode(edges.docs(spark), RANKS, P.PATTERN), RANKS).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["data"])) for r in pairs) == sorted(
        (r[0] is None, r[0] or 0, (r[1] or "").encode()) for r in edges.rows())


def test_word_encoder_equals_library():
    enc, plain, texts = packing.WordEncoder(WORDS), Tokenizer.from_file(WORDS), fuzz(2, 3000)
    texts += ["<|endoftext|>", "a<|endoftext|>b <|startoftext|><|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "e<|endoftext|>\u0301 İ<|endoftext|>"]
    assert enc.encode_batch(texts) == [as_bytes(e.ids) for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_word_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 5)
    enc, plain, texts = packing.WordEncoder(WORDS), Tokenizer.from_file(WORDS), fuzz(4, 50) + ["x" * 500, "y" * 500]
    assert enc.encode_batch(texts) == [as_bytes(e.ids) for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert max(map(len, (enc.latin, enc.others, enc.pieces))) <= 5 and "x" * 500 not in enc.latin


def test_packing(spark):
    t = Tokenizer.from_file(WORDS)
    source = spark.read.parquet(f"{SF001}/documents.parquet")
    whole = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in source.collect()}
    pieces = packing.pack(source, WORDS).collect()
    seen = {k: [None] * len(v) for k, v in whole.items()}
    for p in pieces:
        part = whole[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert p["ids"] == part and p["ids_crc32"] == zlib.crc32(as_bytes(part)) and p["doc_tokens"] == len(whole[p["doc_id"]])
        assert p["length"] & (p["length"] - 1) == 0 and p["length"] <= 4096 and p["offset"] == 0
        assert 1 << p["bucket"] == p["length"]
        for i, x in enumerate(part, p["start"]):
            assert seen[p["doc_id"]][i] is None
            seen[p["doc_id"]][i] = x
    assert seen == whole
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)


def test_packing_edges(spark):
    out = packing.pack(edges.docs(spark), WORDS)
    assert [r["length"] for r in out.where("doc_id = 0").collect()] == [1]
    assert out.select("sequence_id").distinct().count() == out.count()
    assert out.where("doc_id = 4").count() == 2 * len(packing.lengths_of(out.where("doc_id = 4").first()["doc_tokens"]))
    assert packing.pack(edges.empty(spark), WORDS).count() == 0
    assert packing.lengths_of(0) == [] and packing.lengths_of(3 * 4096 + 5) == [4096, 4096, 4096, 4, 1]
