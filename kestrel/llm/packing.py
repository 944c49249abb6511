"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of 4096, ..., 4, 2, 1 tokens by the
binary digits of n (several of the longest).  Each piece is a sequence of its
own: its length is a power of two, so it needs no padding, and no sequence
crosses documents.  Sequences of one length form a bucket; batches are drawn
from a bucket.  A piece depends on its document alone, so the whole operator is
one pass without a shuffle.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import by_slices, texts_of

MAX_LENGTH = 4096
END_ID = 2
CACHE_ENTRIES = 600_000
CACHE_CHARS = 48

# Latin letters whose class and lower case Python and the tokenizer's Unicode
# tables share; any other text takes the tokenizer's own normaliser and pattern.
_LATIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ž]*")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ž"
_LATIN_PIECE = re.compile(f"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTERS}0-9]+")
_ANY_WORD = regex.compile(r"\S+")


def _byte_symbols() -> dict[int, str]:
    """The visible character that byte-level BPE writes for each byte: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
    return {b: chr(b) for b in plain} | {
        b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}


_BYTE_SYMBOLS = _byte_symbols()


class _Known(dict):
    """Values by text, made when first asked for; short texts are kept, up to a bound."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        value = self.make(text)
        if len(text) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[text] = value
        return value


class WordEncoder:
    """Ids of a word-level BPE by the ``tokenizers`` library, as its ``encode`` without
    special tokens added gives them; words and pieces met before come from bounded
    caches.  The strings of special tokens become their ids, as they do there."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.any_piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
        self.cut = re.compile("(%s)" % "|".join(map(re.escape, self.special))).split
        self.pieces, self.latin, self.others = _Known(self._piece), _Known(self._latin_word), _Known(self._word)

    def _piece(self, piece: str) -> bytes:
        symbols = piece.encode().decode("latin-1").translate(_BYTE_SYMBOLS)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(symbols)])

    def _latin_word(self, word: str) -> bytes:
        if word.isalpha():
            return self.pieces[word]
        return b"".join(map(self.pieces.__getitem__, _LATIN_PIECE.findall(word)))

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.any_piece.findall(word)))

    def _ordinary(self, text: str) -> bytes:
        """The normalised text is cut at blanks, as no token crosses one."""
        if _LATIN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            return b"".join(map(self.latin.__getitem__, text.lower().split()))
        return b"".join(map(self.others.__getitem__, _ANY_WORD.findall(self.tokenizer.normalizer.normalize_str(text))))

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            return self._ordinary(text)
        return b"".join([self.special.get(part) or self._ordinary(part) for part in self.cut(text)])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode, texts))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def lengths_of(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """The piece lengths of n tokens: the longest first."""
    out = [longest] * (n // longest)
    rest = n % longest
    while rest:
        bit = 1 << (rest.bit_length() - 1)
        out.append(bit)
        rest -= bit
    return out


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", longest: int = MAX_LENGTH,
         end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, bucket`` and, if asked for, ``ids array<int>``.

    ``longest`` must be a power of two.  A null text is empty and becomes one
    piece of the end id alone.  Repeated rows and null keys are packed like any
    others; extra columns are left out.  ``sequence_id`` is unique and the same
    when a lost task runs again: it numbers the pieces of each input split.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def make():
        enc = word_encoder(path)
        end = int(end_id).to_bytes(4, "little")

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, data in enumerate(enc.encode_batch(texts_of(batch))):
                data += end
                n, at = len(data) // 4, 0
                for size in lengths_of(n, longest):
                    piece = data[4 * at:4 * (at + size)]
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(piece)
                    at += size
            keys = batch.column(0).take(pa.array(row, pa.int32()))
            columns = [keys, *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            names = ["key", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                at = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(flat)))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)
        return work
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = rows.mapInArrow(by_slices(make), out)
    return pieces.select(
        F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.round(F.log2("length")).cast("int").alias("bucket"), *(["ids"] if with_ids else []))
