"""Secrets by token efficiency.

Beside assignments, access keys and long hexadecimal strings, which their form
gives away, a random string shows itself by how badly it compresses: under a
byte-level vocabulary it needs nearly a token for every two characters, where
words and names need far fewer.  Digests of known lengths and identifiers
(UUIDs, plain numbers, names with separators, addresses) are no secrets and are
left out before the test.  A run is tested as a whole, and if it passes, its parts
between separators, so that a readable path or name does not hide a key behind it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import by_slices, texts_of

KINDS = ["assign", "access", "hex"]
#: What the token test finds.
FOUND = "random"
MIN_LENGTH, MAX_CHARS_PER_TOKEN, MIN_CLASSES = 20, 2.1, 2
# fixed values: the lengths of md5, sha1, sha224, sha256, sha384 and sha512 digests
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}

_HINTS = ("passw", "secret", "token", "api")
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.I | re.A).finditer
_access = re.compile("AKIA[A-Z0-9]+").finditer
_hex = re.compile("[0-9a-f]{16,}").finditer
_run = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH).finditer
_any_hex = re.compile("[0-9a-fA-F]+").fullmatch
_uuid = re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}").fullmatch
_number = re.compile("[0-9_+/=-]+").fullmatch
_checksum = re.compile("sha(1|256|384|512)[-=]([A-Za-z0-9+/_-]+)=*").fullmatch
#: By digest: its length in hexadecimal and in base 64 without padding.
_CHECKSUM_LENGTHS = {"1": (40, 27), "256": (64, 43), "384": (96, 64), "512": (128, 86)}
_SEPARATORS = ["/", "=", "-", "_", "+", "/=_+-"]
_words = re.compile("(?:[A-Z]?[a-z]{3,}|[A-Z]{3,}|[0-9]{1,4})(?:[_/+=-]+(?:[A-Z]?[a-z]{3,}|[A-Z]{3,}|[0-9]{1,4}))*").fullmatch


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in _assign(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _hex(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def is_known(run: str) -> bool:
    """A digest of a known length, or an identifier."""
    checksum = _checksum(run)
    return bool((len(run) in DIGEST_LENGTHS and _any_hex(run)) or _uuid(run) or _number(run) or _words(run)
                or (checksum and len(checksum.group(2)) in _CHECKSUM_LENGTHS[checksum.group(1)]))


def classes(run: str) -> int:
    """Of lower case, upper case and digits, how many occur; a capital at the start alone
    does not count."""
    return (any("a" <= c <= "z" for c in run)) + (any("A" <= c <= "Z" for c in run[1:])) + (any("0" <= c <= "9" for c in run))


@lru_cache(maxsize=1)
def _encoding(path: str):
    import tiktoken
    import public_tokenizers
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_spans(text: str, path: str) -> list[tuple[str, int, int]]:
    """The runs of ``MIN_LENGTH`` characters or more, or else their parts between
    separators, that are no known digest or identifier and take more than a token per
    ``MAX_CHARS_PER_TOKEN`` characters."""
    if max(map(len, text.split()), default=0) < MIN_LENGTH:
        return []
    out = []
    for m in _run(text):
        run = m.group()
        if is_known(run):
            continue
        if is_random(run, path):
            out.append((FOUND, m.start(), m.end()))
            continue
        found: list[tuple[int, int]] = []
        for separators in _SEPARATORS:
            for start, end in parts(run, separators):
                part = run[start:end]
                if (all(end <= s or e <= start for s, e in found) and not is_known(part) and is_random(part, path)):
                    found.append((start, end))
        out += [(FOUND, m.start() + s, m.start() + e) for s, e in sorted(found)]
    return out


def parts(run: str, separators: str) -> list[tuple[int, int]]:
    """Where the parts of ``MIN_LENGTH`` characters or more between separators stand."""
    out, start = [], 0
    for i, c in enumerate(run + separators[0]):
        if c in separators:
            if MIN_LENGTH <= i - start < len(run):
                out.append((start, i))
            start = i + 1
    return out


def is_random(run: str, path: str) -> bool:
    return classes(run) >= MIN_CLASSES and len(run) < MAX_CHARS_PER_TOKEN * len(_encoding(path).encode_ordinary(run))


def all_spans(text: str, path: str) -> tuple[list, list]:
    """The base spans, and all spans; a random run inside a base span is not repeated."""
    base = base_spans(text)
    ordered = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))

    def covered(start: int, end: int) -> bool:
        n = bisect_right(starts, start)
        return n > 0 and reach[n - 1] >= end
    more = [x for x in random_spans(text, path) if not covered(x[1], x[2])]
    order = [*KINDS, FOUND]
    return base, sorted(base + more, key=lambda x: (x[1], order.index(x[0]), x[2]))


def scan(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row of
    ``docs``, in one pass without a shuffle.

    Null and empty texts have no spans; repeated rows have equal ones; an empty
    table gives no rows; extra columns are left out.
    """
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digest, spans = {k: [] for k in KINDS}, [], []
            for text in texts_of(batch):
                base, every = all_spans(text, path)
                for kind, column in counts.items():
                    column.append(sum(k == kind for k, _, _ in base))
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digest, pa.string()),
                 pa.array(spans, pa.string())], names=["k", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
        return work
    rows = docs.select(F.col("doc_id").alias("k"), "text")
    kind = rows.schema["k"].dataType.simpleString()
    out = f"k {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return rows.mapInArrow(by_slices(make), out).withColumnRenamed("k", "doc_id")


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
