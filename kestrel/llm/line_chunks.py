"""Line dedup: content-defined chunks of lines that are repeated anywhere are cut.

Only lines with a word count.  A rolling hash over the hashes of ``WINDOW`` neighbouring
lines decides where chunks end, in two families at once: in each, a chunk runs from a
line to the next place where the hash ends in the family's bit.  Chunks so depend on
their own lines alone, wherever they stand, and as every pair of neighbours ends a chunk
in one of the families, no shared run of two lines is too short to hold one.

Chunks are counted by hash over the whole table.  Of a repeated one an occurrence stays
as the model: the first (smallest id, then place) that no cut touches.  Which these are is
settled in rounds, since a cut may break the copy that another cut relies on.  Chunks
that follow each other in a text and in their model are joined to runs, and the lines of
a run are compared byte by byte with those of the model before they go, together with
blank lines between them.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import WORD, by_slices, cut, free_name, numbered, saved, texts_of

WINDOW, MAX_LINES = 2, 8
#: Rounds of settling models after which the lists of what is settled are written anew.
ROUNDS = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_has_word = re.compile(WORD).search


def worded(text: str) -> tuple[list[str], list[int]]:
    """The lines with a word, and their places among all lines."""
    lines = text.split("\n")
    at = [i for i, line in enumerate(lines) if _has_word(line)]
    return [lines[i] for i in at], at


def rolling(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The polynomial hash of each ``window`` neighbouring hashes, mixed."""
    out = np.zeros(max(0, len(hashes) - window + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(window):
            out = out * _BASE + hashes[i:i + len(out)]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def chunks(lines: list[str]) -> list[tuple[int, int, int]]:
    """``first line, lines, hash`` of the chunks of lines with a word: from each line to
    the next end of either family, at most ``MAX_LINES``."""
    hashes = [xxhash.xxh3_64_intdigest(line.encode()) for line in lines]
    bits = (rolling(np.array(hashes, np.uint64)) & np.uint64(1)).tolist()   # bits[j - 1]: of the window ending at j
    data, out = np.array(hashes, "<u8").tobytes(), []
    for i in range(len(lines) - 1):
        open_ = {0, 1}
        for j in range(i + 1, min(len(lines), i + MAX_LINES)):
            if bits[j - 1] in open_:
                open_.discard(bits[j - 1])
                out.append((i, j - i + 1, xxhash.xxh3_64_intdigest(data[8 * i:8 * (j + 1)])))
                if not open_:
                    break
    return out


def _chunk_table(rows: DataFrame) -> DataFrame:
    """``place, doc_id, line, lines, h`` of every chunk of ``rows(place, doc_id, text)``;
    ``line`` counts the lines with a word."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, line, lines, hashes = [], [], [], []
            for i, text in enumerate(texts_of(batch)):
                for first, n, h in chunks(worded(text)[0]):
                    at.append(i)
                    line.append(first)
                    lines.append(n)
                    hashes.append(h)
            row = pa.array(at, pa.int32())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(line, pa.int32()), pa.array(lines, pa.int32()),
                 pa.array(np.array(hashes, np.uint64).view(np.int64))],
                names=["place", "doc_id", "line", "lines", "h"])
        return work
    return rows.mapInArrow(by_slices(make), f"place long, doc_id {kind}, line int, lines int, h long")


def _lines_of(spans: DataFrame) -> DataFrame:
    """``place, at`` of each line of ``spans(place, line, lines)``, once."""
    return spans.select("place", F.explode(F.sequence("line", F.col("line") + F.col("lines") - 1)).alias("at")).distinct()


def _touching(spans: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """The keys of the spans that hold one of ``lines(place, at)``."""
    each = spans.select(*key, "place", F.explode(F.sequence("line", F.col("line") + F.col("lines") - 1)).alias("at"))
    return each.join(lines, ["place", "at"], "left_semi").select(*key).distinct()


def _first_waiting(chosen: DataFrame, pending: DataFrame) -> DataFrame:
    """The models ``chosen(h, place, line, lines)`` that come, by place and line, before the
    model of every repetition in ``pending`` that touches them."""
    at = F.explode(F.sequence("line", F.col("line") + F.col("lines") - 1)).alias("at")
    order = F.struct(F.col("first_place").alias("place"), F.col("first_line").alias("line"), "h").alias("theirs")
    mine = chosen.select("h", F.struct("place", "line", "h").alias("own"), "place", at)
    theirs = pending.select(order, "place", at)
    late = mine.join(theirs, ["place", "at"]).where("theirs < own").select("h").distinct()
    return chosen.join(late, "h", "left_anti")


def settled_cuts(table: DataFrame) -> DataFrame:
    """``place, line, lines, first_place, first_line`` of the chunks to cut, each with a model
    that no cut touches."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "place", "line", "lines")
    columns = ["place", "line", "lines", "first_place", "first_line"]

    def models(occurrences: DataFrame) -> DataFrame:
        return occurrences.groupBy("h").agg(F.count("*").alias("n"), F.min(order).alias("f"))
    first = [F.col("f.place").alias("first_place"), F.col("f.line").alias("first_line")]
    # an occurrence can be a model until a cut touches it
    linked = saved(table.join(models(table).where("n > 1").select("h", *first), "h").withColumn("whole", F.lit(True)), "chunks")
    cuts, held, place = linked.select(*columns).where(F.lit(False)), None, ["h", "place", "line"]
    turn = 0
    while not linked.isEmpty():
        turn += 1
        # a repetition that overlaps its own model, as in a run of equal lines, is left
        apart = (F.col("place") != F.col("first_place")) | (F.abs(F.col("line") - F.col("first_line")) >= F.col("lines"))
        pending = linked.where(apart)
        if held is not None:  # what earlier rounds rely on stays
            pending = cut(pending.join(_touching(pending, held, place), place, "left_anti"))
        chosen = linked.select("h", F.col("first_place").alias("place"), F.col("first_line").alias("line"), "lines").distinct()
        touched = cut(_touching(chosen, _lines_of(pending), ["h"]))
        ready = cut(pending.join(touched, "h", "left_anti").select(*columns))
        relied = cut(_lines_of(chosen.join(touched, "h", "left_anti")))  # later rounds read it again
        stuck = relied.isEmpty()  # each model waits for another: the first of those in each other's way stay
        if stuck:
            relied = cut(_lines_of(_first_waiting(chosen, pending)))
        cuts = cuts.unionByName(ready)
        held = relied if held is None else held.unionByName(relied)
        if turn % ROUNDS == 0:
            cuts, held = cut(cuts), cut(held)
        if stuck:
            continue
        rest = linked.join(touched, "h", "left_semi").drop("first_place", "first_line")
        broken = _touching(rest.where("whole").select(*place, "lines"), _lines_of(ready), place).withColumn("b", F.lit(True))
        rest = cut(rest.join(broken, place, "left").withColumn("whole", F.col("whole") & F.col("b").isNull()).drop("b"))
        linked = cut(rest.join(models(rest.where("whole")).select("h", *first), "h"))
    return cuts


def runs(found: list[dict]) -> list[list[int]]:
    """``line, lines, first_place, first_line`` of the longest runs of a text's chunks, given
    with ``line, lines, first_place, first_line``: those of one model place and distance that
    overlap or touch are one."""
    out: list[list[int]] = []
    for c in sorted(found, key=lambda c: (c["first_place"], c["first_line"] - c["line"], c["line"])):
        last = out[-1] if out else None
        if (last and c["first_place"] == last[2] and c["first_line"] - c["line"] == last[3] - last[0]
                and c["line"] <= last[0] + last[1]):
            last[1] = max(last[1], c["line"] + c["lines"] - last[0])
        else:
            out.append([c["line"], c["lines"], c["first_place"], c["first_line"]])
    return out


def _run_table(found: DataFrame) -> DataFrame:
    """``place, line, lines, first_place, first_line`` of the runs of ``found(place, chunks)``."""
    def work(batches):
        for batch in batches:
            at, out = [], []
            for i, some in enumerate(batch.column(1).to_pylist()):
                for run in runs(some):
                    at.append(i)
                    out.append(run)
            line, lines, place, first = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(line, pa.int32()), pa.array(lines, pa.int32()),
                 pa.array(place, pa.int64()), pa.array(first, pa.int32())],
                names=["place", "line", "lines", "first_place", "first_line"])
    return found.mapInArrow(work, "place long, line int, lines int, first_place long, first_line int")


def _cut_texts(spans: DataFrame) -> DataFrame:
    """``first_place, first_line, lines, model``: the bytes of the spans of
    ``spans(first_place, text, spans)``."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, line, size, data = [], [], [], []
            for i, (text, some) in enumerate(zip(texts_of(batch), batch.column(2).to_pylist())):
                lines = worded(text)[0]
                for s in some:
                    at.append(i)
                    line.append(s["first_line"])
                    size.append(s["lines"])
                    data.append("\n".join(lines[s["first_line"]:s["first_line"] + s["lines"]]).encode())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(line, pa.int32()), pa.array(size, pa.int32()),
                 pa.array(data, pa.binary())], names=["first_place", "first_line", "lines", "model"])
        return work
    return spans.mapInArrow(by_slices(make), "first_place long, first_line int, lines int, model binary")


def repeated_runs(rows: DataFrame) -> DataFrame:
    """``place, line, lines, model`` of every run of ``rows(place, doc_id, text)`` to cut by
    the hashes, with the bytes of its model; ``line`` counts the lines with a word."""
    found = cut(_run_table(settled_cuts(_chunk_table(rows)).groupBy("place").agg(
        F.collect_list(F.struct("line", "lines", "first_place", "first_line")).alias("chunks"))))
    key = ["first_place", "first_line", "lines"]
    spans = (found.select(key).distinct().groupBy("first_place")
             .agg(F.collect_list(F.struct("first_line", "lines")).alias("spans")))
    texts = rows.select(F.col("place").alias("first_place"), "text")
    models = cut(_cut_texts(texts.join(spans, "first_place").select("first_place", "text", "spans")))
    return found.join(models, key).select("place", "line", "lines", "model")


def same_lines(text: str, spans) -> list[dict]:
    """``line, lines`` of the stretches of ``text`` to cut, among all its lines: the lines of
    the spans that equal their model byte by byte, two neighbours at least, and blank lines
    between them.  A chunk whose hash another text shares, should that happen, stays."""
    (lines, at), gone = worded(text), set()
    for s in spans:
        own, model = lines[s["line"]:s["line"] + s["lines"]], bytes(s["model"]).decode().split("\n")
        for i in range(len(own) - 1):
            if own[i:i + 2] == model[i:i + 2]:
                gone.update(range(at[s["line"] + i], at[s["line"] + i + 1] + 1))
    out: list[dict] = []
    for i in sorted(gone):
        if out and out[-1]["line"] + out[-1]["lines"] == i:
            out[-1]["lines"] += 1
        else:
            out.append({"line": i, "lines": 1})
    return out


def without_chunks(text: str, spans) -> str:
    lines, gone = text.split("\n"), set()
    for s in spans:
        gone.update(range(s["line"], s["line"] + s["lines"]))
    return "\n".join(x for i, x in enumerate(lines) if i not in gone)


def _cleaned(text: pd.Series, some: pd.Series) -> pd.DataFrame:
    out = []
    for t, s in zip(text, some):
        gone = [] if t is None or s is None else same_lines(t, s)
        out.append((without_chunks(t, gone) if gone else t, len(gone), sum(g["lines"] for g in gone)))
    return pd.DataFrame(out, columns=["text", "n_chunks", "n_lines"]).astype({"text": "object"})


def _marked(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    """``columns`` of ``docs`` with the rows' cleaned text and numbers of stretches and lines
    cut (null: no run found)."""
    place, spans, done = free_name(docs, "place"), free_name(docs, "spans"), free_name(docs, "done")
    docs = numbered(docs, place).select(*columns, place)
    gone = repeated_runs(docs.select(F.col(place).alias("place"), "doc_id", "text")).groupBy("place").agg(
        F.collect_list(F.struct("line", "lines", "model")).alias(spans)).withColumnRenamed("place", place)
    run = F.pandas_udf(_cleaned, "text string, n_chunks long, n_lines long")
    marked = docs.join(gone, place, "left")
    return marked.withColumn(done, F.when(F.col(spans).isNotNull(), run("text", spans))), done


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated runs of lines cut out of ``text``; the other columns
    stay, but for ``n_chars``, which follows the text where some was cut.

    A null text stays null; a text of repeated runs alone becomes empty;
    repeated rows are copies of the first; an empty table stays empty.
    """
    marked, done = _marked(docs, docs.columns)
    changed = F.coalesce(F.col(done)["n_chunks"], F.lit(0)) > 0
    out = marked.withColumn("text", F.when(changed, F.col(done)["text"]).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chunks_cut, n_lines_cut, text`` for each row: the stretches and lines
    cut, and the cleaned text.  A null text stays null, repeated rows are copies of the
    first, an empty table gives no rows, extra columns are left out."""
    marked, done = _marked(docs, ["doc_id", "text"])
    of = lambda name: F.coalesce(F.col(done)[name], F.lit(0)).cast("long")
    return marked.select("doc_id", of("n_chunks").alias("n_chunks_cut"), of("n_lines").alias("n_lines_cut"),
                         F.when(of("n_chunks") > 0, F.col(done)["text"]).otherwise(F.col("text")).alias("text"))
