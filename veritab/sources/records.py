"""Record boundaries of CSV files whose quoted fields hold line breaks, found without reading a file in one task.

Spark's text source cuts files into byte ranges at line ends. Each line is a map of two states (a record starts here, or a
quoted field is open) to the state after it, and the map of a range is the product of its lines' maps. The maps of a file's
ranges are composed in their order, which gives each range its entry state; then every range puts its lines together to
records on its own. A record that reaches over the end of a range is put together from its parts by a grouping on (file,
number of the part's record): one group is one record.

Quotes are read as the parser reads them: one opens a field only at the field's start, doubled ones belong to the value, and
a quote inside an unquoted field is a plain character. Lines end with a line feed, with or without carriage return.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship_sources

RECORD, HEAD, TAIL = 0, 1, 2


def open_after(line: Column, sep: str = ",", quote: str = '"') -> Column:
    """Whether a quoted field is open after the line, which starts a record."""
    s, q = re.escape(sep), re.escape(quote)
    value = f"{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    field = f"(?:{value}{q}(?!{q})(?:(?!{s}).)*+|(?!{q})(?:(?!{s}).)*+){s}"
    return line.rlike(f"(?s)\\A(?:{field})*+{value}\\z")


def states(state: int, opens: np.ndarray, stays: np.ndarray) -> np.ndarray:
    """The state after each line, from the one before the first: the last constant map counts, then exchanges after it."""
    place = np.arange(1, len(opens) + 1)
    known = np.maximum.accumulate(np.where(opens == stays, place, 0))
    value = np.concatenate(([bool(state)], opens))[known]
    exchanges = np.concatenate(([0], np.cumsum(opens & ~stays)))
    return value ^ ((exchanges[place] - exchanges[known]) % 2 == 1)


def _runs(batch: pa.RecordBatch):
    """(range, batch rows of it) in the batch's order."""
    part = batch.column("range").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(part[a]), batch.slice(a, b - a)


def _flags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("opens", "stays"))


def text_lines(spark: SparkSession, path, sep: str = ",", quote: str = '"') -> DataFrame:
    """file, block (first byte of the range), range (hash of both), line and its map: ``opens`` from a record's start,
    ``stays`` from within a quoted field."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("range"), F.col("value").alias("line"),
                      open_after(F.col("value"), sep, quote).alias("opens"),
                      open_after(F.concat(F.lit(quote), "value"), sep, quote).alias("stays"))


def range_maps(lines: DataFrame) -> DataFrame:
    """file, block, range and the state after the range from either entry state (``opens``, ``stays``)."""
    def run(batches):
        last = None
        for batch in batches:
            for part, rows in _runs(batch):
                if last is None or part != last[0]:
                    if last is not None:
                        yield row(last)
                    last = [part, rows.column("file")[0].as_py(), rows.column("block")[0].as_py(), False, True]
                opens, stays = _flags(rows)
                last[3:] = [bool(states(s, opens, stays)[-1]) for s in last[3:]]
        if last is not None:
            yield row(last)

    def row(r):
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in r], ["range", "file", "block", "opens", "stays"])

    return lines.select("range", "file", "block", "opens", "stays").mapInArrow(
        run, "range bigint, file string, block bigint, opens boolean, stays boolean")


def entry_states(maps: DataFrame) -> DataFrame:
    """range and ``open``, the state that its first line meets: the maps of the ranges before it, composed."""
    order = Window.partitionBy("file").orderBy("block")
    known = maps.withColumn("reset", F.sum(F.when(F.col("opens") == F.col("stays"), 1).otherwise(0)).over(order))
    within = Window.partitionBy("file", "reset").orderBy("block")
    first = F.first(F.when(F.col("opens") == F.col("stays"), F.col("opens")).otherwise(F.lit(False))).over(within)
    odd = F.sum(F.when(F.col("opens") & ~F.col("stays"), 1).otherwise(0)).over(within) % 2 == 1
    after = known.withColumn("after", first != odd)
    return after.select("range", F.lag("after", 1, False).over(order).alias("open"))


def parts(lines: DataFrame, entry: DataFrame, header: bool) -> DataFrame:
    """file, block, kind, text: whole records, and the parts of those that reach over the ends of ranges: HEAD, the lines
    before a range's first record, and TAIL, the lines of a record that the range does not end. ``header`` leaves out the
    first record of each file. The entry states go along as two arrays (nine bytes a range)."""
    states_of = entry.toArrow()
    ids = states_of.column("range").to_numpy()
    order = np.argsort(ids)
    ids, opened = ids[order], states_of.column("open").to_numpy()[order].astype(bool)

    def entry_of(part: int) -> bool:
        at = int(np.searchsorted(ids, part))
        if at == len(ids) or ids[at] != part:
            raise ValueError("the byte ranges of the files changed while they were read; load them again")
        return bool(opened[at])

    def emit(where, kind, texts):
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([where[0]] * n, pa.string()), pa.array([where[1]] * n, pa.int64()),
             pa.array(np.full(n, kind, np.int32)), texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())],
            ["file", "block", "kind", "text"])

    def run(batches):
        part = None
        for batch in batches:
            for now, rows in _runs(batch):
                if now != part:
                    if part is not None and held:
                        yield emit(where, HEAD if in_head else TAIL, ["\n".join(held)])
                    part, where = now, (rows.column("file")[0].as_py(), rows.column("block")[0].as_py())
                    state = in_head = entry_of(now)
                    held, skip = [], header and where[1] == 0
                opens, stays = _flags(rows)
                after = states(state, opens, stays)
                starts = np.concatenate(([not state], ~after[:-1]))
                state, text = bool(after[-1]), rows.column("line")
                # one line is one record wherever the next line starts one too
                if starts.all() and not state and not held:
                    whole = text.slice(1) if skip else text
                    skip = False
                    if len(whole):
                        yield emit(where, RECORD, whole)
                    continue
                done = []
                for line, start in zip(text.to_pylist(), starts.tolist(), strict=True):
                    if start and held:
                        if in_head:
                            yield emit(where, HEAD, ["\n".join(held)])
                            in_head = False
                        elif skip:
                            skip = False
                        else:
                            done.append("\n".join(held))
                        held = []
                    if start:
                        in_head = False
                    held.append(line)
                if held and not state:
                    if in_head:
                        yield emit(where, HEAD, ["\n".join(held)])
                    elif skip:
                        skip = False
                    else:
                        done.append("\n".join(held))
                    held, in_head = [], False
                if done:
                    yield emit(where, RECORD, done)
        if part is not None and held:
            yield emit(where, HEAD if in_head else TAIL, ["\n".join(held)])

    return lines.select("file", "block", "range", "line", "opens", "stays").mapInArrow(
        run, "file string, block bigint, kind int, text string")


def csv_records(spark: SparkSession, path, sep: str = ",", quote: str = '"', header: bool = True) -> DataFrame:
    """One row ``text`` for each record that is not empty. Files are read twice: for the maps, and for the records."""
    ship_sources(spark)
    lines = text_lines(spark, path, sep, quote)
    folder = scratch_path(spark, "csv-ranges")
    entry_states(range_maps(lines)).write.parquet(folder)
    entry = spark.read.schema("range bigint, open boolean").parquet(folder)
    found = parts(lines, entry, header)
    records = found.where(F.col("kind") == RECORD).select("text")
    if not entry.where("open").isEmpty():
        cut = scratch_path(spark, "csv-parts")
        found.where(F.col("kind") != RECORD).write.parquet(cut)
        pieces = spark.read.schema(found.schema).parquet(cut)
        number = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(
            Window.partitionBy("file").orderBy("block", "kind"))
        joined = (pieces.withColumn("record", number).groupBy("file", "record")
                  .agg(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("all"))
                  .select(F.array_join(F.transform("all", lambda p: p["text"]), "\n").alias("text")))
        records = records.unionByName(joined)
    else:
        records = found.where(F.col("kind") != HEAD).select("text")
    return records.select(F.regexp_replace("text", r"\r\z", "").alias("text")).where("text <> ''")
