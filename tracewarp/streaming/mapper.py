"""Mapping of reads that arrive in chunks, and streams that end once enough has been seen.

A chunk's seeds meet the index in a join before anything is kept by read, so neither the index nor the hits of all reads have to fit one
task. What an undecided read needs later lies in Spark's keyed state: the anchors of its primary chains, its events and two
counters. A decided read keeps a mark, against chunks that come late, until a timer removes it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import MapOptions
from ..functions.sketch import sketch
from ..operators.events import detect_events
from ..operators.mapping import TILE, chains_of, judged, reference_tiles, scored

PLACE = "ref_id long, strand int, t_start int, t_end int, q_start int, q_end int, n_anchors int, mapq int"
DECIDED = f"read_id long, chunks int, {PLACE}, confident boolean"


def chunk_events(chunks: DataFrame) -> DataFrame:
    """(read_id, chunk, events) of rows (read_id, chunk, signal): each chunk is segmented and normalised on its own."""
    keyed = chunks.select(F.struct(F.col("read_id").cast("long").alias("read_id"), F.col("chunk").cast("int").alias("chunk")).alias("key"), "signal")
    return detect_events(keyed, "key").select("key.*", "events")


def chunk_hits(chunks: DataFrame, index: DataFrame, o: MapOptions = MapOptions()) -> DataFrame:
    """(read_id, chunk, events, ref_id, strand, t, q) of rows (read_id, chunk, events): a row for each hit of the chunk's seeds, and one with
    the events alone. Each chunk is sketched on its own, with o.least_change as in the index; q counts from its start.

    The row without a hit joins by a negative hash of its own, which no index has.
    """
    fit = F.when(F.size("events") >= o.least_events, F.col("events")).otherwise(F.array().cast("array<double>"))
    rows = chunks.select(F.col("read_id").cast("long"), F.col("chunk").cast("int"), fit.alias("events"))
    mark = F.struct(F.lit(-1).alias("pos"), (-1 - F.pmod(F.xxhash64("read_id", "chunk"), F.lit(1 << 31))).alias("hash"))
    seeds = rows.select("read_id", "chunk", "events", F.explode(F.concat(sketch(F.col("events"), o.e, o.w, o.least_change), F.array(mark))).alias("s"))
    seeds = seeds.select("read_id", "chunk", F.when(F.col("s.pos") < 0, F.col("events")).alias("events"), F.col("s.hash").alias("hash"), F.col("s.pos").alias("q"))
    met = seeds.join(index.select("hash", F.col("ref_id").cast("long"), F.col("strand").cast("int"), F.col("t").cast("int")), "hash", "left")
    return met.where("q < 0 or t is not null").select("read_id", "chunk", "events", "ref_id", "strand", "t", F.col("q").cast("int"))


def save_tiles(refs: DataFrame, path: str, size: int = TILE) -> None:
    """References as sorted tiles in a folder that all executors reach, for alignment in keyed state."""
    order = ["ref_id", "strand", "tile"]
    reference_tiles(refs, size).repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", 1 << 20).parquet(path)


class Tiles:
    """Spans of references, read tile by tile; the last ``most`` tiles are kept."""

    def __init__(self, path: str, size: int = TILE, most: int = 256):
        system, folder = fs.FileSystem.from_uri(path)
        self.table, self.size, self.most = pyarrow.dataset.dataset(folder, filesystem=system, format="parquet"), size, most
        self.held: OrderedDict[tuple[int, int, int], list[tuple[int, np.ndarray]]] = OrderedDict()

    def _tile(self, ref: int, strand: int, tile: int) -> list[tuple[int, np.ndarray]]:
        key = ref, strand, tile
        if key not in self.held:
            f = pyarrow.dataset.field
            rows = self.table.to_table(["at", "part"], (f("ref_id") == ref) & (f("strand") == strand) & (f("tile") == tile))
            self.held[key] = sorted(((at, np.asarray(part.values, float)) for at, part in zip(rows["at"].to_pylist(), rows["part"], strict=True)), key=lambda x: x[0])
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]

    def span(self, ref: int, strand: int, start: int, end: int) -> np.ndarray:
        """The events from start to end, both included."""
        parts = [x for k in range(start // self.size, end // self.size + 1) for x in self._tile(ref, strand, k)]
        return np.concatenate([v[max(0, start - at) : end + 1 - at] for at, v in parts if at <= end and at + len(v) > start])


class ReadMapper(StatefulProcessor):
    """Decides reads by the rows of chunk_hits(), chunk by chunk in the order of their numbers."""

    def __init__(self, o: MapOptions, tiles: str | None, idle_ms: int):
        self.o, self.path, self.idle_ms, self.tiles = o, tiles, idle_ms, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.read = handle.getValueState("read", "chunks int, at int, done boolean")
        self.place = handle.getValueState("place", PLACE)
        self.events = handle.getListState("events", "part array<double>")
        self.kept = handle.getListState("kept", "ref_id long, strand int, t array<int>, q array<int>")

    def _clear(self, *states) -> None:
        for s in states:
            s.clear()

    def _found(self, rows: pd.DataFrame, at: int, events: np.ndarray) -> list[dict]:
        """Primary chains of the kept anchors and a chunk's hits."""
        strands: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for ref, strand, t, q in self.kept.get():
            strands.setdefault((int(ref), int(strand)), []).append((np.asarray(t), np.asarray(q)))
        for (ref, strand), hits in rows[rows["q"] >= 0].groupby(["ref_id", "strand"]):
            strands.setdefault((int(ref), int(strand)), []).append((hits["t"].to_numpy(), hits["q"].to_numpy() + at))
        o = self.o
        found = chains_of({k: tuple(np.concatenate(x) for x in zip(*v, strict=True)) for k, v in strands.items()}, o)
        if o.least_aligned is None:
            return judged(found, "score", o)
        if self.tiles is None:
            self.tiles = Tiles(self.path)
        return judged(scored([{**c, "ref": self.tiles.span(c["ref_id"], c["strand"], c["t_start"], c["t_end"])} for c in found], events, o), "aligned", o)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        chunks, at, done = self.read.get() if self.read.exists() else (0, 0, False)
        rows = pd.concat(list(rows))
        for _, part in [] if done else rows.groupby("chunk"):
            new = np.asarray(next(x for x in part["events"] if x is not None), float)
            chunks, first = chunks + 1, None
            if len(new):
                self.events.appendValue((new.tolist(),))
                whole = np.concatenate([np.asarray(x[0], float) for x in self.events.get()]) if self.o.least_aligned is not None else new
                found = self._found(part, at, whole)
                at += len(new)
                self.kept.clear()
                self.place.clear()
                if found:
                    first = found[0]
                    self.kept.put([(c["ref_id"], c["strand"], [x["t"] for x in c["anchors"]], [x["q"] for x in c["anchors"]]) for c in found])
                    self.place.update(tuple(first[x.split()[0]] for x in PLACE.split(", ")))
            if (first and first["confident"]) or chunks >= self.o.most_chunks:
                done = True
                yield self._row(key, chunks, bool(first and first["confident"]))
                break
        self.read.update((chunks, at, done))
        if done:
            self._clear(self.place, self.events, self.kept)

    def _row(self, key, chunks: int, confident: bool) -> pd.DataFrame:
        place = tuple(self.place.get()) if self.place.exists() else (None,) * len(PLACE.split(", "))
        frame = pd.DataFrame([(key[0], chunks, *place, confident)], columns=[x.split()[0] for x in DECIDED.split(", ")])
        return frame.astype({c: t for c, t in (x.split() for x in DECIDED.split(", ")) for t in [{"long": "Int64", "int": "Int32", "boolean": "boolean"}[t]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A read that has been idle is undecided for good, and leaves the state."""
        chunks, _, done = self.read.get()
        if not done:
            yield self._row(key, chunks, False)
        self._clear(self.read, self.place, self.events, self.kept)

    def close(self) -> None:
        pass


def map_chunks(chunks: DataFrame, index: DataFrame, o: MapOptions = MapOptions(), tiles: str | None = None, idle_ms: int = 60_000) -> DataFrame:
    """A row (DECIDED) for each read of a stream (read_id, chunk, events) once its primary chain is confident, o.most_chunks have come, or
    nothing has come for idle_ms; chunks that come after a decision are ignored.

    Each chunk adds its hits to the anchors of the primary chains so far; other hits of earlier chunks are forgotten. Chunks with fewer
    than o.least_events events count but add none. With alignment scores (o.least_aligned), ``tiles`` names the folder of
    save_tiles(). The session's state store has to be RocksDB's.
    """
    if o.least_aligned is not None and tiles is None:
        raise ValueError("alignment scores need the references' tiles")
    hits = chunk_hits(chunks, index, o)
    return hits.groupBy("read_id").transformWithStateInPandas(ReadMapper(o, tiles, idle_ms), DECIDED, "Append", "ProcessingTime")


def run_until(stream: DataFrame, each: Callable[[DataFrame, int], None], enough: Callable[[int], bool], checkpoint: str) -> int:
    """Runs ``each`` on the triggers of a stream and stops it after the first one for which ``enough`` is true.

    Returns the last trigger that ran, or -1. Triggers between that and the stop do nothing. A stream that starts again from
    its checkpoint asks ``enough`` again at its first trigger.
    """
    seen = {"last": -1, "stop": False}

    def step(rows: DataFrame, batch: int) -> None:
        if not seen["stop"]:
            each(rows, batch)
            seen["last"] = batch
            seen["stop"] = bool(enough(batch))

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while query.isActive and not seen["stop"]:
        query.awaitTermination(1)
    query.stop()
    if query.exception() is not None and not seen["stop"]:
        raise query.exception()
    return seen["last"]
