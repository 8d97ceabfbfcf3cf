"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``size`` tokens. Only the count of pieces of each length matters for the plan, so the
plan is made from at most ``size`` numbers, whatever the corpus. Lengths are taken from the longest down; the gap that
a length leaves is looked up among single lengths, pair sums and triple sums of what is still available, and an exact
combination is consumed as often as its counts allow. What finds no exact complement is packed by best fit. Of several plans, whose
exact combinations go down to different lengths, the one with the fewest sequences is taken, which is never worse than best fit alone.
Every step uses up at least one length or entry, so a plan has a few thousand patterns at most: a table of slots (length,
first rank, end rank, first sequence, offset) whose size is bounded by ``size`` and not by the data.

Each piece then needs its rank among the pieces of its length. A written table of pieces has one row a piece with the
task that made it and its number among that task's pieces of the length; ranks follow from the counts of (task, length)
by a running sum. Pieces and slots meet in a broadcast join on length. Token ids never move: they stay in the written
table, and only (doc_id, piece, length) is shuffled.

Defined results: a null or empty text is the end token alone; repeated rows are packed once each; a document longer
than ``size``, however long, is cut into pieces of ``size``, of which the first takes the remainder; pieces of equal length
are taken in the order of their rows; an empty table gives no sequence. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import bisect
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SIZE, END = 1024, 2
#: Texts with such runs, or with a special token's text, go to the slower of the two encoders, which is built for them.
_LONG, _BLANK = re.compile(r"\S{400}|\s{400}"), re.compile(r"\s")


def has_long_run(text: str) -> bool:
    """Whether _LONG is found. Such a run has a whole block of 200 from a multiple of 200 on, so that texts without one aren't searched."""
    blocks = (text[k : k + 200] for k in range(0, len(text) - 199, 200))
    return any(not _BLANK.search(b) or b.isspace() for b in blocks) and _LONG.search(text) is not None


class Sums:
    """An index of what adds up to each sum: single lengths, pairs, and triples as a length with a pair's sum.

    Entries name lengths, not pieces; one is dropped for good when it is met after its lengths have been used up, as counts
    only fall. Pairs have the more even lengths last, triples the longer single last: these are consumed first.
    """

    def __init__(self, left: np.ndarray):
        self.left, size = left, len(left) - 1
        some = [int(x) for x in np.flatnonzero(left)]
        self.pairs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        for b in reversed(some):
            for a in some:
                if a > b or a + b > size:
                    break
                self.pairs[a + b].append((a, b))
        self.triples: list[list[int]] = [[] for _ in range(size + 1)]
        sums = [k for k in range(2, size + 1) if self.pairs[k]]
        for x in some:
            for k in sums:
                if x + k > size:
                    break
                self.triples[x + k].append(x)

    def has(self, *lengths: int) -> bool:
        return all(self.left[x] >= k for x, k in Counter(lengths).items())

    def pair(self, total: int, *taken: int) -> tuple[int, ...] | None:
        entries = self.pairs[total]
        while entries and not self.has(*entries[-1]):
            entries.pop()
        return next(((b, a) for a, b in reversed(entries) if self.has(a, b, *taken)), None)

    def find(self, total: int, *taken: int) -> tuple[int, ...] | None:
        """The combination that adds up to total and is there beside the lengths taken."""
        if self.has(total, *taken):
            return (total,)
        if found := self.pair(total, *taken):
            return found
        entries = self.triples[total]
        for at in range(len(entries) - 1, -1, -1):
            x = entries[at]
            if self.has(x, *taken) and (found := self.pair(total - x, x, *taken)):
                return (x, *found)
            if not self.left[x] or not self.pairs[total - x]:
                entries.pop(at)
        return None


def fullest(left: np.ndarray, gap: int) -> list[int]:
    """Available lengths that fill as much of a gap as any do (subset sums over counts), long ones first."""
    reach = 1
    mask, steps = (1 << gap + 1) - 1, []
    for x in (int(x) for x in np.flatnonzero(left[: gap + 1])[::-1]):
        n, k = min(int(left[x]), gap // x), 1
        while n:  # binary parts of the count
            k = min(k, n)
            steps.append((x, k, reach))
            reach |= (reach << x * k) & mask
            n, k = n - k, k * 2
        if reach >> gap & 1:
            break
    at, out = reach.bit_length() - 1, []
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            out += [x] * k
            at -= x * k
    return sorted(out, reverse=True)


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Patterns (how often, lengths) by best fit in falling order of length: each piece goes where the least room is left that it fits.
    Sequences with equal contents are one entry that is split where pieces run out, so steps follow lengths and not pieces."""
    open_: dict[int, list[list]] = {}
    gaps: list[int] = []

    def add(gap: int, times: int, lengths: list[int]) -> None:
        if gap not in open_:
            open_[gap] = []
            bisect.insort(gaps, gap)
        open_[gap].append([times, lengths])

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            k = bisect.bisect_left(gaps, x)
            if k == len(gaps):
                full, rest = divmod(n, size // x)
                for times, pieces in ((full, size // x), (min(rest, 1), rest)):
                    if times:
                        add(size - pieces * x, times, [x] * pieces)
                break
            gap = gaps[k]
            entry = open_[gap][-1]
            times = min(n, entry[0])
            n, entry[0] = n - times, entry[0] - times
            if not entry[0]:
                open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[k]
            add(gap - x, times, [*entry[1], x])
    return [(times, lengths) for entries in open_.values() for times, lengths in entries]


def _exact(counts: dict[int, int], size: int, floor: int) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """Patterns of exact combinations, and the counts that are left: all single complements, then pairs and triples in the gaps of lengths
    of at least ``floor``."""
    left, patterns = np.zeros(size + 1, np.int64), []
    for length, n in counts.items():
        left[length] = n
    sums = Sums(left)
    single = lambda gap, first: (gap,) if sums.has(gap, first) else None
    for look, low in ((single, 1), (sums.pair, floor), (sums.find, floor)):
        for first in range(size, low - 1, -1):
            while left[first]:
                more = look(size - first, first) if first < size else ()
                if more is None:
                    break
                lengths = [first, *more]
                times = min(int(left[x]) // k for x, k in Counter(lengths).items())
                for x in lengths:
                    left[x] -= times
                patterns.append((times, lengths))
    return patterns, {int(x): int(left[x]) for x in np.flatnonzero(left)}


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Patterns (how often, lengths) that use up counts; no pattern's lengths sum to over size.

    Pairs and triples that fill a gap exactly may take short pieces that later gaps need. So several plans are made, whose exact
    combinations go down to different lengths, and the shortest one is taken: of equal ones that with the most exact combinations.
    One of them has single complements only, which best fit would choose anyway, so no plan is longer than best fit's.
    """
    tries = [_greedy(counts, size)]
    for floor in (*(size * k // 16 for k in (6, 10, 12, 14)), size + 1):
        exact, rest = _exact(counts, size, max(1, floor))
        tries.append(exact + best_fit(rest, size))
    return min(tries, key=lambda patterns: sum(n for n, _ in patterns))


def _greedy(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Lengths from the longest down, each with an exact combination if there is one, else with what fills most of its gap."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, patterns = Sums(left), []
    for first in range(size, 0, -1):
        while left[first]:
            gap = size - first
            more = sums.find(gap, first) if gap else ()
            if more is None:
                left[first] -= 1
                more = tuple(fullest(left, gap))
                left[first] += 1
            lengths = [first, *more]
            times = min(int(left[x]) // k for x, k in Counter(lengths).items())
            for x in lengths:
                left[x] -= times
            patterns.append((times, lengths))
    return patterns


def slots(patterns: list[tuple[int, list[int]]], rounds: int = 1) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, offset) of each place in each pattern, patterns dealt evenly over rounds."""
    rank, out, sequence = Counter(), [], 0
    for k in range(rounds):
        for n, lengths in patterns:
            times, offset = (k + 1) * n // rounds - k * n // rounds, 0
            if not times:
                continue
            for x in lengths:
                out.append((x, rank[x], rank[x] + times, sequence, offset))
                rank[x] += times
                offset += x
            sequence += times
    return out


class Encoder:
    """Ids of a text by a tokenizers file. Its rank file, where there is one, gives the same ids several times faster."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks):
            import base64

            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
            self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special) or has_long_run(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, order: Column | None = None) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids as little-endian unsigned 32-bit, task, nth) as a written table.

    With an order (a long: file number << 40 | row of the file), task is the place of the first of successive rows of a file, so that
    (task, nth) follows the order, and at is each row's own place.
    """
    schema = "doc_id long, piece int, start long, length int, ids binary, task long, nth long, at long"

    def run(batches):
        encode, nth, task, last = Encoder(tokenizer), Counter(), TaskContext.get().partitionId(), None
        for b in batches:
            cols = ([], [], [], [], [], [], [], [])
            for doc, text, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if at is not None and (last is None or at != last + 1):
                    nth, task = Counter(), at
                last = at
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                cut = len(ids) % size or size
                ends = range(cut, len(ids) + 1, size)
                for k, e in enumerate(ends):
                    s = 0 if k == 0 else e - size
                    for c, v in zip(cols, (doc, k, s, e - s, ids[s:e].tobytes(), task, nth[e - s], at), strict=True):
                        c.append(v)
                    nth[e - s] += 1
                if len(cols[0]) >= 4096:
                    yield _batch(cols)
                    cols = ([], [], [], [], [], [], [], [])
            if cols[0]:
                yield _batch(cols)

    def _batch(cols):
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids", "task", "nth", "at"])

    return written(docs.select(F.col("doc_id").cast("long"), "text", (F.lit(None) if order is None else order).cast("long").alias("at")).mapInArrow(run, schema), "pieces")


def file_order(docs: DataFrame) -> Column:
    """The place of a row in the Parquet files that docs were read from: their part number, then the row's number."""
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    return F.shiftleft(part, 40) + F.col("_metadata.row_index")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """pieces() with their place: doc_id, piece, start, length, ids, sequence_id, offset. Ids that aren't selected aren't read."""
    return _place(pieces(docs, tokenizer, size, end), size, 1).drop("at")


def pack_in_order(docs: DataFrame, tokenizer: str, order: Column, ids: Column, size: int = SIZE, end: int = END, rounds: int = 32) -> DataFrame:
    """Like pack(), with sequences numbered by their earliest piece in the order, and ids taken as given before rows are shuffled.

    Pieces of a length are used in the order, and each pattern's uses are spread over ``rounds``, so that a sequence's pieces come from
    about the same part of the order.
    """
    placed = _place(pieces(docs, tokenizer, size, end, order), size, rounds)
    placed = written(placed.withColumn("ids", ids), "pieces-placed")
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    firsts = placed.groupBy("sequence_id").agg(F.min(F.struct("at", "piece")).alias("first")).repartitionByRange(parts, "first", "sequence_id").sortWithinPartitions("first", "sequence_id")

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))], ["old", "part", "nth"])
            n += b.num_rows

    numbered = written(firsts.select("sequence_id").mapInArrow(number, "old long, part int, nth long"), "sequence-order")
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    numbers = numbered.join(F.broadcast(before), "part").select(F.col("old").alias("sequence_id"), (F.col("before") + F.col("nth")).alias("number"))
    return placed.join(numbers, "sequence_id").select("doc_id", "piece", "start", "length", "ids", F.col("number").alias("sequence_id"), "offset")


def _place(made: DataFrame, size: int, rounds: int) -> DataFrame:
    """pack()'s columns and at, of the written pieces."""
    spark = made.sparkSession
    by_task = written(made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    table = spark.createDataFrame(slots(plan(counts, size), rounds), "length int, lo long, hi long, first long, offset long")
    running = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    ranked = made.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", ranked["length"].cast("long").alias("length"), "ids", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", "at")


def sequences(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The packed sequences themselves: (sequence_id, length, ids as little-endian unsigned 32-bit)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x["ids"]))
    return pack(docs, tokenizer, size, end).groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    placed = pack(docs, default_tokenizer())
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")

