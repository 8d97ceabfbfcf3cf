"""Language-model scoring with a hidden Markov model.

The model factors a text exactly: P(text) = P(group sequence) * product of P(token | its group). Each of the ``heads``
most frequent training tokens is a group of its own; every other token, known or not, belongs to one of ``tails``
groups by its last bytes. Latent states emit groups. Heads and tails grow with the square root of the training tokens, so
that the states tell more tokens apart in a larger corpus while their parameters can still be sent to every task; the
token counts inside the groups cover the whole training corpus and grow with it. Inside a tail group, absolute
discounting moves mass from known tokens to unknown ones.

One pass tokenizes the texts into chunks: each chunk has a dictionary of its distinct tokens with their training counts
and its documents as sequences of dictionary positions. Sums over the dictionaries' tokens give corpus counts; these
go back to the chunks, where a co-grouped task scores the base model and rewrites the documents as group
ids. Baum-Welch runs over these: every task adds up its expected counts, a grouped sum over groups merges them (at most
heads + tails rows), and the driver normalises that fixed-size table. The last pass is the scaled
forward recursion. Forward and backward steps run over many documents at once, in time-major order.

Defined results: a null or empty text is the end token alone; every row is scored, and repeated rows count as often as
they occur; rows with a null doc_id are in training; with no training rows N = 0, and the base score is n_tokens * log10(1 / 1);
among equally frequent tokens the smaller bytes become heads; texts of any length are one sequence each; an empty table
gives an empty result. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The end of a text. No word is empty.
STOP = b""


class _Numbers(dict):
    def __missing__(self, token):
        n = self[token] = len(self)
        return n


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows of documents (idx) and rows of dictionaries (k, token, n) by chunk, as a written table."""
    schema = "chunk long, doc_id long, held_out boolean, idx binary, k int, token binary, n long"
    names = ["chunk", "doc_id", "held_out", "idx", "k", "token", "n"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]

    def batch(size, **cols):
        return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(size, t) for c, t in zip(names, kinds, strict=True)], names)

    def flush(chunk, ids, held, seqs, numbers):
        n = np.zeros(len(numbers), np.int64)
        for h, s in zip(held, seqs, strict=True):
            if not h:
                n += np.bincount(s, minlength=len(numbers)) if len(s) * 20 > len(numbers) else 0
        for h, s in zip(held, seqs, strict=True):
            if not h and len(s) * 20 <= len(numbers):
                np.add.at(n, s, 1)
        for i in range(0, len(ids), 2048):
            part = slice(i, i + 2048)
            yield batch(len(ids[part]), chunk=[chunk] * len(ids[part]), doc_id=ids[part], held_out=held[part], idx=[s.tobytes() for s in seqs[part]])
        words = list(numbers)
        for i in range(0, len(words), 65536):
            part = words[i : i + 65536]
            yield batch(len(part), chunk=np.full(len(part), chunk), k=np.arange(i, i + len(part), dtype=np.int32), token=part, n=n[i : i + len(part)])

    def run(batches):
        made, size, ids, held, seqs, numbers = 0, 0, [], [], [], _Numbers()
        task = TaskContext.get().partitionId()
        for b in batches:
            for doc, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                tokens = raw.lower().split()
                tokens.append(STOP)
                ids.append(doc)
                held.append(out)
                seqs.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                size += len(raw)
                if size >= chunk_bytes:
                    yield from flush((task << 32) + made, ids, held, seqs, numbers)
                    made, size, ids, held, seqs, numbers = made + 1, 0, [], [], [], _Numbers()
        if ids:
            yield from flush((task << 32) + made, ids, held, seqs, numbers)

    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return written(docs.select(F.col("doc_id").cast("long"), out, "text").mapInArrow(run, schema), "lm-chunks", "zstd")


def groups_for(n: int) -> tuple[int, int]:
    """(heads, tails) for n training tokens: both grow with its square root; at most 2**20 heads, 50 MB of emissions for six states."""
    heads = min(1 << 20, max(1 << 14, math.isqrt(16 * n)))
    return heads, heads // 16


def _encode(chunks: DataFrame, heads: int | None, tails: int | None) -> tuple[DataFrame, np.ndarray, int]:
    """(documents with base scores and group ids, training count of each group, N)."""
    spark = chunks.sparkSession
    words = chunks.where("token is not null").select("chunk", "k", "token", "n")
    vocabulary = written(words.groupBy("token").agg(F.sum("n").alias("c")), "lm-vocabulary")
    unseen, vocabulary = vocabulary.where("c = 0"), vocabulary.where("c > 0")
    totals = vocabulary.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = totals[0] or 0, totals[1]
    heads, tails = (given or grown for given, grown in zip((heads, tails), groups_for(n), strict=True))
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = sorted(((r["level"], r["n"]) for r in vocabulary.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # 512 rows at most
    above = np.cumsum([x[1] for x in levels])
    least = levels[min(int(np.searchsorted(above, heads)), len(levels) - 1)][0] if levels else 0
    top = vocabulary.where(level >= least).orderBy(F.desc("c"), "token").limit(heads).collect()  # heads rows at most
    head = F.broadcast(spark.createDataFrame([(bytes(r["token"]), i, r["c"]) for i, r in enumerate(top)], "token binary, h int, hc long"))
    group = F.coalesce("h", F.lit(heads) + (F.crc32(F.substring("token", -3, 3)) % tails).cast("int"))
    inside = vocabulary.join(head, "token", "left").select(group.alias("g"), "c", (F.col("c") == 1).cast("long").alias("one"), (F.col("c") == 2).cast("long").alias("two"), F.col("h").isNotNull().alias("is_head"))
    stats = inside.groupBy("g").agg(F.sum("c").alias("gn"), F.count(F.lit(1)).alias("gv"), F.sum("one").alias("n1"), F.sum("two").alias("n2"), F.max("is_head").alias("is_head")).collect()  # heads + tails rows at most
    tail_ones = sum(r["n1"] for r in stats if not r["is_head"])
    tail_twos = sum(r["n2"] for r in stats if not r["is_head"])
    share = min(0.95, max(0.05, tail_ones / max(1, tail_ones + 2 * tail_twos)))
    counts = np.zeros(heads + tails)
    for r in stats:
        counts[r["g"]] = r["gn"]
    table = spark.createDataFrame([(r["g"], float(r["gn"]), float(r["gv"])) for r in stats if not r["is_head"]], "g int, gn double, gv double")
    # a token in many chunks is frequent, so its answers come by broadcast and only the others are shuffled
    logq = F.when(F.col("gn").isNull(), 0.0).when(F.col("c") > 0, F.log10((F.col("c") - share) / F.col("gn"))).otherwise(F.log10(share * F.col("gv") / F.col("gn")))
    known = words.join(head, "token").select("chunk", "k", F.col("hc").alias("c"), F.col("h").alias("g"), F.lit(0.0).alias("logq"))
    tail = vocabulary.unionByName(unseen).join(head, "token", "left_anti").withColumn("h", F.lit(None).cast("int")).select("token", "c", group.alias("g"))
    tail = tail.join(F.broadcast(table), "g", "left").select("token", "c", "g", logq.cast("double").alias("logq"))
    answers = known.unionByName(words.join(head, "token", "left_anti").join(tail, "token").select("chunk", "k", "c", "g", "logq")).withColumnRenamed("chunk", "asker")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        k = right["k"].to_numpy()
        c, g, q = (np.zeros(int(k.max(initial=-1)) + 1, t) for t in (np.int64, np.int32, np.float64))
        for a, name in ((c, "c"), (g, "g"), (q, "logq")):
            a[k] = right[name].to_numpy()
        base = np.log10((c + 1) / (n + v + 1))
        out: dict[str, list] = {x: [] for x in ("n_tokens", "n_known", "base_score", "inside", "ids")}
        for raw in left["idx"].to_pylist():
            idx = np.frombuffer(raw, np.int32)
            out["n_tokens"].append(len(idx))
            out["n_known"].append(int((c[idx] > 0).sum()))
            out["base_score"].append(float(base[idx].sum()))
            out["inside"].append(float(q[idx].sum()))
            out["ids"].append(g[idx].tobytes())
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"]} | {x: pa.array(y, t) for (x, y), t in zip(out.items(), kinds, strict=True)})

    rows = chunks.where("idx is not null").select("chunk", "doc_id", "held_out", "idx")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, ids binary"
    return written(rows.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(score, schema), "lm-groups", "zstd"), counts, n


class Model:
    """Initial, transition and emission probabilities of the latent states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, counts: np.ndarray, states: int, seed: int = 7) -> Model:
        """The group frequencies, shaken differently for each state; states tend to stay."""
        draw = np.random.default_rng(seed).gamma(1.0, 1.0, (len(counts), states)) + 0.05
        emit = (counts[:, None] + 0.1) * draw
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, counts: np.ndarray) -> Model:
        """Normalised expected counts; every group keeps a little mass, in proportion to its frequency."""
        prior = (counts + 1.0) / (counts + 1.0).sum()
        emit, move, start = emit + 5.0 * prior[:, None], move + 0.1, start + 0.1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _slabs(seqs: list[np.ndarray], most: int = 400_000):
    """Documents by falling length, in slabs: their numbers, groups in time-major order, documents alive at each step."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        end, size = at, 0
        while end < len(order) and (end == at or size + len(seqs[order[end]]) <= most):
            size += len(seqs[order[end]])
            end += 1
        who = order[at:end]
        lengths = np.array([len(seqs[i]) for i in who])
        alive = np.bincount(lengths - 1, minlength=lengths[0])[::-1].cumsum()[::-1] if len(who) else np.zeros(0, int)
        first = np.concatenate([[0], alive.cumsum()])
        doc = np.repeat(np.arange(len(who)), lengths)
        step = np.arange(len(doc)) - np.repeat(lengths.cumsum() - lengths, lengths)
        place = first[step] + doc
        groups, owner = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
        groups[place], owner[place] = np.concatenate([seqs[i] for i in who]), doc
        yield who, groups, owner, alive, first
        at = end


def forward(model: Model, groups, alive, first) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward vectors and scales, in time-major order. The log of a document's scales sums to its likelihood."""
    a, scale = model.emit[groups], np.empty(len(groups))
    for t in range(len(alive)):
        now = a[first[t] : first[t + 1]]
        if t:
            now *= a[first[t - 1] : first[t - 1] + alive[t]] @ model.move
        else:
            now *= model.start
        s = now.sum(1)
        now /= s[:, None]
        scale[first[t] : first[t + 1]] = s
    return a, scale


def expected(model: Model, groups, alive, first) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions, and the log-likelihood, of one slab."""
    a, scale = forward(model, groups, alive, first)
    e = model.emit[groups] / scale[:, None]
    move = np.zeros_like(model.move)
    gamma = np.empty_like(a)
    later = None
    for t in range(len(alive) - 1, -1, -1):
        now = a[first[t] : first[t + 1]]
        b = np.ones_like(now)
        if later is not None:
            n = alive[t + 1]
            move += now[:n].T @ later
            b[:n] = later @ model.move.T
        gamma[first[t] : first[t + 1]] = now * b
        later = e[first[t] : first[t + 1]] * b
    emit = np.stack([np.bincount(groups, gamma[:, k], len(model.emit)) for k in range(gamma.shape[1])], 1)
    return gamma[: alive[0]].sum(0), move * model.move, emit, float(np.log(scale).sum())


def train(groups: DataFrame, counts: np.ndarray, states: int, rounds: int) -> tuple[Model, list[float]]:
    """Baum-Welch over the training rows; also the log-likelihood before each round."""
    model, likelihood = Model.initial(counts, states), []
    training = groups.where(~F.col("held_out")).select("ids")

    def tally(batches, model):
        start, move, emit, ll = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit), 0.0
        for b in batches:
            for _, g, _, alive, first in _slabs([np.frombuffer(x, np.int32) for x in b.column(0).to_pylist()]):
                s, m, e, x = expected(model, g, alive, first)
                start, move, emit, ll = start + s, move + m, emit + e, ll + x
        some = np.flatnonzero(emit.sum(1))
        keys = np.concatenate([-np.arange(1, states + 3), some])
        rows = np.concatenate([[np.full(states, ll), start], move, emit[some]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(rows[:, i]) for i in range(states))], ["g", *(f"e{i}" for i in range(states))])

    schema = "g long, " + ", ".join(f"e{i} double" for i in range(states))
    for _ in range(rounds):
        parts = training.mapInArrow(lambda batches, model=model: tally(batches, model), schema)
        sums = parts.groupBy("g").agg(*(F.sum(f"e{i}").alias(f"e{i}") for i in range(states))).collect()  # heads + tails + states + 2 rows at most
        by = {r["g"]: np.array(r[1:]) for r in sums}
        if -1 not in by:
            break
        likelihood.append(float(by[-1][0]))
        emit = np.zeros_like(model.emit)
        for g, x in by.items():
            if g >= 0:
                emit[g] = x
        model = Model.of_counts(by[-2], np.stack([by[-3 - i] for i in range(states)]), emit, counts)
    return model, likelihood


def score_documents(docs: DataFrame, states: int = 6, rounds: int = 3, heads: int | None = None, tails: int | None = None, chunk_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    groups, counts, n = _encode(_chunks(docs, chunk_bytes), heads, tails)
    model, _ = train(groups, counts, states, rounds)

    def run(batches):
        for b in batches:
            ll = np.zeros(b.num_rows)
            for who, g, owner, alive, first in _slabs([np.frombuffer(x, np.int32) for x in b.column("ids").to_pylist()]):
                _, scale = forward(model, g, alive, first)
                ll[who] = np.bincount(owner, np.log(scale), len(who)) / math.log(10)
            total = ll + b.column("inside").to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(total)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = groups.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op2_hmm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
