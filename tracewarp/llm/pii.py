r"""Personal data: candidate gradient boosting, with DataFrame and SQL functions only.

Four base patterns with exact checks (e-mail, IPv4, card with Luhn, phone) always give their spans. Looser generators
propose more, with overlaps: spaced or spelled-out e-mail addresses, quads with other separators, single and grouped card
numbers inside longer runs, phone numbers without a plus, and long strings of letters and digits that may be secrets. Each
proposal has format features (length, digits, groups, separators, kinds of characters) and context features (characters
around it, cue words before it), all coarse, so that all proposals of a corpus fall into a number of feature combinations
bounded by the product of their cardinalities. Boosted trees (MLlib) are trained on these combinations, weighted with counts.

Labels come from evidence that the features leave out, so the trees can't just repeat it: an e-mail address or phone number
is labelled by its at or plus sign (the base span), a quad by its values with dots, a card number by its Luhn digit, and a secret by a
cue word before it. On documents left out of training, an isotonic regression turns scores into calibrated probabilities, for
each kind. Proposals whose probability is at least ``least`` are redacted as well, unless a base span of
their kind overlaps them or a longer selected proposal of their kind covers them. A card number needs its Luhn digit in any case.

An e-mail address, phone number or quad that may be added has no base span, so its own label is always negative: it is added
only where its features are those of base spans elsewhere.

Positions come from the text split at the pattern: lengths of parts and matches add up to code-point offsets, in chunks, so
that a text with very many matches isn't copied for each. Base spans are found by bisection, and the characters around a
proposal are taken from the text's pieces of ``PIECE`` characters, so that time is nearly linear in matches, in redact()
too. Patterns are written so that no text makes them backtrack: runs are possessive and start where a run starts.

Defined results: a null text is empty; repeated rows each get their result, a text of any length is searched whole; an
empty table gives an empty result; without proposals of both labels no model is trained, and the base spans stand alone; a
kind without held-out proposals adds nothing. Extra columns of redact() are kept whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, unpacked, whole, written

#: The base kinds first. Secrets have no base pattern.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
CHUNK, PIECE = 256, 64

#: The base patterns, equal to plain leftmost search, and a cheap test that a text can match at all.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}

#: The generators of proposals, (kind, pattern, cheap test).
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++", r"@|\(at\)|\[at\]"),
    ("ip", r"(?<![0-9])[0-9]{1,3}+(?:[.,:_][0-9]{1,3}+){3}(?![0-9])", r"[0-9][.,:_][0-9]"),
    ("card", r"(?<![0-9])[0-9](?:[ ./-]{0,2}+[0-9]){11,18}+(?![0-9])", r"[0-9][ ./-]{0,2}[0-9]"),
    ("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])", r"[0-9]{13}"),
    ("card", r"(?<![0-9])[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", r"[0-9]{4}[ .-][0-9]{4}"),
    ("phone", r"(?<![0-9+])[+(]{0,2}+[0-9](?:[ ()./-]{0,2}+[0-9]){6,15}+(?![0-9])", r"[0-9][ ()./-]{0,2}[0-9]"),
    ("secret", r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+=*+", r"[A-Za-z0-9_/+-]{16}"),
)

#: Words before personal data; those before a secret, with what may stand between.
CUES = r"(?i)(mail|contact|tel|phone|call|fax|mobile|card|visa|credit|ip|host|server|address)[^\p{L}]{0,4}$"
SECRET_CUES = r"(?i)(token|secret|passwo?r?d|passphrase|credential|bearer|auth|api.?key|access.?key|private.?key)[A-Za-z_]{0,8}[^\p{L}\p{N}]{0,6}$"
FEATURES = ["kind", "length", "digits", "groups", "dots", "dashes", "spaces", "paren", "hex", "cases", "quad", "before", "after", "cue"]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right. Digits of a string, counted from its right end; every second one is doubled."""

    def add(total, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    n = F.char_length(digits)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def quad(s: Column, separators: str = r"\.") -> Column:
    """Whether four numbers are at most 255 each, however many zeros they start with."""
    parts = F.transform(F.split(s, separators), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    return (F.size(parts) == 4) & F.forall(parts, lambda x: (F.char_length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(999)) <= 255))


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return quad(m)
    n = F.char_length(_digits(m))
    return n.between(9, 15) if kind == "phone" else n.between(13, 19) & luhn(_digits(m))


def scanned(items: Column, step, out: str) -> Column:
    """Outputs of a left-to-right pass over items, in their order: step(at, item) gives the next at, an int from 0, and an array of outputs.

    Outputs are gathered by chunks, so an item doesn't copy those of all items before it. ``out`` is their type.
    """
    none = lambda t: F.expr(f"cast(array() as array<{t}>)")

    def chunks(items):
        def inner(acc, x):
            return bound(F.struct(*step(acc["at"], x)), lambda y: F.struct(y["col1"].alias("at"), F.concat(acc["out"], y["col2"]).alias("out")))

        def outer(acc, k):
            part = F.aggregate(F.slice(items, k * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), none(out).alias("out")), inner)
            return bound(part, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), none(f"array<{out}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(items) / CHUNK).cast("int")), start, outer, lambda acc: F.flatten(acc["out"]))

    return bound(items, chunks)


def spans(text: Column, kind: str, pattern: str, test: str) -> Column:
    """Matches of a pattern, leftmost and non-overlapping: array of (kind, start, end, match), offsets in code points."""
    fields = "struct<kind:int,start:int,end:int,match:string>"
    none = F.expr(f"cast(array() as array<{fields}>)")

    def step(at, x):
        start = at + F.char_length(x["part"])
        end = start + F.coalesce(F.char_length(x["match"]), F.lit(0))
        span = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), x["match"].alias("match"))
        return end, F.when(x["match"].isNull(), none).otherwise(F.array(span))

    pairs = F.arrays_zip(F.split(text, pattern).alias("part"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    return F.when(F.regexp_like(text, F.lit(test)), scanned(pairs, step, fields)).otherwise(none)


def pieces(text: Column) -> Column:
    """The text as an array of pieces of PIECE characters, from which cut() takes any part without walking the text before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, length: Column) -> Column:
    """Characters of a text by its pieces(), from a place counted from 0."""
    inside = start % PIECE
    some = F.slice(parts, F.floor(start / PIECE).cast("int") + 1, F.floor((inside + length + PIECE - 1) / PIECE).cast("int"))
    return F.substring(F.array_join(some, ""), inside + 1, length)


def overlapped(base: Column, c: Column) -> Column:
    """Whether a span of c's kind overlaps c. base is in the order of kind and start, and spans of a kind don't overlap.

    Bisection finds the last span of base that starts before c ends; of its kind, no earlier one ends later.
    """

    def halve(acc, _):
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        b = F.get(base, middle)
        before = (acc["low"] < acc["high"]) & ((b["kind"] < c["kind"]) | ((b["kind"] == c["kind"]) & (b["start"] < c["end"])))
        low = F.when(before, middle + 1).otherwise(acc["low"])
        return F.struct(low.alias("low"), F.when(before, acc["high"]).otherwise(F.least(middle, acc["high"])).alias("high"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(base) + 1)).cast("int"))
    last = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(base).alias("high")), halve, lambda acc: F.get(base, acc["low"] - 1))
    return F.coalesce(bound(last, lambda b: (b["kind"] == c["kind"]) & (b["end"] > c["start"])), F.lit(False))


def distinct(items: Column) -> Column:
    """Sorted, each once. array_distinct() compares structs pair by pair."""
    once = lambda x: F.filter(x, lambda y, i: (i == 0) | (y != F.get(x, i - 1)))
    return bound(F.array_sort(items), once)


def _side(c: Column) -> Column:
    """0 none, 1 space, 2 letter, 3 digit, 4 other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^\p{L}$"), 2).when(c.rlike("^[0-9]$"), 3).otherwise(4)


def _upto(c: Column, most: int) -> Column:
    return F.least(c, F.lit(most))


def _features(c: Column, ahead: Column, after: Column) -> list[Column]:
    """Coarse features of a proposal; each has few values. The characters ahead of it and the one after it are given."""
    m, digits = c["match"], _digits(c["match"])
    count = lambda chars: F.char_length(m) - F.char_length(F.translate(m, chars, ""))
    secret = c["kind"] == KINDS.index("secret")
    length = F.floor(F.log2(F.char_length(m)) * 3)
    own = {
        "kind": c["kind"], "length": F.when(secret, _upto(length, 20)).otherwise(0), "digits": F.when(secret, F.floor(F.char_length(digits) / F.char_length(m) * 5)).otherwise(_upto(F.char_length(digits), 20)),
        "groups": _upto(F.size(F.filter(F.split(m, "[^0-9]+"), lambda x: x != "")), 6), "dots": _upto(count("."), 4), "dashes": _upto(count("-"), 2), "spaces": _upto(count(" "), 2), "paren": count("()") > 0,
        "hex": m.rlike("^[0-9a-fA-F]+$"), "cases": m.rlike("[a-z]").cast("int") + m.rlike("[A-Z]").cast("int") * 2, "quad": (c["kind"] == 1) & quad(m, "[.,:_]"), "before": _side(F.substring(ahead, -1, 1)),
        "after": _side(after), "cue": ~secret & ahead.rlike(CUES),
    }
    return [own[f].cast("int").alias(f) for f in FEATURES]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, tx, base (array of spans) and loose (array of proposals with features, label and free) as a written table.

    A proposal is free if it may be added: no base span of its kind overlaps it, and a card number has its Luhn digit.
    """
    text = F.coalesce("text", F.lit(""))
    checked = lambda k: F.filter(spans(text, k, *BASE[k]), lambda s: _valid(k, s["match"]))
    base = F.concat(*map(checked, BASE_KINDS))
    loose = distinct(F.concat(*(spans(text, *x) for x in LOOSE)))
    found = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tx"), pieces(text).alias("parts"), base.alias("base"), loose.alias("loose"))

    def proposal(c, parts, base):
        around = F.struct(
            cut(parts, F.greatest(c["start"] - 24, F.lit(0)), F.least(c["start"], F.lit(24))).alias("ahead"), cut(parts, c["end"], F.lit(1)).alias("after"), overlapped(base, c).alias("held"),
            (F.char_length(_digits(c["match"])).between(13, 19) & luhn(_digits(c["match"]))).alias("number"),
        )

        def made(x):
            label = F.when(c["kind"] == KINDS.index("card"), x["number"]).when(c["kind"] == KINDS.index("secret"), x["ahead"].rlike(SECRET_CUES)).otherwise(x["held"])
            free = ~x["held"] & ((c["kind"] != KINDS.index("card")) | x["number"])
            return F.struct(c["start"].alias("start"), c["end"].alias("end"), label.cast("int").alias("label"), free.alias("free"), *_features(c, x["ahead"], x["after"]))

        return bound(around, made)

    slim = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    every = bound(F.struct("parts", "base", "loose"), lambda r: F.transform(r["loose"], lambda c: proposal(c, r["parts"], r["base"])))
    return written(found.select("doc_id", "tx", slim.alias("base"), every.alias("loose")), "pii-spans")


def select_candidates(rows: DataFrame, least: float, rounds: int, depth: int) -> DataFrame | None:
    """The feature combinations whose calibrated probability is at least ``least``, with it, or None where no model can be trained."""
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False)).alias("apart")
    tally = rows.select(apart, "label", *FEATURES).groupBy("apart", "label", *FEATURES).agg(F.count(F.lit(1)).alias("weight"))
    tally = written(tally.coalesce(1), "pii-combinations")  # no more rows than combinations of features
    training = tally.where("not apart")
    if training.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.3, minWeightFractionPerNode=0.0, seed=7)
    model = trees.fit(vectors.transform(training.withColumns({"label": F.col("label").cast("double"), "weight": F.col("weight").cast("double")})))
    scored = model.transform(vectors.transform(tally.select(*FEATURES).distinct())).select(*FEATURES, "probability")
    scored = scored.select(*FEATURES, F.element_at(F.split(F.translate(F.col("probability").cast("string"), "[]", ""), ","), 2).cast("double").alias("score"))
    scored = written(scored, "pii-scores")
    apart = written(tally.where("apart").join(scored, FEATURES).select("kind", "score", F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight")), "pii-apart")
    calibrated = []
    for kind in sorted(r["kind"] for r in apart.select("kind").distinct().collect()):
        fit = IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight", predictionCol="chance").fit(apart.where(F.col("kind") == kind))
        calibrated.append(fit.transform(scored.where(F.col("kind") == kind)).select(*FEATURES, "chance"))
    if not calibrated:
        return None
    every = calibrated[0]
    for more in calibrated[1:]:
        every = every.unionByName(more)
    return every.where(F.col("chance") >= least)


def find_pii(docs: DataFrame, least: float = 0.9, rounds: int = 16, depth: int = 4) -> DataFrame:
    """doc_id, base and spans (arrays of (kind, start, end) in the order of KINDS, then start) of every row of docs."""
    return _found(docs, least, rounds, depth).select("doc_id", "base", "spans")


def _found(docs: DataFrame, least: float, rounds: int, depth: int) -> DataFrame:
    found = candidates(docs)
    rows = found.select("doc_id", "tx", F.explode("loose").alias("c")).select("doc_id", "tx", "c.*")
    chosen = select_candidates(rows, least, rounds, depth)
    out = found.select("doc_id", "tx", "base")
    if chosen is None:
        spans_ = F.col("base")
    else:
        chosen = F.broadcast(written(chosen.coalesce(1), "pii-chosen"))  # no more rows than combinations of features
        more = rows.where("free").join(chosen.select(*FEATURES), FEATURES, "left_semi").select("doc_id", "tx", "kind", "start", "end").distinct()
        earlier = Window.partitionBy("doc_id", "tx", "kind").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
        more = more.withColumn("far", F.max("end").over(earlier)).where("far is null or far < end").groupBy(F.col("doc_id").alias("id"), F.col("tx").alias("hash"))
        more = more.agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
        out = out.join(more, out["doc_id"].eqNullSafe(more["id"]) & (out["tx"] == more["hash"]), "left")
        spans_ = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))
    return out.select("doc_id", "tx", F.array_sort("base").alias("base"), F.array_sort(spans_).alias("spans"))


def written_spans(c: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, least: float = 0.9, rounds: int = 16, depth: int = 4) -> DataFrame:
    """docs with every span of find_pii() replaced by [KIND]; overlapping spans become one, named by the first."""
    found = _found(docs, least, rounds, depth).select(F.col("doc_id").alias("id"), F.col("tx").alias("hash"), "spans").dropDuplicates(["id", "hash"])
    rows = docs.select(whole(docs), F.col("doc_id").cast("long").alias("key"), F.xxhash64("text").alias("tx"))
    both = rows.join(found, F.col("key").eqNullSafe(F.col("id")) & (F.col("tx") == F.col("hash")), "left")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    text = F.coalesce("whole.text", F.lit(""))

    def step(at, s):  # a span that starts before the furthest end so far belongs to the one before it
        opens = s["start"] >= at
        made = F.struct(at.alias("at"), F.greatest(at, -s["back"]).alias("end"), F.when(opens, s["start"] - at).otherwise(0).alias("gap"), F.when(opens, s["kind"]).otherwise(-1).alias("kind"))
        return F.greatest(at, -s["back"]), F.array(made)

    def replaced(r):  # the text between spans and their names, then what follows the last one
        part = lambda x: F.when(x["kind"] >= 0, F.concat(cut(r["parts"], x["at"], x["gap"]), F.get(names, x["kind"]))).otherwise("")
        end = F.get(r["steps"], F.size(r["steps"]) - 1)["end"]
        return F.concat(F.array_join(F.transform(r["steps"], part), ""), F.substring(text, end + 1, F.char_length(text)))

    steps = scanned(by_start, step, "struct<at:int,end:int,gap:int,kind:int>")
    done = F.when(F.size("spans") > 0, bound(F.struct(steps.alias("steps"), pieces(text).alias("parts")), replaced)).otherwise(text)
    return both.select(*unpacked(docs, text=done))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of_kind = lambda i: F.filter("base", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"))
