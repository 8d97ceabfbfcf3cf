"""Source divergence audit: wide term vectors.

Tasks count the terms of their documents and send one row for each (lang, source, term) they have met. A term that enough documents
of its language have becomes one row: its counts as an array with a place for each source of the language. Higher-order
functions turn such an array into shares p and into the contributions of all pairs of sources, which partial aggregation sums
before they are shuffled. The terms that stand out most in a source come from the same arrays, by a rank that tasks apply first.

All arithmetic is exact: a share is a long division by thousands, so counts may reach 9e15; squares stay below 2^62.

Languages are few and one may hold a third of all rows, so no row of a term is keyed by language alone: totals are sums with partial
aggregation, and go to the terms by a look-up that leaves frequent languages' rows where they are.

Defined results: null text, lang and source are ''; a row is a document, whatever its doc_id, so repeated rows count again. A
(lang, source) without terms, or of a language without kept terms (V = 0), has its pair rows, with shares of 1 + floor(2e9 / (N + 2 V))
and with 0 where V = 0. A language with one source has no pair rows. Equal values rank by the item's UTF-8 bytes. Texts of any length are
counted whole, block by block. An empty table gives an empty result. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, skew_join, written

MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Bytes of a text that are split at a time, and distinct (lang, source, term) that a task holds before it sends them on.
BLOCK, HELD = 1 << 20, 200_000
#: Letters of terms: A-Z lower-cased, a-z and all bytes of non-ASCII characters; other bytes become spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a text in UTF-8."""
    found, at, letters = Counter(), 0, text.translate(LETTERS)
    while at < len(letters):
        end = letters.find(b" ", min(len(letters), at + BLOCK))
        end = len(letters) if end < 0 else end
        found.update(letters[at:end].split())
        at = end
    return found


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): what each task has counted; a null term stands for the group itself."""

    def rows(held):
        keys = [(lang, source, term.decode()) for (lang, source), (terms, _) in held.items() for term in terms] + [(*group, None) for group in held]
        n = [x for terms, _ in held.values() for x in terms.values()] + [0] * len(held)
        d = [seen[t] for terms, seen in held.values() for t in terms] + [0] * len(held)
        columns = [*(list(c) for c in zip(*keys, strict=True)), n, d]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTS, strict=True)], schema=COUNTS)

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in batches:
            for text, lang, source in zip(*b.columns, strict=True):
                terms, seen = held.setdefault((lang.as_py() or "", source.as_py() or ""), (Counter(), Counter()))
                found = term_counts(text.as_py() or b"")
                terms.update(found)
                seen.update(found.keys())
            if sum(len(terms) for terms, _ in held.values()) > HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    return docs.select(F.col("text").cast("binary"), "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 n / total) for 0 <= n <= total, by three steps of a long division."""

    def digits(high: Column, rest: Column, steps: int) -> Column:
        return bound(rest * 1000, lambda r: digits(high * 1000 + _div(r, total), r % total, steps - 1)) if steps else high

    return F.lit(1).cast("long") + digits(_div(n, total), n % total, 3)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def wide_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, term, counts: array of (source, n)) and the groups (lang, source), both as written tables."""
    counted = written(partial_counts(docs), "term-counts")
    groups = written(counted.where("term IS NULL").select("lang", "source").distinct(), "term-groups")
    by_source = counted.where("term IS NOT NULL").repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    wide = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return written(wide.where(F.col("docs") >= min_docs).select("lang", "term", "counts"), "wide-terms"), groups


def shares(wide: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, term, n, p: both source-indexed, q: the language's share), and for each language (lang, sources, totals, total, v)."""
    totals = wide.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    v = wide.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    listed = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("s"))
    heads = listed.join(v, "lang", "left").select("lang", F.col("s.source").alias("sources"), F.col("s.total").alias("totals"), F.coalesce("v", F.lit(0)).alias("v"))
    heads = written(heads.withColumn("total", F.aggregate("totals", F.lit(0).cast("long"), lambda a, x: a + x)), "term-heads")
    rows = skew_join(wide, heads, ["lang"], "inner")
    by_source = F.map_from_entries("counts")
    dense = bound(by_source, lambda m: F.transform("sources", lambda s: F.coalesce(F.try_element_at(m, s), F.lit(0).cast("long"))))
    rows = rows.withColumn("n", dense)
    p = F.transform(F.arrays_zip("n", "totals"), lambda x: share(x["n"] + 2, x["totals"] + 2 * F.col("v")))
    q = share(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x) + 2, F.col("total") + 2 * F.col("v"))
    return rows.select("lang", "term", "sources", "n", p.alias("p"), q.alias("q")), heads


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and its most telling terms."""
    wide, groups = wide_terms(docs, min_docs)
    rows, heads = shares(wide, groups)
    rows = written(rows, "term-shares")
    last = F.size("p") - 1
    pairs = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: F.struct(i.alias("i"), j.alias("j"), divergence(F.get("p", i), F.get("p", j)).alias("f"))))
    sums = rows.where(last > 0).select("lang", F.explode(F.flatten(pairs)).alias("x")).groupBy("lang", "x.i", "x.j").agg(F.sum("x.f").alias("value"))
    places = F.sequence(F.lit(0), F.size("sources") - 1)
    every = heads.select("lang", "sources", F.explode(places).alias("k")).select("lang", "sources", "k", F.explode(places).alias("other")).where("k <> other")
    every = every.select("lang", F.get("sources", "k").alias("source"), F.get("sources", "other").alias("item"), F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"))
    pair = every.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    cells = F.filter(F.transform("sources", lambda s, k: F.struct(s.alias("source"), F.get("n", k).alias("n"), F.get("p", k).alias("p"))), lambda x: (x["n"] > 0) & (x["p"] > F.col("q")))
    term = rows.select("lang", "term", "q", F.explode(cells).alias("x")).select("lang", "x.source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("x.p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pair, term)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word
  FROM documents),
w AS (SELECT row, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM t),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
cell AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(total.total, 0) + 2 * v.v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN total USING (lang, source)),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // ((SELECT sum(total) FROM total t WHERE t.lang = cell.lang) + 2 * any_value(v)) AS q
  FROM cell JOIN v USING (lang) GROUP BY lang, term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN cell x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN cell y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM cell JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
