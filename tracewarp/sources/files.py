"""Readers of sequence and model files, by Spark's text source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seq import revcomp


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, len) of each record; U is read as T, and a record without a name gets an empty one."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    parts = F.split("value", r"\r?\n", 2)
    seq = F.translate(F.regexp_replace(F.get(parts, F.lit(1)), r"\s", ""), "Uu", "Tt")
    return rows.select(F.coalesce(F.get(F.split(F.get(parts, F.lit(0)), r"\s"), F.lit(0)), F.lit("")).alias("name"), seq.alias("seq")).withColumn("len", F.char_length("seq"))


def read_fasta_tiles(spark: SparkSession, path: str, size: int = 1 << 20, overlap: int = 0, block: int = 4096) -> DataFrame:
    """(file, line, name, at, seq): the records of FASTA files in tiles of ``size`` letters, each with the next ``overlap`` ones too, so that a
    long record is never one row. line is that of the record's header, which tells records of one name apart; at counts letters.

    Lines are numbered, and a line's place in its record is a running sum of letters, first within a block of lines and then over
    the blocks' sums. A record without letters has no tile; letters before the first header belong to no record and go.
    """
    lines = numbered_lines(spark, path).withColumn("block", F.floor(F.col("line") / block))
    head = F.col("value").startswith(">")
    lines = lines.withColumns({"head": head, "seq": F.when(head, "").otherwise(F.translate(F.regexp_replace("value", r"\s", ""), "Uu", "Tt"))})
    inside = Window.partitionBy("file", "block").orderBy("line")
    before = F.coalesce(F.sum(F.char_length("seq")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.withColumn("letters", before)
    last = lambda c: F.max(F.when(F.col("head"), F.col(c))).over(inside)
    rows = rows.withColumns({"head_line": last("line"), "head_letters": last("letters")})
    sums = rows.groupBy("file", "block").agg(F.sum(F.char_length("seq")).alias("n"), F.max("head_line").alias("block_line"), F.max("head_letters").alias("block_letters"))
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("from", F.coalesce(F.sum("n").over(past), F.lit(0)))  # a row a block
    sums = sums.withColumns({"past_line": F.max("block_line").over(past), "past_letters": F.max(F.col("from") + F.col("block_letters")).over(past)})
    placed = rows.join(sums.select("file", "block", "from", "past_line", "past_letters"), ["file", "block"])
    record = F.coalesce("head_line", "past_line")
    start = F.coalesce(F.col("from") + F.col("head_letters"), F.col("past_letters"))
    placed = placed.select("file", record.alias("record"), (F.col("from") + F.col("letters") - start).alias("pos"), "seq", "head", "value")
    names = placed.where("head").select("file", "record", F.split_part(F.regexp_replace(F.substr("value", F.lit(2)), r"\s", " "), F.lit(" "), F.lit(1)).alias("name"))
    found = placed.where("seq <> '' and record is not null").select("file", "record", "pos", "seq")
    tiles = overlapping(found.withColumn("n", F.char_length("seq")), ["file", "record"], "pos", "n", size, 0, overlap)
    cut = F.substring("seq", F.col("low") + 1, F.col("high") - F.col("low"))
    parts = tiles.select("file", "record", "tile", F.struct((F.col("pos") + F.col("low")).alias("at"), cut.alias("seq")).alias("p"))
    whole = parts.groupBy("file", "record", "tile").agg(F.array_sort(F.collect_list("p")).alias("p"))
    whole = whole.select("file", "record", (F.col("tile") * size).alias("at"), F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))
    return whole.join(names, ["file", "record"]).select("file", F.col("record").alias("line"), "name", "at", "seq")


def overlapping(rows: DataFrame, keys: list[str], at: str, n: str, size: int, back: int, ahead: int) -> DataFrame:
    """rows, each a run of n places from at, for every tile of ``size`` places that they touch, with the next ``ahead`` and the last ``back`` ones:
    tile, and the places low (included) to high of the run that the tile has."""
    first = F.greatest(F.floor((F.col(at) - ahead) / size), F.lit(0))
    last = F.floor((F.col(at) + F.col(n) - 1 + back) / size)
    rows = rows.where(F.col(n) > 0).select("*", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("tile"))
    low = F.greatest(F.lit(0), F.col("tile") * size - back - F.col(at)).cast("int")
    high = F.least(F.col(n), (F.col("tile") + 1) * size + ahead - F.col(at)).cast("int")
    return rows.withColumns({"low": low, "high": high}).where("low < high")


def write_fasta(refs: DataFrame, path: str) -> None:
    refs.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path)


def read_pore_model(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, code, level_mean, level_stdv, sd_mean, sd_stdv) of a tab-separated model of two or five columns, with or without header
    lines; columns that aren't there are null. The code has two bits a base, so k is the length of the k-mers themselves."""
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|kmer)") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    kmer = F.get("p", F.lit(0))
    digits = F.translate(F.regexp_replace(F.upper(kmer), "[^ACGTU]", "A"), "ACGTU", "01233")
    numbers = [F.get("p", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("level_mean", "level_stdv", "sd_mean", "sd_stdv"), 1)]
    return rows.select(kmer.alias("kmer"), F.conv(digits, 4, 10).cast("long").alias("code"), *numbers)


def read_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """(place, day, value) of comma-separated lines without a header; months and days of one digit are read too."""
    rows = spark.read.csv(path, schema="place string, day string, value double")
    return rows.withColumn("day", F.try_to_date("day", "yyyy-M-d") if hasattr(F, "try_to_date") else F.to_date("day", "yyyy-M-d"))


def write_decisions(decided: DataFrame, path: str) -> None:
    """Decisions (is_target, source, read_id, final_len, last_score, keep) as tab-separated text, each part with a header line."""
    decided.select("is_target", "source", "read_id", "final_len", "last_score", "keep").write.csv(path, sep="\t", header=True)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(file, signal) of text files with one number a line; lines keep their order within a file."""
    rows = spark.read.text(path, wholetext=True)
    numbers = F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), numbers.alias("signal"))


def write_fastq(reads: DataFrame, path: str) -> None:
    """Rows (read_id, seq, qual) as four lines each."""
    reads.select(F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines with their 0-based number in the file, whatever the number of splits it is read in.

    A split's lines are consecutive in its task, so a line's place is its id less the split's lowest one, plus the lines of the
    splits before; only a row a split is sorted for that.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("id"), "value")
    splits = lines.groupBy("file", "start").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(splits, ["file", "start"]).select("file", (F.col("id") - F.col("low") + F.col("before")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, read_id, seq, qual) of files with four lines a record; gzip is read by suffix. Lines are numbered, so large
    files are split and quality lines may look like headers; an incomplete last record is left out."""
    rows = numbered_lines(spark, path).withColumns({"nth": F.floor(F.col("line") / 4), "part": F.col("line") % 4})
    part = lambda i: F.max(F.when(F.col("part") == i, F.col("value")))
    records = rows.groupBy("file", "nth").agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual")).where("qual is not null")
    return records.select("file", "nth", F.split_part(F.substr("head", F.lit(2)), F.lit(" "), F.lit(1)).alias("read_id"), F.translate("seq", "Uu", "Tt").alias("seq"), "qual")


def lock_step(one: DataFrame, two: DataFrame) -> DataFrame:
    """The i-th records of the n-th files of two sides, in order of their names; the shorter file ends the result."""

    def side(df, n):
        files = df.select("file").distinct().select("file", F.row_number().over(Window.orderBy("file")).alias("pair"))  # a row a file
        return df.join(files, "file").select("pair", "nth", F.col("read_id").alias(f"read_id_{n}"), F.col("seq").alias(f"seq_{n}"))

    return side(one, 1).join(side(two, 2), ["pair", "nth"]).drop("pair")


def write_sam(rows: DataFrame, refs: DataFrame, path: str, program: str = "tracewarp") -> None:
    """Rows (read_id, strand, ref_id, t_start, mapq, cigar, seq, qual) as alignment text in parts, of which the first has the header lines,
    with refs (ref_id, len): the parts one after the other are one file.

    With columns q_start and q_end (excluded) the ends of a sequence that aren't aligned are soft-clipped, with nm and md these tags follow.
    Sequences and qualities on strand 1 are reversed, their clips too; unmapped rows have flag 4 and no cigar.
    """
    names = refs.select(F.lit(1).alias("turn"), F.concat(F.lit("@SQ\tSN:"), F.col("ref_id").cast("string"), F.lit("\tLN:"), F.col("len").cast("string")).alias("value"))
    ends = refs.sparkSession.createDataFrame([(0, "@HD\tVN:1.6\tSO:unknown"), (2, f"@PG\tID:{program}\tPN:{program}")], "turn int, value string")
    lost, back = F.col("ref_id").isNull(), F.coalesce(F.col("strand") == 1, F.lit(False))
    flag = F.when(lost, 4).when(back, 16).otherwise(0)
    text = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    place = F.when(lost, 0).otherwise(F.col("t_start") + 1)
    cigar = text("cigar", "*")
    if {"q_start", "q_end"} <= set(rows.columns):
        clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
        left, right = clip(F.col("q_start")), clip(F.char_length("seq") - F.col("q_end"))
        cigar = F.when(F.col("cigar").isNull(), "*").otherwise(F.when(back, F.concat(right, "cigar", left)).otherwise(F.concat(left, "cigar", right)))
    seq, qual = F.when(back, revcomp(F.col("seq"))).otherwise(F.col("seq")), F.when(back, F.reverse("qual")).otherwise(F.col("qual"))
    fields = [F.col("read_id").cast("string"), flag.cast("string"), text("ref_id", "*"), place.cast("string"), text("mapq", "0"), F.when(lost, "*").otherwise(cigar), F.lit("*"), F.lit("0"), F.lit("0"), seq, qual]
    fields += [F.concat(F.lit(tag), F.col(c).cast("string")) for c, tag in (("nm", "NM:i:"), ("md", "MD:Z:")) if c in rows.columns]
    header = names.union(ends).coalesce(1).sortWithinPartitions("turn", "value").select("value")  # a line a reference
    header.union(rows.select(F.concat_ws("\t", *fields).alias("value"))).write.text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(file, metric, value) of report lines such as 'name: 1.5' or 'name = 1.5'; lines of another form are skipped."""
    form = r"^\s*([A-Za-z][^:=]*?)\s*[:=]\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    rows = spark.read.text(path).where(F.col("value").rlike(form))
    return rows.select(F.input_file_name().alias("file"), F.regexp_extract("value", form, 1).alias("metric"), F.regexp_extract("value", form, 2).cast("double").alias("value"))
