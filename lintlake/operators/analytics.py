"""Counts, shares, rankings and gates over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import SEVERITIES, severity_rank
from ..sources.files import kept
from .kernel import ORDER


def short_type(kind: Column) -> Column:
    """What stands before a colon that is not the first character."""
    return F.when(F.instr(kind, ":") > 1, F.trim(F.substring_index(kind, ":", 1))).otherwise(kind)


def counts() -> list[Column]:
    """total and a count per severity."""
    return [F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES)]


def summary(findings: DataFrame) -> DataFrame:
    """One row: total and a count per severity."""
    return findings.agg(*counts())


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def shares(findings: DataFrame) -> DataFrame:
    """severity, n, total, percent, bar: cells of ten, half up.  Counts first, so that the total runs over a row per severity."""
    counts = by_severity(findings).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return counts.withColumns({"percent": F.col("n") / F.col("total") * 100, "bar": F.floor(F.col("n") / F.col("total") * 10 + 0.5).cast("int")})


def by_owasp(findings: DataFrame) -> DataFrame:
    """Counts per category; findings without one are left out."""
    return findings.where(F.col("owasp_category").isNotNull()).groupBy("owasp_category").agg(F.count("*").alias("n"))


def grouped_by_owasp(findings: DataFrame) -> DataFrame:
    """Counts per category, findings without one as Others."""
    return findings.groupBy(F.coalesce("owasp_category", F.lit("Others")).alias("owasp_category")).agg(F.count("*").alias("n"))


def top_types(findings: DataFrame, n: int = 8) -> DataFrame:
    """The n most frequent short types (of equal ones the one that comes first) and the rest as Others: kind, n, kinds.  A row per type reaches the ranking."""
    counts = findings.groupBy(short_type(F.col("type")).alias("kind")).agg(F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("first"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "first")))
    return ranked.groupBy(F.when(F.col("place") <= n, F.col("kind")).otherwise("Others").alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.min("place").alias("place"))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of this severity or a worse one."""
    return findings.where(severity_rank(F.col("severity")) >= 4 - SEVERITIES.index(severity))


def fails(findings: DataFrame, severity: str) -> bool:
    """Whether there is a finding of this severity or a worse one; reads no further than the first."""
    return bool(at_least(findings, severity).limit(1).count())


def files_over(findings: DataFrame, severity: str) -> DataFrame:
    """file, n: files with findings of this severity or a worse one."""
    return at_least(findings, severity).groupBy(F.coalesce("file", F.lit("unknown")).alias("file")).agg(F.count("*").alias("n"))


def first_of_each(findings: DataFrame, n: int | dict[str, int] = 5) -> DataFrame:
    """The first n findings of each severity (or as many as the severity's own n), numbered, with how many more there are.

    Numbers above the largest n are dropped task by task before anything is gathered.  The findings are kept, as they are both counted and numbered.
    """
    findings = kept(findings)
    most = n if isinstance(n, dict) else dict.fromkeys(SEVERITIES, n)
    limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in most.items() for x in pair)), F.col("severity")), F.lit(0))
    counts = by_severity(findings).withColumn("more", F.greatest(F.col("n") - limit, F.lit(0))).drop("n")
    numbered = findings.withColumn("number", F.row_number().over(Window.partitionBy("severity").orderBy(*ORDER)))
    first = numbered.where(F.col("number") <= max(most.values())).where(F.col("number") <= limit)
    return first.join(F.broadcast(counts), "severity")  # a row per severity


def attack_surface(findings: DataFrame) -> DataFrame:
    """One row of flags: which kinds of attack the findings' types open."""
    kind = F.lower(F.col("type"))
    any_of = lambda *words: F.coalesce(F.bool_or(kind.rlike("|".join(words))), F.lit(False))
    # The words that tell each kind.
    return findings.agg(any_of("injection").alias("injection"), any_of("xss").alias("xss"), any_of("auth").alias("auth"), any_of("secret", "key").alias("secrets"), any_of("crypto", "md5", "sha1").alias("crypto"))


def pod_standards(findings: DataFrame) -> DataFrame:
    """One row: findings against the baseline and the restricted pod security standard."""
    return findings.agg(*(F.count_if(F.col("metadata.pss") == p).alias(p) for p in ("baseline", "restricted")))


def summary_of_scan(sources: DataFrame, findings: DataFrame, *more: Column) -> Row:
    """files (that were read), total, a count per severity, and ``more`` aggregates of the same pass over the findings."""
    return Row(files=sources.agg(F.count_distinct("file")).first()[0], **findings.agg(*counts(), *more).first().asDict())


def rollup(findings: DataFrame) -> DataFrame:
    """Counts by scanner and severity with their subtotals (null: all)."""
    return findings.rollup("scanner", "severity").agg(F.count("*").alias("n"))


#: Twofold logarithm of a sketch's registers: 16,384 registers of 4 to 8 bits, whatever is counted.
REGISTERS = 14


def sketched(findings: DataFrame, *by: str, registers: int = REGISTERS) -> DataFrame:
    """n, registers, and sketches ``files`` and ``rules`` of the distinct files and rules, for each value of ``by`` (for one scan and one partition of a table: the row to keep of it).

    Aggregated before the shuffle, so that a group of any size sends one sketch a task.  Null files are not counted.
    """
    return findings.groupBy(*by).agg(F.count("*").alias("n"), F.lit(registers).alias("registers"), F.hll_sketch_agg("file", registers).alias("files"), F.hll_sketch_agg("rule_id", registers).alias("rules"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """n, distinct ``files`` and ``rules``, and ``error`` for each value of ``by``, from rows of ``sketched`` alone: what several scans found is counted once, and no findings are read.

    Sketches of several sizes merge into the smallest.  ``error``: three standard errors of a merged sketch as a share of the count (a standard error is 1.04 by the
    square root of the registers), within which all but about one count in 400 are.
    """
    union = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("registers").alias("registers"), *(F.hll_union_agg(c, True).alias(c) for c in ("files", "rules")))
    error = F.lit(3 * 1.04) / F.sqrt(F.pow(F.lit(2.0), "registers"))
    return union.select(*by, "n", *(F.hll_sketch_estimate(c).alias(c) for c in ("files", "rules")), error.alias("error"))
