"""Findings beside what is known of their category, weakness and vulnerabilities: left joins that keep every finding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules.catalogue import A01, A02, A03, A05, A06, A07

OWASP = (
    (A01, "Rules of who may do what are not enforced."),
    (A02, "Data is not protected by sound cryptography."),
    (A03, "Untrusted data reaches an interpreter."),
    (A05, "A setting leaves a door open."),
    (A06, "A component with known vulnerabilities is in use."),
    (A07, "Identities or sessions can be taken over."),
)
CWE = (
    ("CWE-22", "A path leaves its folder."),
    ("CWE-79", "Input becomes part of a page."),
    ("CWE-89", "Input becomes part of a command to a database."),
    ("CWE-250", "Code runs with more rights than it needs."),
    ("CWE-287", "Identity is not proved."),
    ("CWE-327", "A broken or risky algorithm is used."),
    ("CWE-732", "A resource is open to too many."),
    ("CWE-798", "A credential is part of the code."),
    ("CWE-1104", "A component is no longer maintained."),
)


def owasp(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OWASP), "owasp_category string, owasp_description string")


def cwe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CWE), "cwe_id string, cwe_description string")


def described(findings: DataFrame) -> DataFrame:
    """With owasp_description and cwe_description, null where nothing is known; both tables are a few fixed rows."""
    spark = findings.sparkSession
    return findings.join(F.broadcast(owasp(spark)), "owasp_category", "left").join(F.broadcast(cwe(spark)), "cwe_id", "left")


def with_vulnerabilities(findings: DataFrame, vulnerabilities: DataFrame, key: str) -> DataFrame:
    """The array ``cve_ids`` resolved to the array ``cves`` of (id, score), in the order of ids.

    key: a column that tells findings apart.  The table of vulnerabilities may be large: the join is left to the planner.
    """
    ids = findings.select(key, F.explode("cve_ids").alias("id"))
    known = ids.join(vulnerabilities, "id").groupBy(key).agg(F.sort_array(F.collect_set(F.struct("id", "score"))).alias("cves"))
    return findings.join(known, key, "left")


def resolved(findings: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """Findings with ``cves``, what is known of the ids in ``cve_ids``; null where there are no ids or none is known.

    Each set of ids is looked up once, however many findings name it; findings without ids take no part in the joins.
    """
    some = F.coalesce(F.size("cve_ids") > 0, F.lit(False))
    named, rest = findings.where(some), findings.where(~some)
    known = with_vulnerabilities(named.select("cve_ids").distinct(), vulnerabilities, "cve_ids")
    return named.join(known, "cve_ids", "left").unionByName(rest, allowMissingColumns=True).select(*findings.columns, "cves")
