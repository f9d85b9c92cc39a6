"""Manifests against advisories: package.json, requirements.txt and go.mod."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import severity_rank, trimmed
from ..rules.catalogue import A06
from .kernel import FINDING, metadata
from .versions import version_key

# Ecosystem, package, affected versions (empty: all), severity.
ADVISORIES = (
    ("npm", "lodash", "<4.17.21", "high"),
    ("npm", "axios", "<1.6.0", "medium"),
    ("npm", "express", "<4.18.0", "medium"),
    ("npm", "jsonwebtoken", "<9.0.0", "high"),
    ("npm", "minimist", "<1.2.6", "high"),
    ("npm", "node-fetch", "<2.6.7", "medium"),
    ("npm", "qs", "<6.10.3", "high"),
    ("npm", "serialize-javascript", "<3.1.0", "high"),
    ("npm", "ua-parser-js", "", "critical"),
    ("npm", "event-stream", "", "critical"),
    ("pip", "pyyaml", "", "critical"),
    ("pip", "django", "", "high"),
    ("pip", "flask", "", "medium"),
    ("pip", "requests", "", "medium"),
    ("pip", "urllib3", "", "medium"),
    ("go", "github.com/dgrijalva/jwt-go", "", "high"),
)


def advisories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ADVISORIES), "ecosystem string, package string, affected string, severity string")


def npm_dependencies(manifests: DataFrame) -> DataFrame:
    """file, package, version: of each package.json; a package of both lists counts with its development version."""
    parsed = manifests.select("file", F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>").alias("p"))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    dev, own = F.coalesce("p.devDependencies", empty), F.coalesce("p.dependencies", empty)
    merged = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(dev, k)), dev)
    return parsed.select("file", F.explode(merged).alias("package", "version"))


def requirements(manifests: DataFrame) -> DataFrame:
    """file, line, package: the name at the start of each line of requirements.txt, in lower case."""
    lines = manifests.select("file", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("file", "line", F.lower(F.regexp_extract("line", "^([a-zA-Z0-9_-]+)", 1)).alias("package")).where("package != ''")


def _as_findings(found: DataFrame) -> DataFrame:
    """FINDING columns, and ecosystem, package, version beside them."""
    named = found.withColumns({
        "language": F.lit(None).cast("string"), "scanner": F.lit("dependencies"), "rule_id": F.concat_ws(":", "ecosystem", "package"), "rule_no": F.lit(900), "match_seq": F.lit(0), "severity_rank": severity_rank(F.col("severity")), "line": F.lit(None).cast("int"),
        "owasp_category": F.when(F.col("ecosystem") == "npm", A06), "cwe_id": F.when(F.col("ecosystem") == "npm", "CWE-1104"), "metadata": F.when(F.lit(False), metadata()),
    })
    return named.select(*FINDING, "ecosystem", "package", "version")


def dependency_findings(manifests: DataFrame) -> DataFrame:
    """FINDING columns beside ecosystem, package, version; manifests: file (path), text.

    Advisories are few and fixed, so the joins with them broadcast that side.
    """
    spark, name = manifests.sparkSession, F.element_at(F.split("file", "/"), -1)
    known = advisories(spark)
    of = lambda ecosystem: F.broadcast(known.where(F.col("ecosystem") == ecosystem))
    npm = npm_dependencies(manifests.where(name == "package.json")).join(of("npm"), "package")
    npm = npm.where((F.col("affected") == "") | (version_key(F.col("version")) < version_key(F.col("affected"))))
    npm = npm.withColumn("match", F.concat_ws("@", "package", "version"))
    pip = requirements(manifests.where(name == "requirements.txt")).join(of("pip"), "package").withColumns({"version": F.lit(None).cast("string"), "match": trimmed(F.col("line"))})
    go = manifests.where(name == "go.mod").join(of("go"), F.contains("text", "package")).withColumns({"version": F.lit(None).cast("string"), "match": F.col("package")})
    columns = ["file", "ecosystem", "package", "version", "severity", "match", "affected"]
    found = npm.select(*columns).unionByName(pip.select(*columns)).unionByName(go.select(*columns))
    label = F.when(F.col("ecosystem") == "npm", "Vulnerable Package: ").when(F.col("ecosystem") == "pip", "Vulnerable Python Package: ").otherwise("Vulnerable Go Package: ")
    message = F.when(F.col("affected") == "", "No version of this package is known to be safe here.").otherwise(F.concat(F.lit("Versions "), F.col("affected"), F.lit(" have known vulnerabilities.")))
    fix = F.when(F.col("ecosystem") == "go", "Move to a maintained module.").when(F.col("affected") == "", "Update to the latest release, or replace the package.").otherwise(F.concat(F.lit("Update to "), F.substring("affected", 2, 20), F.lit(" or later.")))
    return _as_findings(found.withColumns({"type": F.concat(label, "package"), "message": message, "fix": fix}))


def audit_findings(reports: DataFrame) -> DataFrame:
    """FINDING columns beside ecosystem, package, version (the affected range): of stored audit reports in JSON; ``moderate`` is medium, unknown severities are low."""
    shape = "vulnerabilities map<string, struct<severity: string, via: array<string>, range: string, fixAvailable: string>>"
    each = reports.select("file", F.explode(F.from_json("text", shape)["vulnerabilities"]).alias("package", "v"))
    severity = F.when(F.col("v.severity") == "moderate", "medium").when(F.col("v.severity").isin("critical", "high", "low"), F.col("v.severity")).otherwise("low")
    title, ready = F.get_json_object(F.get("v.via", F.lit(0)), "$.title"), F.get_json_object("v.fixAvailable", "$.version")
    fix = F.when(ready.isNotNull(), F.concat(F.lit("Update to "), ready, F.lit("."))).when(F.coalesce(F.col("v.fixAvailable"), F.lit("false")) != "false", "Update to the latest release.").otherwise("Update by hand.")
    return _as_findings(each.select("file", F.lit("npm audit").alias("ecosystem"), "package", F.col("v.range").alias("version"), severity.alias("severity"), F.concat_ws("@", "package", "v.range").alias("match"), F.concat(F.lit("npm audit: "), F.col("package")).alias("type"), F.coalesce(title, F.lit("A vulnerability was found.")).alias("message"), fix.alias("fix")))
