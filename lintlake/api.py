"""One function per tool: sources in, findings or the lines of an answer out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import is_example, masked
from .operators import enrich, iac, imports, report, rulesets, scripts
from .operators.dependencies import dependency_findings
from .operators.kernel import FINDING, scan
from .operators.remediate import suggestions
from .rules.catalogue import CODE, matched


def _hidden(found: DataFrame) -> DataFrame:
    """Secrets show their ends only."""
    return found.withColumn("match", F.when(F.col("scanner") == "secrets", masked(F.col("match"))).otherwise(F.col("match")))


def _of(sources: DataFrame, *scanners: str) -> DataFrame:
    return scan(sources.select("file", "language", "text"), matched(*scanners))


def scan_security(sources: DataFrame) -> DataFrame:
    """All code scanners over one pass of the texts; secrets are masked."""
    return _hidden(_of(sources, *CODE)).select(*FINDING)


def scan_secrets(sources: DataFrame, examples: bool = True) -> DataFrame:
    """examples: whether values that look like those of a manual count."""
    found = _of(sources, "secrets")
    return _hidden(found if examples else found.where(~is_example(F.col("match"))))


def scan_injection(sources: DataFrame) -> DataFrame:
    return _of(sources, "injection")


def scan_xss(sources: DataFrame) -> DataFrame:
    return _of(sources, "xss")


def scan_crypto(sources: DataFrame) -> DataFrame:
    return _of(sources, "crypto")


def scan_auth(sources: DataFrame) -> DataFrame:
    return _of(sources, "auth")


def scan_path(sources: DataFrame) -> DataFrame:
    return _of(sources, "path")


def scan_dependencies(manifests: DataFrame) -> DataFrame:
    return dependency_findings(manifests)


def scan_iac(sources: DataFrame, kind: str = "auto") -> DataFrame:
    """kind: what the texts are, if not what their names say."""
    return iac.scan_infrastructure(sources if kind == "auto" else sources.withColumn("kind", F.lit(kind)))


def scan_all(sources: DataFrame) -> DataFrame:
    """Code and infrastructure, each text by its kind, in one pass."""
    return _hidden(iac.scan_infrastructure(sources.select("file", "language", "kind", "text"), (*CODE, "dockerfile", "terraform"))).select(*FINDING)


def scan_rules(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of a user's own table of rules, of any length, in the code among the sources."""
    code = sources.where(F.col("kind") == "code") if "kind" in sources.columns else sources
    return rulesets.scan_rules(code.select("file", "language", "text"), rules).select(*FINDING)


def import_reports(reports: DataFrame, *rows: tuple) -> DataFrame:
    """Findings of other tools' reports (tool, file, text: JSON) by the known mapping and further rows of one."""
    return imports.imported(reports, imports.mapping(reports.sparkSession, *rows))


def find_in_scripts(sources: DataFrame) -> DataFrame:
    """What the finders over tokens find in scripts: innerHTML, sql, eval, secret and import, with line and column."""
    return scripts.script_findings(sources.select("file", "language", "text"))


def fix_suggestion(spark: SparkSession, code: str, issue_type: str, language: str = "javascript") -> DataFrame:
    return suggestions(spark.createDataFrame([(code, issue_type, language)], "code string, type string, language string"))


def kept(found: DataFrame) -> DataFrame:
    """Findings that several reports read are worked out once: as a checkpoint where a folder for it is set, else in the executors' store."""
    return found.checkpoint() if found.sparkSession.conf.get("spark.checkpoint.dir", None) else found.persist()


def security_report(sources: DataFrame, format: str = "both", more: DataFrame | None = None, vulnerabilities: DataFrame | None = None) -> dict[str, DataFrame]:
    """markdown: the lines of dashboard and detailed list; sarif: a document per file.  The sources are scanned once.

    more: further findings, say those of ``import_reports``.  vulnerabilities: id and score; what is known of the ids in ``cve_ids`` of ``more`` goes into the detailed list.
    """
    if format not in ("markdown", "sarif", "both"):
        raise ValueError(f"no such format: {format}")
    found, out = scan_all(sources), {}
    if more is not None:
        found = found.unionByName(more.select(*FINDING, *(["cve_ids"] if "cve_ids" in more.columns else [])), allowMissingColumns=True)
    found = kept(found)
    if format != "sarif":
        head = sources.sparkSession.createDataFrame([(report.dashboard(found) + "\n\n---\n",)], "line string")
        out["markdown"] = head.union(report.detailed(enrich.resolved(found, vulnerabilities) if vulnerabilities is not None and "cve_ids" in found.columns else found))
    if format != "markdown":
        out["sarif"] = report.sarif_by_file(found)
    return out


def sandbox_scan(sources: DataFrame, language: str = "auto") -> DataFrame:
    """file, report: the code scanners' answer for each text, told in JSON; ``language``: of all texts, unless each is to be told from its text."""
    from .functions.text import language_by_sandbox

    told = sources.withColumn("language", language_by_sandbox(F.col("text")) if language == "auto" else F.lit(language))
    return report.sandbox_reports(told, scan_security(told), language)
