"""Infrastructure checks that are not a single pattern: absent directives, best practice, Kubernetes paths.

Each is an array of findings of one text, so that all of them and the patterns share one pass over the sources.
"""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.regex import js_to_java
from ..functions.text import quoted, trimmed
from ..rules.advice import ADVICE
from ..rules.catalogue import A02, A05, A07, CIS, matched
from .kernel import CHECKED, CHECKS, METADATA, metadata, scan

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of the package

#: Checks that are no patterns, by scanner; their numbers follow those of the scanner's patterns.
PRACTICE = {"DF003": 602, "DF012": 611, "DF-MULTISTAGE": 650, "DF-ADDCOPY": 651, "TF-PROVIDER": 750, "TF-BACKEND": 751}
KUBERNETES_NO = 800


def _finding(scanner: str, rule_id: str, kind: str, severity: str, owasp: str | None, cwe: str | None = None, line: Column | None = None, match: Column | None = None, known: Column | None = None) -> Column:
    message, fix = ADVICE[rule_id]
    null = F.lit(None).cast("string")
    values = (F.lit(scanner), F.lit(rule_id), F.lit(PRACTICE[rule_id]), F.lit(kind), F.lit(severity), F.lit(message), F.lit(fix), null if line is None else line, null if match is None else match, F.lit(owasp), F.lit(cwe), F.when(F.lit(False), metadata()) if known is None else known)
    return F.struct(*(v.alias(c.split(":")[0]) for v, c in zip(values, CHECKED.split(", ")[:12], strict=True))).cast(f"struct<{CHECKED}>")


def _listed(*hits: Column) -> Column:
    return F.array_compact(F.array(*hits))


def dockerfile_checks(text: Column) -> Column:
    """Absent USER or HEALTHCHECK, a single stage that copies, and ADD where COPY would do."""
    has = lambda pattern, flags="m": text.rlike(js_to_java(pattern, flags))
    ids = lambda rule: metadata(rule_id=F.lit(rule), cis=F.lit(CIS.get(rule)))
    no_user = _finding("dockerfile", "DF003", "Dockerfile: DF003", "high", A05, "CWE-250", known=ids("DF003"))
    no_health = _finding("dockerfile", "DF012", "Dockerfile: DF012", "low", A05, known=ids("DF012"))
    stage = _finding("dockerfile", "DF-MULTISTAGE", "Dockerfile: Best Practice", "low", A05)
    adds = F.filter(F.transform(F.split(text, "\n"), lambda line, i: F.struct((i + 1).alias("line"), trimmed(line).alias("own"))), lambda x: x["own"].startswith("ADD ") & ~x["own"].rlike(r"\.tar|\.tgz|https?://"))
    add = F.transform(adds, lambda x: _finding("dockerfile", "DF-ADDCOPY", "Dockerfile: Best Practice", "low", None, line=x["line"], match=x["own"]))
    one_stage = (F.regexp_count(text, F.lit(js_to_java("^FROM", "m"))) == 1) & has("COPY|ADD", "i")
    return F.concat(_listed(F.when(~has(r"^USER\s+(?!root\b)"), no_user), F.when(~has("^HEALTHCHECK"), no_health), F.when(one_stage, stage)), add)


def terraform_checks(text: Column) -> Column:
    """No pinned providers, and an s3 backend without encryption."""
    backend = js_to_java(r'backend\s+"s3"\s*\{([^}]+)\}', "s")
    before, body = F.element_at(F.split(text, backend, 2), 1), F.regexp_extract(text, backend, 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    free = _finding("terraform", "TF-PROVIDER", "Terraform: Best Practice", "low", A05)
    plain = _finding("terraform", "TF-BACKEND", "Terraform: Backend Security", "high", A02, line=line)
    pinned = text.rlike(js_to_java(r"required_providers\s*\{([^}]+)\}", "s"))
    return _listed(F.when(~pinned, free), F.when((body != "") & ~F.contains(body, F.lit("encrypt")), plain))


def _parsed(text: str | None) -> list[str]:
    """Each mapping among the YAML documents of a text as JSON; booleans are true and false only, and a broken text gives what came before."""
    import re

    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    try:
        return [json.dumps(d, default=str) for d in list(yaml.load_all(text or "", Loader)) if isinstance(d, dict)]
    except yaml.YAMLError:
        return []


@F.pandas_udf(ArrayType(StringType()))
def yaml_documents(texts: pd.Series) -> pd.Series:
    """The documents of each text; of texts that are equal in a batch, copies of one manifest, one is read."""
    own = {t: _parsed(t) for t in texts.dropna().unique()}
    return texts.map(lambda t: own.get(t, []))


# Kinds that are checked.
WORKLOADS = ("Pod", "Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob", "ReplicaSet")
# Id, path ([*] goes over a list), severity, pod security standard, condition on the value x.v, its kind x.t and its JSON x.s.
K8S = (
    ("K8S001", "spec.containers[*].securityContext.privileged", "critical", "baseline", "x.t = 'BOOLEAN' AND x.s = 'true'"),
    ("K8S002", "spec.containers[*].securityContext.runAsNonRoot", "high", "restricted", "NOT (x.t = 'BOOLEAN' AND x.s = 'true')"),
    ("K8S003", "spec.hostNetwork", "high", "baseline", "x.t = 'BOOLEAN' AND x.s = 'true'"),
    ("K8S004", "spec.hostPID", "high", "baseline", "x.t = 'BOOLEAN' AND x.s = 'true'"),
    ("K8S005", "spec.hostIPC", "high", "baseline", "x.t = 'BOOLEAN' AND x.s = 'true'"),
    ("K8S006", "spec.containers[*].securityContext.capabilities.add", "critical", "baseline", "arrays_overlap(from_json(IF(x.t LIKE 'ARRAY%', x.s, '[]'), 'array<string>'), array('SYS_ADMIN', 'NET_ADMIN', 'SYS_PTRACE'))"),
    ("K8S007", "spec.containers[*].resources.limits", "medium", None, "{falsy(x.v)} OR {falsy(memory)} AND {falsy(cpu)}"),
    ("K8S008", "spec.containers[*].securityContext.allowPrivilegeEscalation", "high", "restricted", "x.t = 'BOOLEAN' AND x.s = 'true'"),
    ("K8S009", "spec.containers[*].securityContext.readOnlyRootFilesystem", "medium", "restricted", "NOT (x.t = 'BOOLEAN' AND x.s = 'true')"),
    ("K8S010", "spec.volumes[*].hostPath", "high", "baseline", "true"),
    ("K8S011", "spec.containers[*].image", "medium", None, "x.t = 'STRING' AND NOT contains(x.s, ':')"),
    ("K8S012", "spec.containers[*].image", "medium", None, "x.t = 'STRING' AND endswith(x.s, ':latest\"')"),
    ("K8S013", "metadata.namespace", "low", None, "x.t = 'STRING' AND x.s = '\"default\"'"),
)


def _get(root: str, path: str, kind: str = "variant") -> str:
    return f"try_variant_get({root}, '$.{path}', '{kind}')"


def _falsy(value: str) -> str:
    """Missing, null, false, zero or the empty string; by the value's own type."""
    kind, text = f"schema_of_variant({value})", f"to_json({value})"
    return f"({value} IS NULL OR {kind} = 'VOID' OR {kind} = 'BOOLEAN' AND {text} = 'false' OR {kind} = 'STRING' AND {text} = '\"\"' OR ({kind} = 'BIGINT' OR {kind} = 'DOUBLE' OR {kind} LIKE 'DECIMAL%') AND cast({text} AS double) = 0)"


def _made(rule: str, title: str, severity: str, owasp: str, cwe: str | None, match: str, **known: str) -> str:
    """A finding in SQL."""
    message, fix = ADVICE[rule]
    extra = ", ".join(f"CAST({known.get(m, 'NULL')} AS string)" for m in METADATA)
    values = (quoted("kubernetes"), quoted(rule), str(KUBERNETES_NO), quoted(title), quoted(severity), quoted(message), quoted(fix), "NULL", match, quoted(owasp), quoted(cwe), f"struct({extra})")
    return f"CAST(struct({', '.join(values)}) AS struct<{CHECKED}>)"


def _at(rule_id: str, path: str, severity: str, pss: str | None, condition: str) -> str:
    """Findings of one path in document d: its values with the places where they stand, then the condition."""
    head, _, rest = path.partition("[*].")
    if rest:
        values = "doc.containers" if head == "spec.containers" else _get("doc.d", head, "array<variant>")
        listed = f"transform(coalesce({values}, array()), (c, i) -> struct({_get('c', rest)} AS v, concat('{head}[', i, '].{rest}') AS at))"
    else:
        listed = f"array(struct({_get('doc.d', path)} AS v, '{path}' AS at))"
    typed = f"transform(filter({listed}, y -> y.v IS NOT NULL), y -> struct(y.v AS v, y.at AS at, schema_of_variant(y.v) AS t, to_json(y.v) AS s))"
    test = condition.replace("{falsy(x.v)}", _falsy("x.v")).replace("{falsy(memory)}", _falsy(_get("x.v", "memory"))).replace("{falsy(cpu)}", _falsy(_get("x.v", "cpu")))
    made = _made(rule_id, f"Kubernetes: {rule_id}", severity, A05, "CWE-250", "concat(x.at, ': ', x.s)", rule_id=quoted(rule_id), pss=quoted(pss), kind=_get("doc.d", "kind", "string"), name=_get("doc.d", "metadata.name", "string"), namespace=_get("doc.d", "metadata.namespace", "string"), path="x.at")
    return f"transform(filter({typed}, x -> {test}), x -> {made})"


def kubernetes_checks(text: Column) -> tuple[Column, str]:
    """The documents of a Kubernetes text, with their containers, and SQL over them (``__docs``) for their findings: 13 paths and three checks of their own.

    A path that is missing has no value, so that a rule on "not true" needs the key.  Values are told by
    type: the string "true" is not true, and the string "0" is something.
    """
    kind, name = _get("doc.d", "kind", "string"), _get("doc.d", "metadata.name", "string")
    token = _get("doc.d", "spec.automountServiceAccountToken")
    account = f"IF(coalesce(schema_of_variant({token}) = 'BOOLEAN' AND to_json({token}) = 'true', false), array({_made('K8S-SA', 'Kubernetes: ServiceAccount', 'medium', A07, None, 'NULL', kind=kind, name=name)}), array())"
    containers = "coalesce(doc.containers, array())"
    env = f"flatten(transform({containers}, c -> transform(coalesce({_get('c', 'env', 'array<variant>')}, array()), e -> struct(c AS c, e AS e))))"
    exposed = f"NOT {_falsy(_get('x.e', 'value'))} AND coalesce({_get('x.e', 'name', 'string')} rlike '(?i)password|secret|token|api[_-]?key', false) AND {_falsy(_get('x.e', 'valueFrom.secretKeyRef'))}"
    secrets = f"transform(filter({env}, x -> {exposed}), x -> {_made('K8S-SECRET', 'Kubernetes: Hardcoded Secret', 'critical', A02, 'CWE-798', 'NULL', container=_get('x.c', 'name', 'string'), env_var=_get('x.e', 'name', 'string'))})"
    network = f"IF({kind} IN ('Deployment', 'StatefulSet', 'Pod'), array({_made('K8S-NP', 'Kubernetes: Best Practice', 'low', A05, None, 'NULL', kind=kind, name=name)}), array())"
    kinds = ", ".join(map(quoted, WORKLOADS))
    parts = ", ".join([*(_at(*r) for r in K8S), account, secrets, network])
    parsed = F.transform(yaml_documents(text), lambda j: F.call_function("try_parse_json", j))
    each = F.transform(parsed, lambda d: F.struct(d.alias("d"), F.try_variant_get(d, "$.spec.containers", "array<variant>").alias("containers")))
    return each, f"flatten(transform(filter(__docs, doc -> coalesce({kind} IN ({kinds}), false)), doc -> concat({parts})))"


def checked(sources: DataFrame, kinds: tuple[str, ...] = ("dockerfile", "terraform", "kubernetes")) -> tuple[DataFrame, Column]:
    """The sources and an array of the findings of each one's checks, by ``language``; the YAML of other texts is not read."""
    kind, text = F.col("language"), F.col("text")
    parsed, found = kubernetes_checks(F.when(kind == "kubernetes", text))
    if "kubernetes" in kinds:
        sources = sources.withColumn("__docs", parsed)
    by = {"dockerfile": lambda: dockerfile_checks(text), "terraform": lambda: terraform_checks(text), "kubernetes": lambda: F.expr(found)}
    checks = F.lit(None).cast(CHECKS)
    for k in kinds:
        checks = F.when(kind == k, by[k]()).otherwise(checks)
    return sources, F.coalesce(checks, F.array().cast(CHECKS))


def practice(sources: DataFrame, kind: str) -> DataFrame:
    """The checks of one kind of texts (file, text), without the patterns."""
    sources, checks = checked(sources.withColumn("language", F.lit(kind)), (kind,))
    return scan(sources, [], checks, without=("__docs",))


def scan_infrastructure(sources: DataFrame, listed: tuple[str, ...] = ("dockerfile", "terraform")) -> DataFrame:
    """Findings of Dockerfiles, Kubernetes and Terraform texts in one pass; ``kind`` says which one a text is."""
    ready = sources.withColumn("language", F.when(F.col("kind") == "code", F.col("language")).otherwise(F.col("kind"))).drop("kind")
    if not set(listed) - {"dockerfile", "terraform"}:
        ready = ready.where(F.col("language").isin("dockerfile", "terraform", "kubernetes"))
    ready, checks = checked(ready)
    return scan(ready, matched(*listed), checks, without=("__docs",))
