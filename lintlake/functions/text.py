"""Column functions: language detection, routing, severity, masking, trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import SPACE

SEVERITIES = ("critical", "high", "medium", "low")


def quoted(text: str | None) -> str:
    """A string literal of SQL.  Long expressions are put together as SQL, which is parsed once, and not call by call.

    A dollar sign is spelled by its number, so that ``${name}`` stays as it is and is not taken for a variable.
    """
    if text is None:
        return "CAST(NULL AS string)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def severity_rank(severity: Column) -> Column:
    """4 for critical down to 1 for low; null for anything else."""
    rank = F.when(severity == SEVERITIES[0], 4)
    for i, name in enumerate(SEVERITIES[1:], 1):
        rank = rank.when(severity == name, 4 - i)
    return rank


EDGES = f"^[{SPACE}]+|[{SPACE}]+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def trimmed_sql(text: str) -> str:
    return f"regexp_replace({text}, {quoted(EDGES)}, '')"


def masked(secret: Column) -> Column:
    """The first four and the last three characters, with stars between."""
    return F.concat(F.substring(secret, 1, 4), F.lit("****"), F.right(secret, F.lit(3)))


def _has(text: Column, *needles: str) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(text, F.lit(n))
    return found


def is_example(value: Column) -> Column:
    """Whether a value looks like one from a manual."""
    # Tokens of examples.
    return value.rlike(r"(?i)example|sample|dummy|test|xxx|your[_-]|placeholder|changeme")


def truncated(text: Column, most: int) -> Column:
    """At most so many characters, the last three of them dots where something is cut off."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


# The needles of the two language heuristics below.
def language_by_tool(text: Column) -> Column:
    """The heuristic of the scanning tools; a plain ``import`` counts as python."""
    return (
        F.when(_has(text, "import React", "useState"), "javascript")
        .when(_has(text, ": string", ": number"), "typescript")
        .when(_has(text, "def ", "import "), "python")
        .when(_has(text, "public class", "private void"), "java")
        .when(_has(text, "func ", "package main"), "go")
        .otherwise("javascript")
    )


def language_by_sandbox(text: Column) -> Column:
    """The heuristic of the isolated scan: scripts first, typed ones among them."""
    script = _has(text, "import ", "export ", "const ", "let ")
    return (
        F.when(script & _has(text, "interface ", ": string", ": number"), "typescript")
        .when(script, "javascript")
        .when(_has(text, "def "), "python")
        .when(_has(text, "public class ", "private ", "package "), "java")
        .when(_has(text, "func ", "package main"), "go")
        .otherwise("javascript")
    )


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_by_extension(path: Column) -> Column:
    ext = F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1)
    return F.when(ext.isin(".ts", ".tsx"), "typescript").when(ext == ".py", "python").when(ext == ".java", "java").when(ext == ".go", "go").otherwise("javascript")


def kind_of(path: Column) -> Column:
    """dockerfile, kubernetes, terraform or code, by file name."""
    name = F.lower(basename(path))
    return F.when((name == "dockerfile") | name.startswith("dockerfile."), "dockerfile").when(name.rlike(r"\.ya?ml$"), "kubernetes").when(name.rlike(r"\.tf(vars)?$"), "terraform").otherwise("code")


def matches_any(name: Column, patterns: list[str]) -> Column:
    """A leading star means an ending; anything else is equal to the name or a part of it."""
    found = F.lit(False)
    for p in patterns:
        found = found | (name.endswith(p[1:]) if p.startswith("*") else F.contains(name, F.lit(p)))
    return found
