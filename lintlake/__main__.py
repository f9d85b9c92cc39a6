"""python -m lintlake scan TARGET: findings of a folder or file as text, JSON, SARIF or markdown.

``sandbox`` scans the file named by SCAN_CODE_FILE in the language SCAN_LANGUAGE and prints JSON.
"""

from __future__ import annotations

import argparse
import os
import sys

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions.text import SEVERITIES
from .operators import analytics, report
from .sources.files import EXCLUDE, INCLUDE, listing, single, target, unread


def put(lines: DataFrame, output: str | None) -> None:
    """A column of lines: to a folder, written by the executors (its parts in order are the document), or to the terminal, part by part."""
    if output:
        lines.write.mode("overwrite").text(output)
    else:
        for row in lines.toLocalIterator():
            print(row[0])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lintlake")
    commands = parser.add_subparsers(dest="command", required=True)
    own = commands.add_parser("scan")
    own.add_argument("target", help="folder or file; a file is taken whatever its name")
    own.add_argument("--format", choices=("text", "json", "sarif", "markdown"), default="text")
    own.add_argument("--output", help="folder for the report")
    own.add_argument("--severity", choices=SEVERITIES, default="low")
    own.add_argument("--fail-on", choices=SEVERITIES, default="critical", help="exit with 1 if there is a finding of this severity or a worse one")
    own.add_argument("--language", choices=("auto", "javascript", "typescript", "python", "java", "go"), default="auto", help="of all code files, unless their names tell")
    own.add_argument("--rules", help="JSON lines or a Parquet table of further rules: rule_id, pattern, and what else rules may say")
    own.add_argument("--unread", action="store_true", help="tell how many files could not be read; reads them once more")
    own.add_argument("--include", default=",".join(INCLUDE))
    own.add_argument("--exclude", default=",".join(EXCLUDE))
    own.add_argument("--group-by", choices=("severity", "category", "file"), default="severity", help="of markdown")
    own.add_argument("--no-color", action="store_true")
    commands.add_parser("sandbox")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lintlake").getOrCreate()
    if args.command == "sandbox":
        sources = single(spark, os.environ.get("SCAN_CODE_FILE", "/tmp/code.txt"))
        put(api.sandbox_scan(sources, os.environ.get("SCAN_LANGUAGE", "auto")).select("report"), None)
        return 0
    names = tuple(tuple(map(str.strip, x.split(","))) for x in (args.include, args.exclude))
    try:
        sources, listed = target(spark, args.target, *names), listing(spark, args.target, *names)
    except Py4JJavaError as error:
        print(f"{args.target}: {error.java_exception.getMessage()}", file=sys.stderr)
        return 1
    if args.language != "auto":
        sources = sources.withColumn("language", F.when(F.col("kind") == "code", args.language).otherwise(F.col("language")))
    found = api.scan_all(sources)
    if args.rules:
        rules = spark.read.parquet(args.rules) if args.rules.rstrip("/").endswith(".parquet") else spark.read.json(args.rules)
        found = found.unionByName(api.scan_rules(sources, rules))
    found = api.kept(analytics.at_least(found, args.severity))
    lines = {
        "text": lambda: report.text_report(listed, found, not args.no_color and not args.output),
        "json": lambda: report.json_report(listed, found),
        "sarif": lambda: report.merged(report.sarif_by_file(found)),
        "markdown": lambda: report.markdown(found, args.group_by),
    }[args.format]()
    put(lines, args.output)
    if args.unread:
        print(f"{unread(listed, sources).count()} files could not be read", file=sys.stderr)
    return int(analytics.fails(found, args.fail_on))


if __name__ == "__main__":
    sys.exit(main())
