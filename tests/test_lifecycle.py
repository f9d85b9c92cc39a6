"""A replay of versions of files, late and repeated ones among them, against a loop over all of them."""

import datetime
import random

import pytest

from lintlake.rules.catalogue import matched
from lintlake.streaming import lifecycle as L

EVAL = [r for r in matched("xss") if r.rule_id == "XSS-13"]
START = datetime.datetime(2024, 1, 1)
SCHEMA = "file string, version long, ts timestamp, language string, text string"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


@pytest.fixture
def replay(spark, tmp_path):
    """Runs batches through the life-cycle, each as one file of a stream, and gives its events."""

    def run(batches, **kw):
        kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.STORE)
        try:
            for i, rows in enumerate(batches):
                spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i:03d}")
                stream = spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in/*")
                events = L.lifecycle(L.versions_with_findings(stream, EVAL), **kw)
                query = events.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
                query.awaitTermination(120)
                assert query.exception() is None and not query.isActive
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
        return spark.read.parquet(f"{tmp_path}/out")

    return run


def looped(batches):
    """Opened, closed and late events by a loop: lines of eval stand for findings."""
    last, open_, out = {}, {}, []
    for rows in batches:
        for file, version, _, _, text in sorted(rows, key=lambda r: (r[0], r[1])):
            if file in last and version <= last[file]:
                out += [(file, version, "late", None)] * (version < last[file])
                continue
            now = {i + 1 for i in range((text or "").count("eval("))}
            was = open_.get(file, {})
            out += [(file, version, "closed", was[n]) for n in was.keys() - now]
            out += [(file, version, "opened", version) for n in now - was.keys()]
            open_[file], last[file] = {n: was.get(n, version) for n in now}, version
    return out


def test_replay_equals_a_loop(replay):
    rng = random.Random(5)
    batches, seen = [], []
    for b in range(4):
        rows = []
        for _ in range(12):
            text = "\n".join(["let a;"] * rng.randrange(3) + ["eval(x);"] * rng.randrange(4)) if rng.random() < 0.9 else None
            rows.append((f"f{rng.randrange(4)}", b * 3 + rng.randrange(5), at(b), "javascript", text))
        rows = list({(r[0], r[1]): r for r in rows}.values()) + [r for r in seen if rng.random() < 0.2]  # versions that come again
        seen += rows
        batches.append(rows)
    got = replay(batches, late="1 hour").select("file", "version", "event", "opened").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(looped(batches), key=repr)


def test_a_silent_file_expires_and_comes_anew(replay):
    one = lambda minute, file, version, text: (file, version, at(minute), "javascript", text)
    batches = [
        [one(0, "a", 1, "eval(x);"), one(0, "b", 1, "let b;"), (None, 1, at(0), "javascript", "eval(x);")],
        [one(30, "b", 2, "eval(y);")],
        [one(300, "c", 1, "let c;")],
        [one(301, "a", 1, "eval(x);"), one(301, "c", 2, "eval(z);\neval(z);")],
        [one(302, "c", 3, "let moved;\n\neval(z);\neval(z);"), one(10, "b", 3, "let dropped;")],
    ]
    got = replay(batches, late="5 minutes", idle_seconds=3600).select("file", "event", "version", "nth", "line").collect()
    a, b = [("a", e, 1, 1, 1) for e in ("opened", "expired")], [("b", e, 2, 1, 1) for e in ("opened", "expired")]
    assert sorted(map(tuple, got)) == sorted([*a, *b, ("a", "opened", 1, 1, 1), ("c", "opened", 2, 1, 1), ("c", "opened", 2, 2, 2)])
