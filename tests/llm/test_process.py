"""What a worker keeps although functions are sent to it by value."""

import os

import pyarrow as pa

import __spark_entry__  # noqa: F401  registers the package by value
from roadframes.llm.process import kept
from roadframes.llm.textscan import _Powers
from roadframes.llm.tokenids import encoder


def test_tasks_of_a_worker_share_tables(spark):
    def run(batches):
        own = encoder("word")
        seen = kept().setdefault("test_tasks", [])
        seen.append((id(own), id(_Powers.get(8)[0])))
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "tasks": [len(seen)], "tables": [len(set(seen))]})

    rows = spark.range(0, 64, 1, 32).mapInArrow(run, "pid long, tasks long, tables long").collect()
    assert max(r["tasks"] for r in rows) > 1
    assert all(r["tables"] == 1 for r in rows)
