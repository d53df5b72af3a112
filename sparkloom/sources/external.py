"""External collectors as Python data sources, with a contract on what they return."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NODE_FIELDS = {"id", "type", "symbol_name", "content", "source", "metadata"}
EDGE_FIELDS = {"from_id", "to_id", "type", "weight", "evidence"}
SCHEMA = "kind string, id string, type string, symbol_name string, content string, from_id string, to_id string, weight double, evidence string, metadata string"
HOOKS: dict[str, list[Callable]] = {}


def check_contract(item: dict) -> dict:
    """A collected item is a node with id and type or an edge with its ends and type; unknown fields are refused."""
    kind = item.get("kind")
    known = NODE_FIELDS if kind == "node" else EDGE_FIELDS if kind == "edge" else None
    if known is None:
        raise ValueError(f"kind must be node or edge: {item!r}")
    need = {"id", "type"} if kind == "node" else {"from_id", "to_id", "type"}
    missing, extra = need - {k for k, v in item.items() if v}, set(item) - known - {"kind"}
    if missing or extra:
        raise ValueError(f"{kind}: missing {sorted(missing)}, unknown {sorted(extra)}")
    return item


class _Part(InputPartition):
    def __init__(self, command: str):
        self.command = command


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.commands = [c for c in options.get("commands", "").split("\n") if c.strip()]

    def partitions(self):
        return [_Part(c) for c in self.commands]

    def read(self, partition) -> Iterator[tuple]:
        out = subprocess.run(partition.command, shell=True, capture_output=True, text=True, check=True).stdout
        for line in out.splitlines():
            if line.strip():
                x = check_contract(json.loads(line))
                yield (x["kind"], x.get("id"), x["type"], x.get("symbol_name"), x.get("content"), x.get("from_id"), x.get("to_id"), float(x["weight"]) if "weight" in x else None, x.get("evidence"), json.dumps(x["metadata"]) if "metadata" in x else None)


class CollectorSource(DataSource):
    """Runs one command per line of the option ``commands``, each a task, and reads its JSON lines."""

    @classmethod
    def name(cls) -> str:
        return "collector"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CollectorSource)


def add_hook(collector: str, fn: Callable) -> None:
    """Called as fn(nodes, edges) after a collector's rows have landed."""
    HOOKS.setdefault(collector, []).append(fn)


def run_hooks(collector: str, nodes, edges) -> list:
    return [f(nodes, edges) for f in HOOKS.get(collector, [])]
