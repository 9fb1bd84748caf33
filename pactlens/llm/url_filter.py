"""URL filters: allow and block rules over hosts and paths, by a sort-merge range join.

A url's key is its host with the labels reversed, each followed by a dot: `a.example.net` becomes `net.example.a.`.
A rule for host h covers every key that begins with h's key, which is one interval of the sorted keys, and intervals
either nest or are apart. One sweep over sorted urls therefore keeps the rules around the current url as a stack.

Spark range-partitions and sorts the urls by (key, path, id), so a host with a third of all urls spreads over many
partitions. Each partition sweeps its own range with one pointer into the sorted rules; rules that began before its first
key are found as the pointer runs up to it. The rules are an argument, a list of the driver's, and go out with the tasks.

Defined results: a null url, or one without `://`, has an empty host and path. A rule fits when its host equals the
url's host or is a parent domain, and the url's path starts with the rule's path. Among fitting rules the one with most
characters (host and path together) wins, then the one with the longer host, then a block before an allow. With no
fitting rule the verdict is the `default`. A rule without a host covers every host. Repeated rows stay repeated; an empty table gives an empty result; a very long url is
one key; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = "page_id long, host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, pattern: str) -> Rule:
        """`example.net/en/` is host `example.net` and path `/en/`; without a slash the path is empty."""
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        host, slash, rest = pattern.partition("/")
        return cls(verdict, host.translate(_LOWER), slash + rest)

    @property
    def pattern(self) -> str:
        return self.host + self.path

    @property
    def key(self) -> str:
        return reversed_host(self.host)

    @property
    def weight(self) -> tuple:
        return (len(self.pattern), len(self.host), self.verdict == "block", self.pattern)


_LOWER = {code: code + 32 for code in range(65, 91)}
_UPPER_AZ, _LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def reversed_host(host: str) -> str:
    return "".join(label + "." for label in reversed(host.split("."))) if host else ""


def url_host(url: Column) -> Column:
    """From the first `://` to the next slash, question mark or hash, with A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER_AZ, _LOWER_AZ)


def url_path(url: Column) -> Column:
    """After the host, up to a question mark or hash."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))


class Sweep:
    """The rules around the current key, outermost first, while keys come in ascending order."""

    def __init__(self, rules: Iterable[Rule]):
        nodes: dict[str, list[Rule]] = {}
        for rule in rules:
            nodes.setdefault(rule.key, []).append(rule)
        self._nodes = sorted((key.encode(), held) for key, held in nodes.items())
        self._next = 0
        self._stack: list[tuple[bytes, list[Rule]]] = []

    def at(self, key: bytes) -> list[Rule]:
        """Rules whose interval holds `key`."""
        while self._next < len(self._nodes) and self._nodes[self._next][0] <= key:
            node = self._nodes[self._next]
            self._next += 1
            self._leave(node[0])
            self._stack.append(node)
        self._leave(key)
        return [rule for _, held in self._stack for rule in held]

    def _leave(self, key: bytes) -> None:
        while self._stack and not key.startswith(self._stack[-1][0]):
            self._stack.pop()


def decide(urls: DataFrame, rules: Iterable[Rule], default: str = "allow", url: str = "url", row_id: str = "page_id") -> DataFrame:
    """Each url's host, path, winning rule and verdict. `rules` is a list held by the tasks: a few million at most."""
    held = sorted(set(rules), key=lambda rule: rule.weight, reverse=True)
    keyed = urls.select(
        F.col(row_id).cast("long").alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    ).withColumn("key", host_key(F.col("host")))
    ordered = keyed.repartitionByRange("key", "path", "page_id").sortWithinPartitions("key")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Sweep(held)
        last, around = None, []
        for batch in batches:
            won: list[str | None] = []
            verdicts: list[str] = []
            for key, path in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist()):
                if key != last:
                    last, around = key, sorted(stack.at(key.encode()), key=lambda rule: rule.weight, reverse=True)
                best = next((rule for rule in around if path.startswith(rule.path)), None)
                won.append(best.pattern if best else None)
                verdicts.append(best.verdict if best else default)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(won, pa.string()), pa.array(verdicts, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return ordered.mapInArrow(sweep, COLUMNS)
