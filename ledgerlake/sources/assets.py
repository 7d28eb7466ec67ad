"""Asset definitions, their builder, scoped input and output, and materialisation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_files, write_files

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.:-]{0,127}")
MASKS = ("hash", "redact", "partial")


class UndeclaredUpstream(ValueError):
    """An asset read what it did not declare."""


@dataclass(frozen=True)
class Asset:
    name: str
    upstreams: tuple[str, ...] = ()
    materialize: Callable[[AssetIO], DataFrame] | None = None
    columns: dict[str, str] = field(default_factory=dict)
    lineage: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    policies: dict[str, str] = field(default_factory=dict)
    rules: tuple = ()
    tags: tuple[str, ...] = ()
    owner: str = ""
    partition_column: str | None = None
    max_lag_seconds: int | None = None
    every_seconds: int | None = None
    reviewers: tuple[str, ...] = ()
    pii_overrides: dict[str, bool] = field(default_factory=dict)


class AssetBuilder:
    """Collects a definition and refuses what cannot be one."""

    def __init__(self, name: str) -> None:
        self._made = {"name": name}
        self._rules: list = []
        self._policies: dict[str, str] = {}

    def upstream(self, *names: str) -> AssetBuilder:
        self._made["upstreams"] = (*self._made.get("upstreams", ()), *names)
        return self

    def column(self, name: str, refs: Iterable[tuple[str, str]] = ()) -> AssetBuilder:
        refs = list(refs)
        if any(not a or not c for a, c in refs):
            raise ValueError(f"column {name}: a reference needs asset and column")
        self._made.setdefault("columns", {})[name] = name
        if refs:
            self._made.setdefault("lineage", {})[name] = refs
        return self

    def policy(self, column: str, mask: str) -> AssetBuilder:
        if mask not in MASKS:
            raise ValueError(f"unknown mask {mask!r}")
        if column in self._policies:
            raise ValueError(f"column {column} has a policy already")
        self._policies[column] = mask
        return self

    def rule(self, rule) -> AssetBuilder:
        if any(r.name == rule.name for r in self._rules):
            raise ValueError(f"rule {rule.name} is there already")
        self._rules.append(rule)
        return self

    def sla(self, seconds: int) -> AssetBuilder:
        if seconds <= 0:
            raise ValueError("a lag has to be positive")
        self._made["max_lag_seconds"] = seconds
        return self

    def every(self, seconds: int) -> AssetBuilder:
        """A fixed cadence."""
        if seconds <= 0:
            raise ValueError("a cadence has to be positive")
        self._made["every_seconds"] = seconds
        return self

    def reviewed_by(self, *roles: str) -> AssetBuilder:
        if not all(roles) or len(set(roles)) < len(roles):
            raise ValueError("reviewers have to be named, each once")
        self._made["reviewers"] = roles
        return self

    def pii_override(self, column: str, pii: bool) -> AssetBuilder:
        overrides = self._made.setdefault("pii_overrides", {})
        if not column or column in overrides:
            raise ValueError(f"column {column!r} has no name or an override already")
        overrides[column] = pii
        return self

    def owned_by(self, owner: str, *tags: str) -> AssetBuilder:
        self._made.update(owner=owner, tags=tags)
        return self

    def partitioned(self, column: str) -> AssetBuilder:
        self._made["partition_column"] = column
        return self

    def build(self, materialize: Callable[[AssetIO], DataFrame] | None = None) -> Asset:
        if not NAME.fullmatch(self._made["name"]):
            raise ValueError(f"not an asset name: {self._made['name']!r}")
        if self._made["name"] in self._made.get("upstreams", ()):
            raise ValueError("an asset cannot be its own upstream")
        return Asset(**self._made, materialize=materialize, rules=tuple(self._rules), policies=self._policies)


class AssetIO:
    """Reads only what the asset declares, writes only the asset, and remembers what was read."""

    def __init__(self, spark: SparkSession, asset: Asset, root: str, fmt: str = "parquet", hooks: dict[str, Callable[[DataFrame], DataFrame]] | None = None, partition_key: str | None = None) -> None:
        self.spark, self.asset, self.root, self.fmt, self.partition_key = spark, asset, root, fmt, partition_key
        self.hooks = [f for _, f in sorted((hooks or {}).items())]
        self._read: set[str] = set()

    def read(self, name: str) -> DataFrame:
        if name not in self.asset.upstreams:
            raise UndeclaredUpstream(f"{self.asset.name} does not declare {name}")
        self._read.add(name)
        return read_files(self.spark, f"{self.root}/{name}", self.fmt)

    def observed(self) -> list[str]:
        return sorted(self._read)

    def write(self, df: DataFrame) -> None:
        for hook in self.hooks:
            df = hook(df)
        by = self.asset.partition_column
        if by and self.partition_key is not None:
            df = df.filter(F.col(by) == self.partition_key)
        write_files(df, f"{self.root}/{self.asset.name}", self.fmt, partition_by=[by] if by else None)


def materialize(spark: SparkSession, asset: Asset, root: str, partition_key: str | None = None, hooks: dict | None = None) -> AssetIO:
    """Runs the asset's function and writes its result, for one partition key alone if given; hooks run in name order."""
    io = AssetIO(spark, asset, root, hooks=hooks, partition_key=partition_key)
    io.write(asset.materialize(io))
    return io
