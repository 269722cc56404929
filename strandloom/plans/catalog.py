"""Catalog of layouts and reference lists by key: defaults, overrides and removals kept in one small file."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

KINDS = ("layout", "whitelist")


class Catalog:
    """Entries (kind, key, path). The file holds what differs from ``defaults``; a null path hides a default."""

    def __init__(self, file: str, defaults: dict[str, dict[str, str]] | None = None):
        self.file = os.path.expanduser(file)
        self.defaults = {k: dict((defaults or {}).get(k, {})) for k in KINDS}
        self.changes: dict[str, dict[str, str | None]] = {k: {} for k in KINDS}
        if os.path.exists(self.file):
            with open(self.file, encoding="utf-8") as f:
                self.changes |= json.load(f)

    def _save(self) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.file)), exist_ok=True)
        with open(self.file + ".part", "w", encoding="utf-8") as f:
            json.dump(self.changes, f, indent=1, sort_keys=True)
        os.replace(self.file + ".part", self.file)

    def add(self, kind: str, key: str, path: str) -> None:
        self.changes[kind][key] = path
        self._save()

    def remove(self, kind: str, key: str) -> None:
        if key not in self.entries(kind):
            raise KeyError(f"no {kind} named {key!r}")
        if key in self.defaults[kind]:
            self.changes[kind][key] = None
        else:
            del self.changes[kind][key]
        self._save()

    def reset(self, kind: str, key: str) -> None:
        self.changes[kind].pop(key, None)
        self._save()

    def entries(self, kind: str) -> dict[str, str]:
        return {k: p for k, p in (self.defaults[kind] | self.changes[kind]).items() if p is not None}

    def resolve(self, kind: str, key_or_path: str) -> str:
        """Path of a key, or the path itself."""
        found = self.entries(kind).get(key_or_path)
        if found or os.path.exists(key_or_path):
            return found or key_or_path
        raise KeyError(f"{key_or_path!r} is neither a {kind} nor a file; known: {sorted(self.entries(kind))}")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, key, path, key in self.changes[k]) for k in KINDS for key, path in sorted(self.entries(k).items())]
        return spark.createDataFrame(rows, "kind string, key string, path string, changed boolean")
