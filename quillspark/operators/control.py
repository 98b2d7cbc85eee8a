"""The control plane: which folders are indexed, by which patterns and with which embedding model.

These are a few paths in a small JSON document, kept on the driver.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import path_key
from quillspark.operators.filters import in_folder
from quillspark.operators.incremental import SAME_TIME


def clean(path: str) -> str:
    """A folder as it is compared: forward slashes, no doubled or last one, lower case."""
    parts = path.strip().strip('"').replace("\\", "/")
    while "//" in parts:
        parts = parts.replace("//", "/")
    return (parts.rstrip("/") or "/").lower()


def under(path: str, folder: str) -> bool:
    return path == folder or path.startswith(folder.rstrip("/") + "/")


@dataclass
class Sources:
    """Roots and excluded folders; no root lies inside another one."""

    roots: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    changed_at: float = 0.0

    def add(self, path: str, now: float) -> None:
        """A folder that was excluded below a root is taken in again; else it becomes a root."""
        path = clean(path)
        if path in self.excluded:
            self.excluded.remove(path)
        elif any(under(path, r) for r in self.roots):
            raise ValueError(f"{path} lies inside a root")
        elif any(under(r, path) for r in self.roots):
            raise ValueError(f"{path} contains a root")
        else:
            self.roots.append(path)
        self.changed_at = now

    def remove(self, path: str, now: float) -> None:
        """Takes a root away, and what was excluded below it."""
        path = clean(path)
        if path not in self.roots:
            raise ValueError(f"{path} is no root")
        self.roots.remove(path)
        self.excluded = [x for x in self.excluded if not under(x, path)]
        self.changed_at = now

    def exclude(self, path: str, now: float) -> None:
        """Excludes a folder below a root; exclusions inside it become needless."""
        path = clean(path)
        if path in self.roots or not any(under(path, r) for r in self.roots):
            raise ValueError(f"{path} is not below a root")
        if not any(under(path, x) for x in self.excluded):
            self.excluded = [*(x for x in self.excluded if not under(x, path)), path]
            self.changed_at = now

    def set_patterns(self, patterns: list[str], now: float) -> None:
        self.patterns = [p.strip() for p in patterns if p.strip()]
        self.changed_at = now

    def allows(self, path: str) -> bool:
        path = clean(path)
        return any(under(path, r) for r in self.roots) and not any(under(path, x) for x in self.excluded)

    def needs_rescan(self, last_scan: float | None) -> bool:
        return last_scan is None or self.changed_at > last_scan

    def dumps(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def loads(cls, text: str) -> Sources:
        return cls(**json.loads(text))


def root_counts(docs: DataFrame, roots: list[str], key: str = "path_key") -> DataFrame:
    """(root, docs): documents under each root, also those without any."""
    sums = [F.count_if(in_folder(key, r)).alias(f"n{i}") for i, r in enumerate(roots)]
    row = docs.agg(*sums)
    return row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("root"), F.col(f"n{i}").alias("docs")) for i, r in enumerate(roots)])).alias("x")).select("x.*")


def is_fresh(size: Column, mtime: Column, stored_size: Column, stored_mtime: Column) -> Column:
    """Whether the stored text of a file may be served: unchanged, or the file cannot be reached (null size)."""
    return size.isNull() | ((size == stored_size) & (F.abs(mtime - stored_mtime) < SAME_TIME))


def check_model(stored: str | None, wanted: str, reset: bool = False) -> None:
    """Refuses to mix vectors of two models."""
    if stored is not None and stored != wanted and not reset:
        raise ValueError(f"the vectors are of {stored}; reset them to use {wanted}")


def natural_key(name: Column) -> Column:
    """A sort key by which image2 comes before image10: runs of digits padded to ten places."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.lower(name), r"(\d+)", "0000000000$1"), r"0*(\d{10})(?!\d)", "$1"), F.lit("|"), name)


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """(link_id, path_key) of the first candidate that exists; links: (link_id, candidates), files: (path_key)."""
    each = links.select("link_id", F.posexplode("candidates").alias("rank", "candidate")).withColumn("path_key", path_key(F.col("candidate")))
    found = each.join(files.select("path_key").distinct(), "path_key", "left_semi")
    return found.groupBy("link_id").agg(F.min_by("path_key", "rank").alias("path_key"))
