"""Source trees and their changes as Spark data sources.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("ignored", "build/\n*.log").load(root)

The driver lists folders down to DEPTH and plans a partition for each folder there; files are listed and read by the
tasks. Filters on path and language are taken over, so that files they rule out are not opened. Spark's own
file source leaves out names that begin with "_" or ".", which source trees have.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from srcgraph.sources import tree

#: Levels of folders that the driver lists.
DEPTH = 2


@dataclass
class Folder(InputPartition):
    """A folder, with all that is below it or only with its own files."""

    path: str
    deep: bool


@dataclass
class Repository(InputPartition):
    path: str


class Tree:
    """What belongs to a tree: ignored paths, languages, and limits that filters set."""

    def __init__(self, options: dict) -> None:
        self.root = options.get("path") or ""
        if not self.root:
            raise ValueError("load() needs the root of a tree")
        listed = options.get("extensions")
        self.languages = tree.languages_for([e.strip() for e in listed.split(",")] if listed else None)
        self.indexed = options.get("indexed", "true").lower() == "true"
        self.patterns = [p for p in map(tree.ignore_pattern, options.get("ignored", "").split("\n")) if p]
        self.enters_all = any(again for again, _ in self.patterns)
        self.prefixes: list[str] = []
        self.only: list[set] = []

    def relative(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/")

    def entered(self, folder: str) -> bool:
        inside = all(folder.startswith(p) or p.startswith(folder.rstrip("/") + "/") or p == folder for p in self.prefixes)
        return inside and (self.enters_all or not tree.is_ignored(self.relative(folder) + "/", self.patterns))

    def kept(self, path: str) -> str | None:
        """The language of a file that belongs to what is asked for."""
        known = self.languages.get(os.path.splitext(path)[1].lower())
        language = known or "generic"
        wanted = (known is not None) == self.indexed and all(path.startswith(p) for p in self.prefixes) and all(language in o for o in self.only)
        return language if wanted and not tree.is_ignored(self.relative(path), self.patterns) else None

    def listed(self, folder: str, deep: bool) -> Iterator[tuple[str, str]]:
        for here, folders, names in os.walk(folder):
            folders[:] = sorted(d for d in folders if self.entered(os.path.join(here, d))) if deep else []
            for name in sorted(names):
                path = os.path.join(here, name)
                if language := self.kept(path):
                    yield path, language


class SourceTree(DataSource):
    """path, language, text and content_hash of source files. Options: ignored (lines of an ignore file), extensions
    (comma-separated, in place of the known ones), indexed (false: the files with other extensions)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, language string, text string, content_hash string"

    def reader(self, schema: object) -> DataSourceReader:  # noqa: ARG002
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.tree = Tree(dict(options))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("language",):
                self.tree.only.append({f.value})
            elif isinstance(f, In) and f.attribute == ("language",):
                self.tree.only.append(set(f.value))
            elif isinstance(f, (EqualTo, StringStartsWith)) and f.attribute == ("path",):
                self.tree.prefixes.append(f.value)
                if isinstance(f, EqualTo):
                    yield f
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        found, level = [], [self.tree.root]
        for depth in range(DEPTH + 1):
            following = []
            for folder in level:
                found.append(Folder(folder, depth == DEPTH))
                if depth < DEPTH:
                    following += sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and self.tree.entered(e.path))
            level = following
        return found

    def read(self, partition: Folder) -> Iterator[tuple]:
        for path, language in self.tree.listed(partition.path, partition.deep):
            yield (path, language, *tree.decoded(path))


class ChangedFiles(DataSource):
    """(repo, path, status) of the files that git says have changed since a revision. load() takes one or more
    repositories, comma-separated; option `since` the revision (HEAD)."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return "repo string, path string, status string"

    def reader(self, schema: object) -> DataSourceReader:  # noqa: ARG002
        return ChangedReader(self.options)


class ChangedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repos = [r.strip() for r in (options.get("path") or "").split(",") if r.strip()]
        self.since = options.get("since", "HEAD")

    def partitions(self) -> Sequence[InputPartition]:
        return [Repository(r) for r in self.repos]

    def read(self, partition: Repository) -> Iterator[tuple]:
        git = lambda *words: subprocess.run(["git", "-C", partition.path, *words], capture_output=True, text=True, check=True).stdout
        top = git("rev-parse", "--show-toplevel").strip()
        fields = git("diff", "--name-status", "--no-renames", "-z", self.since).split("\0")
        for status, path in zip(fields[::2], fields[1::2], strict=False):
            yield partition.path, f"{top}/{path}", status


def register(spark: SparkSession) -> None:
    """Make the sources known to a session and let filters through to them."""
    spark.dataSource.register(SourceTree)
    spark.dataSource.register(ChangedFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
