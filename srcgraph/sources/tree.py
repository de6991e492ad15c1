"""Source trees and text feeds as DataFrames.

Trees are read by the data source in datasource.py; what belongs to one is decided here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Languages by extension (fixed values).
LANGUAGES = {
    ".py": "python", ".cs": "csharp", ".vb": "vbnet",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".aspx": "markup", ".ascx": "markup", ".ashx": "markup", ".asmx": "markup", ".master": "markup", ".cshtml": "markup", ".vbhtml": "markup", ".razor": "markup",
    ".asp": "markup", ".inc": "markup", ".config": "generic",
}


def ignore_pattern(line: str) -> tuple[bool, re.Pattern] | None:
    """(whether it lets in again, pattern) of one line of an ignore file; None for blanks and comments. A slash
    inside anchors it to the root, one at the end asks for a directory, ** stands for any folders."""
    line = line.rstrip("\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    again, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
    only_folder, line = line.endswith("/"), line.rstrip("/")
    if not line:
        raise ValueError(f"ignore pattern {line!r} names nothing")
    anchored, line = "/" in line, line.removeprefix("/")
    made, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            made, i = made + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            made, i = made + "/.*", i + 3
        elif line[i] == "*":
            made, i = made + "[^/]*", i + 1
        elif line[i] == "?":
            made, i = made + "[^/]", i + 1
        elif line[i] == "[":
            end = line.find("]", i + 2)
            if end < 0:
                raise ValueError(f"ignore pattern {line!r} has an open bracket")
            made, i = made + "[" + line[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            made, i = made + re.escape(line[i]), i + 1
    return again, re.compile(("" if anchored else "(?:.*/)?") + made + ("/.*" if only_folder else "(?:/.*)?") + r"\Z", re.S)


def is_ignored(path: str, patterns: Sequence[tuple[bool, re.Pattern]]) -> bool:
    """Whether the last pattern that fits a relative path, a directory's with a slash at its end, leaves it out."""
    for again, pattern in reversed(patterns):
        if pattern.match(path):
            return not again
    return False


def decoded(path: str) -> tuple[str, str]:
    """A file's text, by the first encoding that fits its bytes, and their digest."""
    with open(path, "rb") as f:
        data = f.read()
    digest = hashlib.sha256(data).hexdigest()
    for encoding in ("utf-8-sig", "utf-8"):
        try:
            return data.decode(encoding), digest
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1"), digest


def languages_for(extensions: Sequence[str] | None = None) -> dict[str, str]:
    """Languages by extension. A list of extensions replaces the known ones; unknown ones are generic."""
    return LANGUAGES if extensions is None else {e.lower(): LANGUAGES.get(e.lower(), "generic") for e in extensions}


def source_files(spark: SparkSession, root: str, ignored: Sequence[str] = (), indexed: bool = True, extensions: Sequence[str] | None = None) -> DataFrame:
    """(path, language, text, content_hash) of the files with a listed extension, or of the others: the data source
    source_tree with its options."""
    from srcgraph.sources import datasource

    datasource.register(spark)
    reader = spark.read.format("source_tree").option("ignored", "\n".join(ignored)).option("indexed", str(indexed).lower())
    return (reader.option("extensions", ",".join(extensions)) if extensions is not None else reader).load(root)


def json_lines(lines: DataFrame, schema: str, required: Sequence[str], column: str = "value") -> DataFrame:
    """Rows of a JSON-lines feed; blank lines, # comments, malformed rows and rows without the
    required fields are left out."""
    kept = lines.where((F.trim(column) != "") & ~F.trim(column).startswith("#")).select(F.from_json(column, schema).alias("j"))
    present = F.lit(True)
    for name in required:
        present = present & F.coalesce(F.col(f"j.{name}").cast("string") != "", F.lit(False))
    return kept.where(present).select("j.*")


def stack_frames(traces: DataFrame, column: str = "raw") -> DataFrame:
    """Frames of stack traces given as (trace_id, line_no, raw): three grammars, tried in order."""
    raw = F.col(column)
    python = r'^\s*File "([^"]+)", line (\d+), in (\S+)'
    script = r"^\s*at (?:(\S+) \()?([^()\s]+):(\d+):\d+\)?\s*$"
    dotnet = r"^\s*at ([^\s(]+)\([^)]*\)(?: in (.+):line (\d+))?\s*$"
    part = lambda p, g: F.nullif(F.regexp_extract(raw, p, g), F.lit(""))
    is_python, is_script = raw.rlike(python), raw.rlike(script)
    made = traces.where(is_python | is_script | raw.rlike(dotnet)).select(
        "trace_id", "line_no",
        F.when(is_python, part(python, 3)).when(is_script, part(script, 1)).otherwise(_plain_method(part(dotnet, 1))).alias("method"),
        F.when(is_python, part(python, 1)).when(is_script, part(script, 2)).otherwise(part(dotnet, 2)).alias("path"),
        F.when(is_python, part(python, 2)).when(is_script, part(script, 3)).otherwise(part(dotnet, 3)).cast("int").alias("line"),
    )
    return made


def _plain_method(name: Column) -> Column:
    """Generic arity off, + as a dot, and the inner name of async and lambda wrappers."""
    plain = F.replace(F.regexp_replace(name, r"`\d+(\[[^\]]*\])?", ""), F.lit("+"), F.lit("."))
    inner = F.regexp_extract(plain, r"<([A-Za-z_]\w*)>[A-Za-z_]*\w*(?:__\w+|d__\d+)?(?:\.MoveNext)?$", 1)
    head = F.regexp_extract(plain, r"^(.*?)\.?(?:<>c(?:__DisplayClass\w*)?\.)?<", 1)
    return F.when(inner != "", F.concat_ws(".", F.nullif(head, F.lit("")), inner)).otherwise(plain)


def commits(log: DataFrame) -> DataFrame:
    """(hash, author, ts, path) of a log given as (part, line_no, line), headers "hash|author|epoch"
    followed by paths. Logs come in parts (one for each repository or file), so no part is the whole."""
    header = F.regexp_extract("line", r"^([0-9a-f]{7,40})\|([^|]*)\|(\d+)$", 0)
    w = Window.partitionBy("part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = log.withColumn("h", F.last(F.nullif(header, F.lit("")), ignorenulls=True).over(w)).where((header == "") & (F.trim("line") != "") & F.col("h").isNotNull())
    piece = lambda i: F.split("h", r"\|")[i]
    return marked.select(piece(0).alias("hash"), piece(1).alias("author"), piece(2).cast("long").alias("ts"), F.trim("line").alias("path"))
