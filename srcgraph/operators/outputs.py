"""Shortened command outputs: which lines of a run's output are worth keeping. Lines come as rows
(run, line_no, line); a run's output is a bounded text, its lines are ordered within the run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A title between rules of equal signs; a total that ends in seconds; line forms of test runners.
_SECTION, _TIMED = r"^={2,}\s*(\S(?:.*\S)?)\s*={2,}$", r"(passed|failed|skipped|deselected|xfailed|xpassed|warnings?|errors?|no tests ran)\b.*\s\d+(\.\d+)?s\b"
_KEPT_SECTIONS = r"failures|errors|short test summary"
_PASSES, _PASSES_CARGO = r"^\s*(PASS\b|[✓√])", r"^test .+ \.\.\. ok\s*$"
_LAUNCHER, _SUFFIX = r"python(\d+(\.\d+)?)?", r"\.(exe|cmd|bat|ps1)$"
#: Tools by program, and by program and first argument (fixed values).
PROGRAMS = {"pytest": "pytest", "py.test": "pytest", "jest": "npm_test", "eslint": "eslint", "mypy": "mypy"}
COMMANDS = {("git", "diff"): "git_diff", ("git", "log"): "git_log", ("git", "status"): "git_status", ("cargo", "test"): "cargo_test", ("cargo", "build"): "cargo_build"}


def tool_of(argv: Column) -> Column:
    """The kind of tool that a command line (an array of words) runs; `python -m X` runs X."""
    program = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"([^/\\]*)$", 1)), _SUFFIX, "")
    at = F.array_position(argv, "-m")
    by_module = program(F.get(argv, F.lit(0))).rlike(f"^{_LAUNCHER}$") & (at > 1) & (at < F.size(argv))
    words = F.when(by_module, F.slice(argv, (at + 1).cast("int"), F.greatest(F.size(argv), F.lit(1)))).otherwise(argv)
    base, first = program(F.get(words, F.lit(0))), F.lower(F.get(words, F.lit(1)))
    found = F.when(base.isin("npm", "yarn", "pnpm") & F.exists(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.lower(w) == "test"), "npm_test")
    for name, tool in PROGRAMS.items():
        found = found.when(base == name, tool)
    for (name, word), tool in COMMANDS.items():
        found = found.when((base == name) & (first == word), tool)
    return F.when(F.size(argv) > 0, found.otherwise("generic")).otherwise("generic")


def pytest_lines(lines: DataFrame, run: str = "run") -> DataFrame:
    """Sections on failures and errors, the summary, what was collected and the final line; of a run where all
    passed the final line only; of one with none of these all lines."""
    title = F.lower(F.regexp_extract(F.trim("line"), _SECTION, 1))
    timed, wanted = title.rlike(_TIMED), title.rlike(_KEPT_SECTIONS)
    mark = F.when(wanted, "keep").when(timed | title.contains("test session starts"), "drop")
    order = Window.partitionBy(run).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(run)
    marked = lines.withColumns({"__final": timed & ~wanted, "__title": title}).withColumn("__in", F.last(mark, ignorenulls=True).over(order))
    collected = F.startswith(F.trim("line"), F.lit("collected "))
    # What a run keeps is known only when all its lines are.
    marked = marked.withColumn("__kept", (F.col("__in") == "keep") | F.col("__final") | (collected & (F.col("__title") == "")))
    final_at = F.max(F.when(F.col("__final"), F.struct("line_no", F.lower("line").alias("l")))).over(whole)
    marked = marked.withColumns({"__last": final_at, "__any": F.max(F.coalesce("__kept", F.lit(False))).over(whole)})
    green = F.col("__last").isNotNull() & ~F.col("__last.l").rlike("failed|error")
    keep = F.when(green, F.col("line_no") == F.col("__last.line_no")).when(F.col("__any"), F.coalesce("__kept", F.lit(False))).otherwise(True)
    return marked.where(keep).select(run, "line_no", "line")


def without_passes(lines: DataFrame, run: str = "run") -> DataFrame:
    """Lines that do not only announce a pass; runs of blank ones collapse."""
    kept = lines.where(~F.col("line").rlike(_PASSES))
    blank = F.trim("line") == ""
    before = F.lag(blank).over(Window.partitionBy(run).orderBy("line_no"))
    return kept.withColumn("__again", blank & F.coalesce(before, F.lit(False))).where("not __again").select(run, "line_no", "line")


def without_cargo_passes(lines: DataFrame, run: str = "run") -> DataFrame:
    return lines.where(~F.trim("line").rlike(_PASSES_CARGO)).select(run, "line_no", "line")


def joined_lines(lines: DataFrame, run: str = "run", most: int | None = None) -> DataFrame:
    """(run, text) again; beyond `most` lines the first ones and how many more there are."""
    texts = lines.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).select(run, F.transform("l", lambda x: x.line).alias("l"))
    whole = F.array_join("l", "\n")
    if most is None:
        return texts.select(run, whole.alias("text"))
    cut = F.concat(F.array_join(F.slice("l", 1, most), "\n"), F.lit("\n… "), (F.size("l") - most).cast("string"), F.lit(" more"))
    return texts.select(run, F.when(F.size("l") > most, cut).otherwise(whole).alias("text"))


def compressed(lines: DataFrame, tools: Sequence[str] = ("pytest", "npm_test", "cargo_test"), run: str = "run", tool: str = "tool") -> DataFrame:
    """Each run's lines shortened by its tool; those of other tools stay whole."""
    by = {"pytest": pytest_lines, "npm_test": without_passes, "cargo_test": without_cargo_passes}
    out = lines.where(~F.col(tool).isin(*tools)).select(run, "line_no", "line")
    for name in tools:
        out = out.unionByName(by[name](lines.where(F.col(tool) == name).select(run, "line_no", "line"), run))
    return out
