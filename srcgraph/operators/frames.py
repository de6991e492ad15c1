"""What ran, joined with what is indexed: stack frames and recorded calls beside symbols.

Names are joined by equality on the lower-cased short name; the best symbol for a frame or a reference is
an arg-max, which combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions import text as T

from . import resolve

# Beginnings of framework names, and parts of framework paths (fixed values).
FRAMEWORK_PREFIXES = (
    "system.", "microsoft.", "mscorlib", "netstandard", "newtonsoft.", "serilog.", "nlog.", "log4net.",
    "automapper.", "mediatr.", "castle.", "nhibernate.", "entityframework", "dapper.", "polly.", "xunit.",
    "nunit.", "moq.", "internal/", "node:", "webpack", "react-dom", "next/dist",
)
FRAMEWORK_PATHS = ("node_modules", "site-packages", "/usr/lib/")


def _slashed(path: Column) -> Column:
    return F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))


def is_framework(method: Column, path: Column) -> Column:
    """Whether a frame belongs to a framework by its name or its path."""
    name, slashed = F.lower(F.coalesce(method, F.lit(""))), _slashed(path)
    found = F.lit(False)
    for prefix in FRAMEWORK_PREFIXES:
        found = found | name.startswith(prefix)
    for part in FRAMEWORK_PATHS:
        found = found | slashed.contains(part)
    return found


def resolve_frames(frames: DataFrame, symbols: DataFrame) -> DataFrame:
    """frames (trace_id, line_no, method, path, line) with status project, external or unresolved, the
    symbol that explains each best (its class, file name, path, production code, in this order of weight;
    the smaller sym_seq on a tie) and drift, where the frame's line is outside the symbol's extent."""
    named = frames.select("trace_id", "line_no", "method", F.col("path").alias("trace_path"), F.col("line").alias("trace_line"))
    # What explains a frame hangs on its method and path alone, so each pair of them is looked up once.
    asked = named.select("method", "trace_path").distinct().withColumn("name_l", F.lower(T.short_name(F.col("method"))))
    found = asked.join(symbols.select("name_l", "name", "container", "path", "line", "end_line", "is_test", "generated", "sym_seq"), "name_l")
    owners = F.transform(F.slice(F.split("method", "[.#]"), 1, F.size(F.split("method", "[.#]")) - 1), F.lower)
    base = lambda p: F.element_at(F.split(_slashed(p), "/"), -1)
    same_file = F.col("trace_path").isNotNull() & (base(F.col("trace_path")) == base(F.col("path")))
    one = lambda c, n: F.when(c, n).otherwise(0)
    score = (
        one(F.coalesce(F.array_contains(owners, F.lower("container")), F.lit(False)), 4) + one(same_file, 3) + one(F.col("trace_path").isNotNull() & (_slashed(F.col("trace_path")) == _slashed(F.col("path"))), 2)
        + one(~F.col("is_test"), 1) + one(~F.col("generated"), 1)
    )
    frame = ["method", "trace_path"]
    best = found.groupBy(*frame).agg(F.max_by(F.struct("name", "container", "path", "line", "end_line"), F.struct(score.alias("s"), (-F.col("sym_seq")).alias("o"))).alias("best"))
    best = best.select("best", *(F.col(c).alias(f"__{c}") for c in frame))
    joined = named.join(best, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in frame], "left")
    status = F.when(F.col("best").isNotNull(), "project").when(is_framework(F.col("method"), F.col("trace_path")), "external").otherwise("unresolved")
    known = (F.col("best.end_line") >= F.col("best.line")) & F.col("trace_line").isNotNull()
    drift = F.coalesce(known & ~F.col("trace_line").between(F.col("best.line"), F.col("best.end_line")), F.lit(False))
    return joined.select("trace_id", "line_no", "method", "trace_path", "trace_line", status.alias("status"), F.col("best.path").alias("path"), F.col("best.line").alias("line"), F.col("best.container").alias("container"), drift.alias("drift"))


def stack_totals(resolved: DataFrame) -> DataFrame:
    """Frames by status, lines that drifted, and the first frame of the project, for each trace."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return resolved.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("total"), count("project"), count("external"), count("unresolved"), F.count_if("drift").alias("drifted"), F.min(F.when(F.col("status") == "project", F.col("line_no"))).alias("start_here")
    )


def find_symbols(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, symbol): the likeliest symbol of each recorded name: that of the named class, else production
    logic, else the first; names without any are left out."""
    parts = F.split("ref", "[.#]")
    asked = references.select("ref").distinct().withColumns({"name_l": F.lower(F.element_at(parts, -1)), "owner": F.when(F.size(parts) > 1, F.lower(F.element_at(parts, -2)))})
    found = asked.join(symbols, "name_l")
    logic = ~F.col("is_test") & ~F.col("generated") & F.col("kind").isin("method", "function", "constructor")
    order = F.struct(F.coalesce(F.col("owner") == F.lower("container"), F.lit(False)).alias("own"), logic.alias("logic"), (-F.col("sym_seq")).alias("o"))
    return found.groupBy("ref").agg(F.max_by(F.struct("name", "path", "line", "container", "is_test"), order).alias("symbol"))


def runtime_sites(recorded: DataFrame, symbols: DataFrame) -> DataFrame:
    """Verified call sites of recorded calls (caller, callee, count). A callee that is not indexed goes; a
    caller that is not leaves a site at file scope."""
    names = recorded.select(F.col("callee").alias("ref")).unionByName(recorded.select(F.col("caller").alias("ref"))).where("ref is not null and trim(ref) <> ''")
    known = find_symbols(names, symbols)
    callee = known.select(F.col("ref").alias("callee"), F.col("symbol").alias("to"))
    caller = known.select(F.col("ref").alias("caller"), F.col("symbol").alias("from"))
    met = recorded.join(callee, "callee").join(caller, "caller", "left")
    return met.select(
        F.xxhash64(F.lit("runtime"), "caller", "callee").alias("site_seq"), F.col("to.name").alias("callee"), F.lower("to.name").alias("callee_l"), F.coalesce("from.line", "to.line").alias("line"),
        F.lit(None).cast("string").alias("recv"), F.lit(resolve.RECV_BARE).alias("recv_kind"), F.lit(-1).alias("argc"), F.col("from.name").alias("caller"), F.coalesce("from.line", F.lit(0)).alias("caller_line"),
        F.col("from.container").alias("caller_container"), F.coalesce("from.path", "to.path").alias("caller_path"), F.lit(None).cast("string").alias("recv_type"), F.lit(True).alias("verified"),
        F.coalesce("from.is_test", F.lit(False)).alias("caller_is_test"), F.col("count").alias("hits"),
    )


def with_runtime(static: DataFrame, runtime: DataFrame) -> DataFrame:
    """Static and recorded sites in one table; hits are null for static ones."""
    return static.unionByName(runtime, allowMissingColumns=True)
