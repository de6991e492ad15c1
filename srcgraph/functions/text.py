"""Column expressions on names, paths, URLs and texts. All run inside code generation or as
higher-order functions; none needs Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segments that say nothing about a route (fixed values).
URL_STOP = ("", "api", "v1", "v2", "v3", "index")
# Parts of the paths of generated files (fixed values).
GENERATED = ("/connected services/", "reference.cs", ".g.cs", ".designer.")
# Words in the names of files that are entered from outside (fixed values).
ENTRIES = "controller|consumer|processor|handler|endpoint|worker|program|startup"
COMMENT_MARKERS = "TODO|FIXME|HACK|XXX|BUG|DEPRECATED|WORKAROUND"


def short_name(name: Column) -> Column:
    """Last segment after a dot or a hash."""
    return F.element_at(F.split(name, "[.#]"), -1)


def id_tokens(name: Column) -> Column:
    """Lower-case words of a camel, Pascal or snake name; acronyms and digit runs are words."""
    return F.transform(F.regexp_extract_all(name, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), F.lower)


def collapsed(name: Column) -> Column:
    return F.array_join(id_tokens(name), "")


def suffixes(name: Column) -> Column:
    """Every run of words up to the end, joined: what a prefix query is held against."""
    tokens = id_tokens(name)
    joined = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.array_join(F.slice(tokens, i, F.size(tokens)), ""))
    return F.when(F.size(tokens) > 0, joined).otherwise(F.array().cast("array<string>"))


def matches(name: Column, query: str) -> Column:
    """Word-boundary prefix match; an empty query never matches."""
    wanted = "".join(c for c in query.lower() if c.isascii() and c.isalnum())
    return F.exists(suffixes(name), lambda s: s.startswith(wanted)) if wanted else F.lit(False)


def token_estimate(text: Column) -> Column:
    """About four characters a token, half to even, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.bround(F.length(text) / F.lit(4.0), 0).cast("long"))


def url_tokens(url: Column) -> Column:
    """Distinct path segments of a URL without stop segments, parameters and numbers."""
    path = F.regexp_extract(url, r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1)
    segments = F.array_distinct(F.split(F.lower(path), "/"))
    return F.filter(segments, lambda s: ~s.isin(*URL_STOP) & ~s.rlike(r"^([0-9]+|[{:<].*)$"))


def is_test_path(path: Column) -> Column:
    lowered = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    stem = F.regexp_extract(lowered, r"([^/]*)$", 1)
    return lowered.rlike(r"(^|/)(tests?|[^/]*\.tests?)/") | stem.rlike(r"(^|[^a-z])(tests?|spec)([^a-z]|$)")


def is_entry_path(path: Column) -> Column:
    """Whether a file's name says that it is entered from outside."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1).rlike(f"(?i)({ENTRIES})")


def is_generated_path(path: Column, marks: Sequence[str] = GENERATED) -> Column:
    lowered = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(lowered, F.lit(mark))
    return found


def first_sentence(text: Column, most: int = 120) -> Column:
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.regexp_extract(clean, r"^(.*?[.!?])(?: |$)", 1)
    chosen = F.when(head != "", head).otherwise(clean)
    return F.when(F.length(chosen) > most, F.concat(F.substring(chosen, 1, most - 1), F.lit("…"))).otherwise(chosen)


def field_predicate(field: Column, op: str, value: str) -> Column:
    """One (field, operator, text) condition: ~ contains and = compare text without case, the
    others compare numbers; text that is no number compares false."""
    text, number = F.lower(F.coalesce(field.cast("string"), F.lit(""))), F.lit(value).try_cast("double")
    own = field.try_cast("double")
    made = {
        "~": lambda: F.contains(text, F.lit(value.lower())),
        "=": lambda: text == value.lower(),
        "!=": lambda: text != value.lower(),
        ">": lambda: own > number,
        "<": lambda: own < number,
        ">=": lambda: own >= number,
        "<=": lambda: own <= number,
    }
    return F.coalesce(made[op](), F.lit(False))


def all_of(conditions: Sequence[tuple[str, str, str]], fields: Sequence[str]) -> Column:
    """Conjunction of conditions over a known list of fields."""
    out = F.lit(True)
    for field, op, value in conditions:
        if field not in fields:
            raise ValueError(f"unknown field {field}; known: {', '.join(fields)}")
        out = out & field_predicate(F.col(field), op, value)
    return out
