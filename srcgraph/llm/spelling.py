"""Spelling variants: words that differ by one edit, joined over a reduced alphabet.

1. Runs of letters are counted (count_words); words under LEAST_LENGTH code points or LEAST_COUNT occurrences
   are none.
2. Each letter is hashed to one of SYMBOLS symbols. Words at distance one have reduced words at distance one
   or zero, so each word's reduced word, its one-edit neighbourhood and the vocabulary of reduced words meet in
   one equi-join. An insertion is the other word's deletion and a replacement is made by the larger reduced
   word alone, so that a pair is made once.
3. Pairs are verified on the original strings.
4. A word's form is its near word of most occurrences where those are RATIO times its own or more; forms of forms
   are followed by pointer doubling.

Keys of a word grow with its length alone; hot reduced words are split by the engine's skew join. All work is
built-in functions; nothing but round counts comes to the driver.

Defined cases: null and empty texts hold no words; very long texts are taken whole; a null doc_id counts as the
empty text where occurrences are changed; repeated rows count again; ties of n go to the form that is first in
code-point order; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import dropped, stored

LEAST_LENGTH, LEAST_COUNT, RATIO, SYMBOLS, CHANGED = 7, 2, 10, 8, 31
#: Each form has RATIO times the occurrences of its word, so chains are short.
MOST_ROUNDS = 20
UPPER = "".join(map(chr, range(65, 91)))
LETTERS = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """The word with each letter hashed to a symbol; lengths stay."""
    return F.translate(word, LETTERS, "".join(chr(97 + (ord(c) * 7 + ord(c) // 8) % symbols) for c in LETTERS))


def neighbourhood(word: Column, symbols: int = SYMBOLS) -> Column:
    """Reduced words at distance one of a reduced word, as far as the other word does not make the pair:
    deletions, and replacements that come before it in order."""
    at = F.sequence(F.lit(1), F.length(word))
    cut = F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    signs = F.array(*(F.lit(chr(97 + s)) for s in range(symbols)))

    def replaced(i: Column) -> Column:
        own = F.substring(word, i, F.lit(1))
        smaller = F.filter(signs, lambda s: s < own)
        return F.transform(smaller, lambda s: F.concat(F.substring(word, F.lit(1), i - 1), s, F.substring(word, i + 1, F.length(word))))

    return F.array_union(cut, F.flatten(F.transform(at, replaced)))


def count_words(docs: DataFrame, changed: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the texts of (doc_id, text). Where `changed` is given, each occurrence whose checksum it
    divides loses one letter, as typing errors would."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]{%d,}" % least_length), F.lit(0))).alias("run"))
    word = F.translate("run", UPPER, UPPER.lower())
    if changed:
        runs = runs.select(word.alias("run"), F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word)).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % changed == 0, short).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, na, b, nb): each pair of words (word, n) at distance one, once."""
    key = lambda r: F.xxhash64(r)
    index = words.select(key(reduced(F.col("word"), symbols)).alias("key"), F.col("word").alias("b"), F.col("n").alias("nb"))
    small = words.select(F.col("word").alias("a"), F.col("n").alias("na"), reduced(F.col("word"), symbols).alias("r"))
    own = F.array(F.struct(key(F.col("r")).alias("key"), F.lit(True).alias("own")))
    keys = F.concat(own, F.transform(neighbourhood(F.col("r"), symbols), lambda x: F.struct(key(x).alias("key"), F.lit(False).alias("own"))))
    probes = small.select("a", "na", F.explode(keys).alias("k")).select("k.key", "k.own", "a", "na")
    met = probes.join(index.hint("shuffle_hash"), "key").where(~F.col("own") | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last one."""
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MOST_ROUNDS):
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = stored(state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not following.where("moved").isEmpty()
        dropped(state)
        state = following.drop("moved")
        if not moved:
            return state
    raise RuntimeError(f"forms are not followed to their ends after {MOST_ROUNDS} rounds")


def grouped(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of (word, n); words are distinct."""
    words = stored(words, "words")
    pairs = near_pairs(words, symbols)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m"))))
    best = pairs.select(sides.alias("s")).select("s.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    has = -F.col("best.m") >= ratio * F.col("n")
    found = stored(joined.select("word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
