"""URL filter: allow and block rules, then logistic regression on hashed character n-grams.

DataFrame and SQL functions only: URLs are cut apart by string functions, n-grams come from a
higher-order function, hashing, fitting and scoring are Spark ML stages in the JVM. A row is judged
on its own, so a pass over the URLs has no shuffle.

Defined cases: a null URL, or one without "://", has an empty host and path and no rule, and is
judged by the model's intercept. Very long URLs are read whole. An empty table gives an empty result.
Repeated rows are judged alike. Rules of equal length that fit: the last in alphabetical order. Other
columns go through untouched; names that clash with a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, rule); a rule is a domain, a slash and the start of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Rules become one CASE expression, so their number is bounded.
MAX_RULES = 500
BUCKETS, GRAMS = 1 << 13, (3, 4, 5)

# Names of the labelled table: everyday sites (0) and junk sites (1), chosen as such names are in general.
_SITES_0 = (
    "news library museum university school garden weather recipes travel history science football music "
    "letters archive journal market council hospital theatre bakery cycling forest river physics chemistry "
    "poetry painting village station radio bridge harbour island mountain reading writing walking family "
    "kitchen railway concert gallery parish festival software database compiler notebook lecture student "
    "teacher children parents nature animals birds trees flowers ocean climate energy transport housing "
    "election parliament justice economy culture language grammar dictionary translation philosophy "
    "mathematics astronomy biology medicine nursing dentist pharmacy-guide clinic fitness running swimming "
    "tennis chess sailing fishing camping hiking photography film cinema television magazine publisher "
    "bookshop stationery carpenter plumber electrician architect engineer surveyor insurance-advice "
    "pension-advice city-hall open-data local-events old-town north-shore green-energy blue-lake "
    "the-other-side mother-and-child southern-cooking another-day thirty-thoughts national-trust "
    "information tradition education nutrition station-house motion-study"
).split()
_SITES_1 = (
    "casino-bonus online-casino casino-royal live-casino win-money win-big bet-now best-bets sport-bets "
    "bets-online poker-chips poker-win slots-free jackpot-slots lottery-win roulette-spin buy-pills "
    "pills-online diet-pills weight-loss-pills cheap-meds cheap-viagra cheap-watches pharmacy-discount "
    "viagra-shop adult-cams adult-dating adult-video xxx-video xxx-cams hot-singles sexy-chat spam-links "
    "spam-mail spammer link-farm seo-farm click-farm content-farm ad-tracker track-click tracker-pixel "
    "ads-server popup-ads banner-ads pop-ads free-money free-prize free-spins free-download-crack win-prize "
    "loan-fast payday-loan replica-watch crack-warez warez-full crypto-double get-rich-quick miracle-diet "
    "fake-brands hacked-accounts"
).split()
_WRAPS = (
    "https://www.{}.com/",
    "http://{}.org/about",
    "https://blog.{}.net/2019/05/post.html",
    "http://m.{}.co.uk/item/31?lang=en",
    "https://{}.info/list#more",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: (url, label). Both classes share prefixes, endings and paths, so that only
    the names tell them apart; everyday names are more, as they are in general."""
    rows = [(wrap.format(site), label) for label, sites in ((0, _SITES_0), (1, _SITES_1)) for site in sites for wrap in _WRAPS]
    values = ", ".join(f"('{url}', {label}D)" for url, label in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end; A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(kind)).otherwise(verdict)
    return found, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of the two parts, each marked with the part it comes from."""
    parts = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))):
        for n in GRAMS:
            starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, _cut(text, n, mark)))
    return F.concat(*parts)


def _cut(text: Column, n: int, mark: str) -> Callable[[Column], Column]:
    return lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n)))


def _features(df: DataFrame) -> DataFrame:
    with_grams = df.withColumn("__grams", grams(F.col("__host"), F.col("__path")))
    return HashingTF(inputCol="__grams", outputCol="__features", numFeatures=BUCKETS, binary=True).transform(with_grams)


def fit(labelled: DataFrame) -> LogisticRegressionModel:
    """Fit on (url, label); the table is small by contract, the model has BUCKETS weights."""
    rows = _features(labelled.select("label", host_of(F.col("url")).alias("__host"), path_of(F.col("url")).alias("__path")))
    return LogisticRegression(featuresCol="__features", labelCol="label", regParam=0.003, maxIter=30, standardization=False).fit(rows)


def judge(df: DataFrame, model: LogisticRegressionModel, rules: Sequence[tuple[str, str]] = RULES, url: str = "url") -> DataFrame:
    """df with host, path, rule, verdict and junk_probability."""
    kept = df.select("*", host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"))
    kept = kept.fillna({"__host": "", "__path": ""})
    scored = model.setProbabilityCol("__probability").setRawPredictionCol("__raw").setPredictionCol("__prediction").transform(_features(kept))
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    p = vector_to_array(F.col("__probability"))[1]
    method = F.when(p >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    out = scored.withColumns({"host": F.col("__host"), "path": F.col("__path"), "rule": rule, "verdict": F.coalesce(verdict, method), "junk_probability": p})
    return out.drop("__host", "__path", "__grams", "__features", "__probability", "__raw", "__prediction")
