"""Evidence for call edges: which definition a call site means, and how sure that is.

Sites carry callee_l, caller_path, caller_container, recv, recv_kind, recv_type, argc, verified and a
key; definitions carry name_l, path, container, pmin, pmax, pflags. Unknown arity is negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tiers and receiver kinds (fixed values).
CONTRADICTED, NAME_ONLY, FITS, STRONG, EXACT, VERIFIED = -1, 0, 1, 2, 3, 4
RECV_BARE, RECV_EXPR, RECV_IDENT, RECV_SELF, RECV_NEW = range(5)
# Kinds that hold members (fixed values).
CONTAINERS = ("class", "module", "struct", "structure", "record", "interface", "component")


def arity_fits(argc: Column, pmin: Column, pmax: Column, pflags: Column) -> Column:
    """Three-valued: null where a side is unknown; extension methods may lack their receiver."""
    unknown = (argc < 0) | (pmin < 0) | (pmax < 0)
    extended = (pflags.bitwiseAND(1) == 1) & (argc + 1).between(pmin, pmax)
    return F.when(unknown, F.lit(None).cast("boolean")).otherwise(argc.between(pmin, pmax) | extended)


def tier(fits: Column, implements: Column | None = None, known_type: Column | None = None) -> Column:
    """The evidence ladder of one (site, definition) row; the first rule that holds decides."""
    same = lambda a, b: F.lower(F.col(a)) == F.lower(F.col(b))
    declared = same("recv_type", "container") | (implements if implements is not None else F.lit(False))
    named = (F.col("recv_kind") == RECV_IDENT) & (F.col("recv") == F.col("container")) & (known_type if known_type is not None else F.lit(True))
    own = (F.col("recv_kind") == RECV_SELF) & same("caller_container", "container")
    held = F.col("container").isNotNull() & F.coalesce(fits, F.lit(True))
    return (
        F.when(F.coalesce(F.col("verified"), F.lit(False)), VERIFIED)
        .when(held & F.coalesce(declared | named | own, declared, named, own, F.lit(False)), EXACT)
        .when(fits == F.lit(False), CONTRADICTED)
        .when(fits & (F.col("caller_path") == F.col("path")), STRONG)
        .when(fits, FITS)
        .otherwise(NAME_ONLY)
    )


def candidates(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each site with each definition of its callee's name, or none, and the tier of the pair. Where symbols carry
    kind and bases, a receiver's declared type also fits the types that name it as a base, one step down, and a
    receiver's name counts as a type only if there is one. The engine chooses the joins; nothing is broadcast by
    hand, as symbols grow with the corpus."""
    fits = arity_fits(F.col("argc"), F.col("pmin"), F.col("pmax"), F.col("pflags"))
    if not {"bases", "kind"} <= set(symbols.columns):
        return sites.join(symbols, sites["callee_l"] == symbols["name_l"], "left").withColumn("tier", F.when(F.col("name_l").isNotNull(), tier(fits)))
    types = symbols.where(F.col("kind").isin(*CONTAINERS))
    # One class's bases; a receiver that is named like the container is a type where the container is one.
    steps = types.select(F.col("name").alias("container"), F.explode_outer("bases").alias("base")).groupBy("container").agg(F.collect_set(F.lower("base")).alias("__bases")).withColumn("__known", F.lit(True))
    pairs = sites.join(symbols.join(steps, "container", "left"), F.col("callee_l") == F.col("name_l"), "left")
    implements = F.coalesce(F.array_contains("__bases", F.lower("recv_type")), F.lit(False))
    return pairs.withColumn("tier", F.when(F.col("name_l").isNotNull(), tier(fits, implements, F.coalesce("__known", F.lit(False))))).drop("__bases", "__known")


def edge_tiers(pairs: DataFrame, site_key: str = "site_seq") -> DataFrame:
    """Best tier of each site, NAME_ONLY where nothing is known."""
    return pairs.groupBy(site_key).agg(F.coalesce(F.max("tier"), F.lit(NAME_ONLY)).alias("tier"))


def best_definition(pairs: DataFrame, site_key: str = "site_seq") -> DataFrame:
    """One definition for each site. Tiers outrank the plain order only where one is STRONG, or where
    contradictions leave exactly one place. Both picks are aggregates that combine before the shuffle."""
    row = F.struct(*(F.col(c) for c in pairs.columns if c != site_key))
    order = ["is_test", "generated", "not_logic", "path", "sym_seq"]
    place = F.when(F.col("tier") != CONTRADICTED, F.struct("path", "line"))
    picked = pairs.where("name_l is not null").groupBy(site_key).agg(
        F.max("tier").alias("most"), F.min("tier").alias("least"), F.min(place).alias("one"), F.max(place).alias("other"),
        F.min_by(row, F.struct(*order)).alias("first"), F.min_by(row, F.struct((-F.col("tier")).alias("t"), *order)).alias("likely"),
    )
    gate = (F.col("most") >= STRONG) | F.coalesce((F.col("least") == CONTRADICTED) & (F.col("one") == F.col("other")), F.lit(False))
    return picked.select(site_key, F.when(gate, F.col("likely")).otherwise(F.col("first")).alias("r")).select(site_key, "r.*").select(pairs.columns)


def unanimous(pairs: DataFrame, by: str, site_key: str = "site_seq") -> DataFrame:
    """Names whose every site supports one and the same place with STRONG evidence."""
    place = F.struct("qualified", "path", "line")
    per_site = pairs.groupBy(by, site_key).agg(F.collect_set(F.when(F.col("tier") >= STRONG, place)).alias("places"))
    per_name = per_site.groupBy(by).agg(F.min(F.size("places")).alias("least"), F.max(F.size("places")).alias("most"), F.min(F.get("places", F.lit(0))).alias("one"), F.max(F.get("places", F.lit(0))).alias("other"))
    return per_name.where("least = 1 and most = 1 and one = other").select(by, "one.*")
