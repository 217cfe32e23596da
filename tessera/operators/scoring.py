"""Row scoring, banding and validation of items, listings and trades, as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import block_pairs

# Bands, multipliers and points that results depend on.
HIGH, MEDIUM = 0.75, 0.60
CATEGORY = {"electronics": 1.2, "jewelry": 1.4, "collectibles": 1.3, "tools": 1.1, "books": 0.9, "clothing": 0.8, "home_decor": 0.9, "sports": 1.0, "music": 1.1, "art": 1.3}
BRAND = {"apple": 1.5, "samsung": 1.3, "sony": 1.2, "nike": 1.3, "adidas": 1.2, "rolex": 2.0, "tiffany": 1.8, "coach": 1.4, "gucci": 1.6}
CONDITION = {"poor": 0.5, "fair": 0.7, "good": 1.0, "excellent": 1.3}
POSITIVE = ["rare", "vintage", "limited", "mint", "perfect", "new", "original", "authentic"]
NEGATIVE = ["damaged", "broken", "worn", "scratched", "missing", "cracked"]
COMPATIBLE = {"electronics": ["electronics", "collectibles", "tools"], "jewelry": ["jewelry", "collectibles", "art"], "collectibles": ["collectibles", "art", "jewelry"]}
MARKETPLACE = {"Facebook Marketplace": 5, "Craigslist": 0, "OfferUp": 3, "eBay": 8}
STEPS = [(10, 0.5, 1.0), (100, 0.3, 0.5), (1000, 0.2, 0.3), (5000, 0.1, 0.15), (None, 0.05, 0.1)]


def choose(value: Column, table: Mapping, other: Column) -> Column:
    """The entry of a small lookup table, by equality."""
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return other if out is None else out.otherwise(other)


def quality_band(score: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def keyword_multiplier(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE, cap: float = 1.5) -> Column:
    """1.1 for each positive and 0.9 for each negative keyword in the text, capped."""
    lower = F.lower(text)
    product = F.lit(1.0)
    for word in positive:
        product = product * F.when(F.contains(lower, F.lit(word)), 1.1).otherwise(1.0)
    for word in negative:
        product = product * F.when(F.contains(lower, F.lit(word)), 0.9).otherwise(1.0)
    return F.when(F.coalesce(text, F.lit("")) == "", 1.0).otherwise(F.least(product, F.lit(cap)))


def item_value(base: Column, category: Column, brand: Column, condition: Column, description: Column) -> Column:
    """The estimate of an item's value, to two decimals."""
    named = F.coalesce(brand, F.lit("")) != ""
    factor = choose(F.lower(category), CATEGORY, F.lit(1.0)) * F.when(named, choose(F.lower(brand), BRAND, F.lit(1.1))).otherwise(1.0) * choose(F.lower(condition), CONDITION, F.lit(1.0)) * keyword_multiplier(description)
    return F.round(base * factor, 2)


def step_band(value: Column) -> Column:
    """The range of increase to aim at, as struct (lo, hi)."""
    out = None
    for limit, lo, hi in STEPS:
        pair = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        if limit is None:
            return out.otherwise(pair)
        out = F.when(value < limit, pair) if out is None else out.when(value < limit, pair)
    return out


def trade_score(from_category: Column, from_value: Column, from_brand: Column, to_category: Column, to_value: Column, jitter: Column | None = None, compatible: Mapping = COMPATIBLE) -> Column:
    """How likely a trade is, 10 to 95; jitter, if wanted, is a column of the caller's."""
    ratio = (to_value - from_value) / from_value
    fits = F.lit(False)
    for category, others in compatible.items():
        fits = fits | ((from_category == category) & to_category.isin(*others))
    score = F.lit(70) + F.when(fits, 10).otherwise(0) + F.when(ratio < 0.2, 15).when(ratio < 0.5, 10).when(ratio > 1.0, -20).otherwise(0) + F.when(F.coalesce(from_brand, F.lit("")) != "", 10).otherwise(0)
    return F.greatest(F.least(score + (F.lit(0) if jitter is None else jitter), F.lit(95)), F.lit(10))


def listing_score(target_value: Column, value: Column, distance: Column, marketplace: Column, jitter: Column | None = None) -> Column:
    """How good a listing is for a target, 10 to 95."""
    ratio = F.when(target_value > 0, value / target_value)
    score = F.lit(60) + F.when(ratio.between(1.05, 1.5), 20).when(ratio.between(1.0, 1.05), 10).when(ratio > 2.0, -30).otherwise(0) - F.least(distance * 2, F.lit(20)) + choose(marketplace, MARKETPLACE, F.lit(0))
    return F.greatest(F.least(score + (F.lit(0) if jitter is None else jitter), F.lit(95)), F.lit(10))


def pct_increase(old: Column, new: Column) -> Column:
    return F.when(old == 0, 0.0).otherwise((new - old) / old * 100)


def format_currency(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def human_bytes(size: Column) -> Column:
    out = F.format_string("%.2f TB", size / 1024**4)
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        out = F.when(size < 1024 ** (power + 1), F.format_string(f"%.2f {unit}", size / 1024**power)).otherwise(out)
    return out


def time_ago(then: Column, as_of: Column) -> Column:
    """Days, hours or minutes before as_of, else "Just now"."""
    seconds = F.timestamp_diff("SECOND", then, as_of)
    part = lambda n, unit: F.concat((n).cast("bigint").cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds >= 86400, part(F.floor(seconds / 86400), "d")).when(seconds >= 3600, part(F.floor(seconds / 3600), "h")).when(seconds >= 60, part(F.floor(seconds / 60), "m")).otherwise("Just now")


def first_failure(rules: Sequence[tuple[Column, str]]) -> Column:
    """The message of the first rule that a row breaks, or null; rules: (holds, message)."""
    return F.coalesce(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(message)) for holds, message in rules))


def sanitize_name(name: Column, shortest: int = 3, longest: int = 63) -> Column:
    """A lower-case name of letters, digits, - and _, that starts and ends with a letter
    or digit."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), r"^[-_]+", "")
    clean = F.when(clean.rlike(r"^[\p{L}\p{N}]"), clean).otherwise(F.concat(F.lit("p_"), clean))
    clean = F.regexp_replace(clean, r"[-_]+$", "")
    sized = F.when(F.char_length(clean) < shortest, F.concat(clean, F.lit("_collection"))).otherwise(F.substring(clean, 1, longest))
    return F.lower(sized)


def slug(name: Column, longest: int = 30) -> Column:
    return F.regexp_replace(F.substring(name, 1, longest), r"[^A-Za-z0-9_]", "_")


def redact_secrets(text: Column, keys: Sequence[str]) -> Column:
    """The value of KEY=value lines is masked for the given keys."""
    return F.regexp_replace(text, rf"(?m)^({'|'.join(keys)})=[^\r\n]*", r"$1=***REDACTED***")


def count_secrets(text: Column, keys: Sequence[str]) -> Column:
    return F.regexp_count(text, F.lit(rf"(?m)^({'|'.join(keys)})="))


def vector_fault(stored: Column, dimensions: int) -> Column:
    """Why a vector kept as JSON text cannot be used: undecodable, empty or dimension; null
    if it can."""
    v = F.from_json(stored, "array<double>", {"mode": "PERMISSIVE"})
    return F.when(v.isNull(), "undecodable").when(F.size(v) == 0, "empty").when(F.size(v) != dimensions, "dimension")


def in_value_range(rows: DataFrame, value: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """Rows with a value from least to most, both inclusive; None: no limit."""
    if least is not None:
        rows = rows.filter(F.col(value) >= least)
    return rows if most is None else rows.filter(F.col(value) <= most)


def other_category(items: DataFrame, others: DataFrame, on: list[str], category: str) -> DataFrame:
    """Pairs of an item and another (columns prefixed item_ and other_) that agree on some
    columns and differ in category."""
    names = [f"_on{i}" for i in range(len(on))]
    a, b = (df.select(*(F.col(c).alias(n) for c, n in zip(on, names, strict=True)), *(F.col(c).alias(f"{name}_{c}") for c in df.columns)) for name, df in (("item", items), ("other", others)))
    return block_pairs(a, b, names, apart=(f"item_{category}", f"other_{category}")).select(*a.columns[len(on) :], *b.columns[len(on) :])


def listings(rows: DataFrame, category: Column, profit: str, key: str, wanted: str | None = None, least: float | None = None) -> DataFrame:
    """Listings of one category, or all, from a profit on, best first."""
    if wanted is not None:
        rows = rows.filter(category == wanted)
    if least is not None:
        rows = rows.filter(F.col(profit) >= least)
    return rows.orderBy(F.desc(profit), key)


def due(entities: DataFrame, checks: DataFrame, key: str, next_check: str, as_of: Column) -> DataFrame:
    """Entities never checked, or whose next check is not after as_of."""
    return entities.join(checks, key, "left").filter(F.col(next_check).isNull() | (F.col(next_check) <= as_of)).select(*entities.columns)


def unique_key_check(batch: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """The batch with a verdict: exists (the key is taken), repeated (a row before it in the
    batch has the key) or new."""
    there = existing.select(key).distinct().withColumn("_there", F.lit(True))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return batch.join(there, key, "left").withColumn("verdict", F.when(F.col("_there"), "exists").when(nth > 1, "repeated").otherwise("new")).drop("_there")
