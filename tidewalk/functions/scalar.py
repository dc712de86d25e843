"""Column functions that all operators share. None of them lets NaN or infinity through a clamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewalk.config import CONFIG

DIGITS = 9


def r9(x: Column | str) -> Column:
    """Round where values are compared or returned, so that the order of a sum's terms can't decide a result."""
    return F.round(F.col(x) if isinstance(x, str) else x, DIGITS)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(finite(x), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))).otherwise(F.lit(0.0))


def clamp01(x: Column) -> Column:
    return clamp(x, 0, 1)


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def js_round(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5).cast("int")


def lookup(mapping, key: Column, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def interaction_weight(kind: Column) -> Column:
    return lookup(CONFIG.weights, kind)


def age_days(at: Column, now: str) -> Column:
    """Days from a timestamp without time zone to ``now``."""
    return F.timestamp_diff("MICROSECOND", at, F.lit(now).cast("timestamp_ntz")) / F.lit(86_400_000_000.0)


def time_decay(age: Column, half_life: float = CONFIG.half_life_days) -> Column:
    if half_life <= 0:
        raise ValueError("half_life must be positive")
    return F.when(~finite(age) | (age <= 0), F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age / F.lit(float(half_life))))


def duration_bucket(hours: Column) -> Column:
    out = None
    for name, most in CONFIG.duration_hours.items():
        out = F.when(hours <= most, F.lit(name)) if out is None else out.when(hours <= most, F.lit(name))
    return out.otherwise(F.lit(CONFIG.duration_rest))


def feature_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), key)


def family(feature: Column) -> Column:
    prefix = F.substring_index(feature, ":", 1)
    return F.when(prefix == "lang", "language").when(prefix.isin("tag", "difficulty", "duration"), prefix)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark prunes groups before it shuffles them."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def adjacency(affinity: Column) -> Column:
    x = clamp01(affinity)
    return 4 * x * (1 - x)


def novelty(popularity: Column, affinity: Column) -> Column:
    return CONFIG.novelty_underexposure * (1 - clamp01(popularity)) + CONFIG.novelty_adjacency * adjacency(affinity)


def exploration_limit(e: Column) -> Column:
    return js_round(CONFIG.exploration_min + (CONFIG.exploration_max - CONFIG.exploration_min) * clamp01(e))


def plausibility(content: Column, collaborative: Column, popularity: Column) -> Column:
    none = content.isNull() & collaborative.isNull()
    best = F.greatest(F.lit(0.0), F.coalesce(content, F.lit(0.0)), F.coalesce(collaborative, F.lit(0.0)))
    return F.when(none, clamp01(popularity)).otherwise(clamp01(best))


def exploration_score(p: Column, n: Column, e: Column) -> Column:
    e = clamp01(e)
    return clamp01((1 - e) * p + e * (CONFIG.exploration_novelty * n + (1 - CONFIG.exploration_novelty) * p))


def discovery_mode(e: Column) -> Column:
    return F.when(e <= CONFIG.familiar_max, "familiar").when(e >= CONFIG.adventurous_min, "adventurous").otherwise("balanced")


def diversification_lambda(e: Column) -> Column:
    return F.greatest(F.lit(CONFIG.lambda_range[0]), F.least(F.lit(CONFIG.lambda_range[1]), CONFIG.lambda_base + CONFIG.lambda_slope * e))


def max_items_per_tag(limit: int, e: Column) -> Column:
    return F.greatest(F.lit(CONFIG.min_per_tag), js_round(clamp01(CONFIG.tag_share + CONFIG.tag_share_slope * e) * limit))


def fnv1a(text: Column) -> Column:
    """The 32-bit hash of an ASCII string, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c) * F.lit(16777619).cast("long") % F.lit(1 << 32).cast("long"))


def format_hours(hours: Column) -> Column:
    return F.concat(F.lit("~"), hours.cast("string"), F.lit("h"))


def format_duration(hours: Column) -> Column:
    return F.concat(lookup(CONFIG.duration_labels, duration_bucket(hours)), F.lit(" · "), format_hours(hours))


def format_score(score: Column) -> Column:
    return js_round(100 * clamp01(score))


def prose_label(label: Column) -> Column:
    """Title-case words in lower case; acronyms stay."""
    return F.array_join(F.transform(F.split(label, " "), lambda w: F.when(w.rlike("^[A-Z][a-z]+$"), F.lower(w)).otherwise(w)), " ")


def join_natural(items: Column) -> Column:
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.get(items, 0)).otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(" and "), F.get(items, n - 1)))


def split_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
