"""Column functions: text cleaning, distances, factor normalisation, bands. All stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity, criticality, dependency and single-source scales.
SEVERITY = {"1": 0.20, "2": 0.40, "3": 0.60, "4": 0.80, "5": 1.00, "1.0": 0.20, "2.0": 0.40, "3.0": 0.60, "4.0": 0.80, "5.0": 1.00, "low": 0.25, "medium": 0.50, "high": 0.75, "critical": 1.00, "minor": 0.25, "moderate": 0.50, "severe": 0.85, "catastrophic": 1.00, "unknown": 0.50}
CRITICALITY = {"low": 0.25, "medium": 0.50, "high": 0.85, "critical": 1.00, "tier-3": 0.35, "tier-2": 0.65, "tier-1": 1.00, "tier 3": 0.35, "tier 2": 0.65, "tier 1": 1.00, "non-critical": 0.25, "core": 0.85, "essential": 1.00, "unknown": 0.40}
DEPENDENCY = {"low": 0.25, "medium": 0.50, "high": 0.85, "critical": 1.00, "none": 0.00, "indirect": 0.35, "direct": 0.75, "sole": 1.00, "unknown": 0.50}
SINGLE_SOURCE = {"true": 1.00, "yes": 1.00, "1": 1.00, "single": 1.00, "sole": 1.00, "false": 0.00, "no": 0.00, "0": 0.00, "dual": 0.00, "multi": 0.00, "unknown": 0.30}
# The scales of the four-factor score.
SEVERITY4 = {"1": 0.20, "2": 0.40, "3": 0.60, "4": 0.80, "5": 1.00, "low": 0.25, "medium": 0.50, "high": 0.75, "critical": 1.00}
DEPENDENCY4 = {"low": 0.25, "medium": 0.50, "high": 1.00, "critical": 1.00}
CRITICALITY4 = {"unknown": 0.40, "low": 0.25, "medium": 0.50, "high": 1.00, "critical": 1.00}
# Weights of the six factors, zones of exposure, weights of the three models.
RISK_WEIGHTS = {"severity": 0.25, "exposure": 0.20, "supplier": 0.15, "product": 0.15, "dependency": 0.15, "single": 0.10}
ZONES = ((25.0, 1.00, "0-25 km"), (100.0, 0.85, "25-100 km"), (250.0, 0.65, "100-250 km"))
BEYOND, INDETERMINATE = (0.20, ">250 km"), (0.10, "UNKNOWN")
BLEND = (0.50, 0.25, 0.25)
# Words that the older linker leaves out of names.
CORPORATE_WORDS = "inc|incorporated|corp|corporation|llc|ltd|limited|co|company|enterprises|holdings|group|pvt|distributor|suppliers?|logistics|industries"
EARTH_KM = 6371.0


def clean_text(text: Column) -> Column:
    """Tags, links and control characters become spaces; runs collapse; no space before punctuation."""
    t = F.coalesce(text, F.lit(""))
    for pattern, by in ((r"<[^>]+>", " "), (r"https?://\S+|www\.\S+", " "), (r"[\x00-\x1f\x7f]", " "), (r"(?U)\s+", " ")):
        t = F.regexp_replace(t, pattern, by)
    return F.regexp_replace(F.trim(t), r" ([.,!?;:])", "$1")


def normalize_id(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def has_word(text: Column, word: str) -> Column:
    """Whole-word match of a literal term in lower-cased text."""
    return text.rlike(rf"\b{re.escape(word)}\b")


def whole_words(text: Column, words: tuple[str, ...]) -> Column:
    """The longest of the terms that stand as whole words at each place of a lower-cased text, in one pass."""
    terms = "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True))
    return F.regexp_extract_all(text, F.lit(rf"\b(?=({terms})\b)"), 1)


def hits(text: Column, words: tuple[str, ...], whole: bool = True) -> Column:
    """How many of the terms occur, as whole words or anywhere."""
    if not whole:
        return sum((text.contains(w).cast("int") for w in words), F.lit(0))
    # A found term stands also for those that it begins with, such as "freight" in "freight train".
    also = {w: [v for v in words if v != w and re.match(rf"{re.escape(v)}\b", w)] for w in words}
    found = whole_words(text, words)
    each = {w: F.array(*[F.lit(v) for v in (w, *vs)]) for w, vs in also.items() if vs}
    if not each:
        return F.size(F.array_distinct(found))
    spread = F.flatten(F.transform(found, lambda x: F.coalesce(*[F.when(x == w, a) for w, a in each.items()], F.array(x))))
    return F.size(F.array_distinct(spread))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres rounded to 4; null where a coordinate is missing or out of range."""
    fine = lat1.between(-90, 90) & lat2.between(-90, 90) & lon1.between(-180, 180) & lon2.between(-180, 180)
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    return F.when(fine, F.round(EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)), 4))


def zone(distance: Column, part: int) -> Column:
    """Score (part 1) or name (part 2) of the first zone that reaches the distance."""
    out = F.lit(BEYOND[part - 1])
    for z in reversed(ZONES):
        out = F.when(distance <= z[0], F.lit(z[part])).otherwise(out)
    return F.when(distance.isNull() | (distance < 0), F.lit(INDETERMINATE[part - 1])).otherwise(out)


def tiered_decay(distance: Column) -> Column:
    out = F.lit(0.10)
    for most, score in ((1000, 0.25), (500, 0.45), (250, 0.65), (100, 0.85), (25, 1.00)):
        out = F.when(distance <= most, F.lit(score)).otherwise(out)
    return F.when(distance < 0, F.lit(0.10)).otherwise(out)


def exponential_decay(distance: Column) -> Column:
    return F.when(distance < 0, F.lit(0.10)).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.exp(-distance / 250))), 4))


def factor(value: Column, scale: dict[str, float], default: float = 0.5) -> Column:
    """A factor in [0, 1]: null is the default, booleans are 1 and 0, names by the scale, then numbers (as they are, of 5, or of 100).

    Numbers beyond are clamped, texts that read as such numbers give the default.
    """
    kind, text = F.typeof(value), F.lower(F.trim(value.cast("string")))
    number = text.try_cast("double")
    beyond = F.when(kind == "string", F.lit(default)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))
    out = F.when(number.isNull() | F.isnan(number), F.lit(default)).when(number.between(0, 1), number).when((number > 1) & (number <= 5), F.round(number / 5, 4)).when((number > 5) & (number <= 100), F.round(number / 100, 4)).otherwise(beyond)
    for name, score in scale.items():
        out = F.when(text == name, F.lit(score)).otherwise(out)
    out = F.when(kind == "boolean", F.when(text == "true", 1.0).otherwise(0.0)).otherwise(out)
    return F.when(value.isNull(), F.lit(default)).otherwise(out)


def legacy_factor(value: Column, scale: dict[str, float], default: float = 0.5, strict: bool = True) -> Column:
    """As the four-factor score reads it: numbers before names, so that severity 1 is 1.0; names first unless ``strict``."""
    text = F.lower(F.trim(value.cast("string")))
    number = F.when(F.typeof(value) == "boolean", F.when(text == "true", 1.0).otherwise(0.0)).when(F.typeof(value) != "string", text.try_cast("double"))
    named = F.lit(None).cast("double")
    for name, score in scale.items():
        named = F.when(text == name, F.lit(score)).otherwise(named)
    scaled = F.when(number.between(0, 1), number).when((number > 1) & (number <= 5), number / 5).when(number.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number / 100)))
    return F.coalesce(*((scaled, named) if strict else (named, scaled)), F.lit(default))


def band(score: Column, critical: float = 0.75, high: float = 0.60, medium: float = 0.40) -> Column:
    return F.when(score >= critical, "CRITICAL").when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def level(value: Column) -> Column:
    return F.when(value >= 0.75, "high").when(value >= 0.40, "moderate").otherwise("low")


def safe_float(value: Column, default: float = 0.0) -> Column:
    """The value as a number; null, what doesn't read as one, and what isn't finite are the default."""
    n = value.cast("string").try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), F.lit(default)).otherwise(n)


def checked_weights(weights: Sequence[float], signed: bool = True) -> tuple[float, ...]:
    """The weights, which must sum to 1 within a thousandth and, unless ``signed``, be 0 or more; else an error."""
    if not 0.999 <= sum(weights) <= 1.001:
        raise ValueError(f"weights must sum to 1, not to {sum(weights):.4f}")
    if not signed and min(weights) < 0:
        raise ValueError("weights must not be negative")
    return tuple(weights)


def single_level(value: Column) -> Column:
    """A single source is critical or of no weight."""
    return F.when(value > 0.5, "critical").otherwise("low")


def truthy(value: Column, kind: str) -> Column:
    """What counts as true: any text that isn't empty, any number but 0, true itself; null is false."""
    held = value if kind == "boolean" else value != "" if kind == "string" else F.isnan(value.cast("double")) | (value.cast("double") != 0)
    return F.coalesce(held, F.lit(False))


def link_confidence(method: Column, score: Column) -> Column:
    c = F.when(method == "exact", F.lit(0.98)).when(method == "normalized", F.least(F.lit(0.96), 0.92 + (score - 0.90) * 0.4)).when(method == "alias", F.least(F.lit(0.92), 0.88 + (score - 0.80) * 0.3)).when(method == "fuzzy", score * 0.95).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 3)


def event_id(article: Column, kind: Column, trigger: Column, sentence: Column) -> Column:
    return F.concat(F.lit("EVT_"), F.substring(F.upper(F.sha2(F.concat_ws("_", article, kind, trigger, F.substring(sentence, 1, 50)).cast("binary"), 256)), 1, 8))


def context_window(text: Column, start: Column, end: Column, around: int = 150) -> Column:
    """The text around the characters start to end, counted from 0, with ``around`` more on either side, widened to white space and trimmed; null text is empty."""
    t = F.coalesce(text, F.lit(""))
    a, b = F.greatest(F.lit(0), start - around), F.least(F.length(t), end + around)
    word = lambda x: F.length(F.regexp_extract(x, r"(?U)^(\S*)", 1))
    a = F.greatest(F.lit(0), a - word(F.reverse(F.substring(t, F.lit(1), a + 1))))
    b = b + word(F.substring(t, b + 1, F.length(t)))
    return F.regexp_replace(F.substring(t, a + 1, b - a), r"(?U)^\s+|\s+$", "")


def legacy_linking_text(text: Column) -> Column:
    """Lower-cased, corporate words gone wherever they stand, punctuation as spaces, white space collapsed."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern, by in ((rf"\b({CORPORATE_WORDS})\b", ""), (r"[^\w\s]", " "), (r"\s+", " ")):
        t = F.regexp_replace(t, f"(?U){pattern}", by)
    return F.trim(t)


def status_badge(status: Column) -> Column:
    s = F.upper(status.cast("string"))
    return F.when(s.rlike("REAL|LIVE|NEWSAPI"), "LIVE / NEWSAPI").otherwise("DEMO DATA")


def band_badge(band: Column) -> Column:
    b = F.upper(band.cast("string"))
    return F.when(b.isin("CRITICAL", "HIGH", "MEDIUM"), b).otherwise("LOW")
