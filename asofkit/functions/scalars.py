"""Column functions: buckets, scores, identifiers, availability rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stage names from the lowest to the highest score (fixed values).
STAGES = ("FLEE", "SCATTER", "CALM", "DRIFT", "RUSH")
#: Upper bounds of the first four stages (fixed values).
STAGE_BOUNDS = (15.0, 40.0, 60.0, 75.0)


def stage(score: Column, convention: str = "half_open") -> Column:
    """Bucket of a 0-100 score. half_open: bounds belong to the stage above; legacy: the two lower bounds belong below."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for i, (name, bound) in enumerate(zip(STAGES, STAGE_BOUNDS)):
        out = out.when(score <= bound if convention == "legacy" and i < 2 else score < bound, name)
    return out.otherwise(STAGES[-1])


def finite(x: Column) -> Column:
    """x with NaN and infinities as null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def composite_score(parts: dict[str, float], eps: Column | None = None, sector: Column | None = None) -> dict[str, Column]:
    """Weighted sum of indicator columns, half-even to 2 dp and clamped to 0..100 as base; times multipliers as adjusted."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    total = sum((F.col(c) * w for c, w in parts.items()), F.lit(0.0))
    base = F.bround(clamp(total), 2)
    return {"base": base, "adjusted": F.bround(clamp(base * (F.lit(1.0) if eps is None else eps) * (F.lit(1.0) if sector is None else sector)), 2)}


def ladder(x: Column, steps: list[tuple[float, float]], top: float) -> Column:
    """The value of the first step whose bound x lies below, else top; null stays null."""
    out = F.when(x.isNull(), F.lit(None).cast("double"))
    for bound, value in steps:
        out = out.when(x < bound, F.lit(value))
    return out.otherwise(F.lit(top))


def bucketize(x: Column, bounds: list[float], names: list[str]) -> Column:
    """Name of the half-open bucket; null stays null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for bound, name in zip(bounds, names):
        out = out.when(x < bound, name)
    return out.otherwise(names[-1])


def canonical_symbol(c: Column) -> Column:
    """Upper case, separators of share classes as one dash, other marks dropped; empty is null."""
    s = F.regexp_replace(F.upper(F.trim(c)), r"[./ _#-]+", "-")
    return F.nullif(F.regexp_replace(F.regexp_replace(s, r"[^A-Z0-9-]", ""), r"^-+|-+$", ""), F.lit(""))


def reported_symbols(c: Column) -> Column:
    """Distinct clean symbols of a cell that lists several."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, r"[,;|]"), canonical_symbol), lambda x: x.isNotNull())))


def _folds() -> dict[str, str]:
    """ASCII letters and digits that characters of the Latin and compatibility blocks decompose to."""
    import unicodedata

    folded = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F))}
    return {c: a for c, a in folded.items() if a}


def fold_ascii(c: Column) -> Column:
    """Compatibility decomposition to ASCII: accents and other characters beyond ASCII go."""
    folds = _folds()
    one = {k: v for k, v in folds.items() if len(v) == 1}
    for k, v in folds.items():
        if len(v) > 1 and v.isalnum():
            c = F.replace(c, F.lit(k), F.lit(v))
    return F.regexp_replace(F.translate(c, "".join(one), "".join(one.values())), r"[^\x00-\x7F]", "")


def normalize_name(c: Column, expand: dict[str, str], drop: tuple[str, ...]) -> Column:
    """Upper-case alphanumeric tokens of the name folded to ASCII, short forms expanded, stop tokens dropped, the pair
    J B joined, joined by spaces."""
    table = F.create_map(*(F.lit(x) for pair in expand.items() for x in pair)) if expand else None
    tokens = F.regexp_extract_all(F.upper(fold_ascii(c)), F.lit("[A-Z0-9]+"), 0)
    if table is not None:
        tokens = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))
    kept = F.array_join(F.filter(tokens, lambda t: ~t.isin(*drop) if drop else F.lit(True)), " ")
    return F.regexp_replace(kept, r"\bJ B\b", "JB")


def token_signature(c: Column, drop: tuple[str, ...] = ()) -> Column:
    """The tokens of a normalised name in order of the alphabet, without those that tell nothing apart."""
    return F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda t: ~t.isin(*drop) if drop else F.lit(True))), " ")


def valid_cusip(c: Column) -> Column:
    """Whether a nine-character security number carries its check digit: characters count 0-35, *@# 36-38, every second
    doubled, digits of the values summed. Surrounding spaces and case do not matter; nine equal characters are none."""
    alphabet, c = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#"), F.upper(F.trim(c))

    def part(i: Column) -> Column:
        v = F.position(F.substring(c, i, F.lit(1)), alphabet) - 1
        v = F.when(i % 2 == 0, v * 2).otherwise(v)
        return F.floor(v / 10) + v % 10

    total = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0).cast("long"), lambda s, i: s + part(i).cast("long"))
    shaped = F.regexp_like(c, F.lit("^[0-9A-Z*@#]{8}[0-9]$")) & ~F.regexp_like(c, F.lit(r"^(.)\1{8}$"))
    return F.coalesce(shaped & ((10 - total % 10) % 10 == F.try_to_number(F.substring(c, 9, 1), F.lit("9"))), F.lit(False))


def stable_id(*cols: Column, n: int = 24) -> Column:
    """A row id that depends on the columns' values alone; nulls are marked."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("~")) for c in cols)), 256), 1, n)


def next_midnight_utc(d: Column, zone: str = "America/New_York") -> Column:
    """The instant (UTC) of the midnight after a day of a market zone."""
    return F.to_utc_timestamp(F.date_add(d, 1).cast("timestamp"), zone)


def statutory_wave(period_end: Column, days: int = 45) -> Column:
    """The day by which filings of a period are due."""
    return F.date_add(period_end, days)
