"""Column functions over numbers: bands, scores, display formats."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds and names of response-size bands; agent-token counts with a band of their own; time-to-live table
#: (seconds for words, referers, addresses by purge intensity 0 to 11).
SIZE_BANDS = [(100, "<100B"), (300, "100–300B"), (700, "300–700B"), (1024, "700B–1K"), (10240, "1–10K"), (102400, "10–100K"), (512000, "100–500K"), (1048576, "500K–1M")]
LARGEST_BAND = ">1M"
TOKEN_BANDS = [16, 22, 18, 17, 24, 21, 25]
RETENTION = [(300, 300, 300), (240, 300, 300), (180, 240, 300), (120, 180, 240), (90, 120, 180), (60, 90, 120), (30, 60, 90), (20, 30, 60), (10, 20, 30), (5, 10, 20), (1, 5, 10), (1, 1, 1)]


def size_band(size: Column) -> Column:
    out = F.lit(LARGEST_BAND)
    for bound, name in reversed(SIZE_BANDS):
        out = F.when(size < bound, name).otherwise(out)
    return out


def size_band_order(band: Column) -> Column:
    out = F.lit(len(SIZE_BANDS))
    for i, (_, name) in enumerate(SIZE_BANDS):
        out = F.when(band == name, i).otherwise(out)
    return out


def token_band(count: Column) -> Column:
    return F.when(count.isin(*TOKEN_BANDS), F.concat(F.lit("b"), count.cast("string"))).otherwise("other")


def soft_score(value: Column, half: float) -> Column:
    """100 v^2 / (v^2 + half^2); 0 for values that are not above 0.

    Multiplied from left to right and with the exact decimal square of half, as the SQL does: equal components then tie alike.
    """
    square = float(Decimal(str(half)) ** 2)
    return F.when((value > 0) & ~F.isnan(value), 100 * value * value / (value * value + square)).otherwise(F.lit(0.0))


def relative_change(a: Column, b: Column, floor: float, half: float) -> Column:
    return soft_score(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(float(floor))), half)


def point_change(a: Column, b: Column, half: float) -> Column:
    return soft_score(F.abs(a - b), half)


def format_count(n: Column) -> Column:
    """At most four characters: plain to 9999, thousands to 999K, then millions with one digit to 9.9M; beyond that dashes."""
    millions = F.round(n / 1e6, 1)
    return F.when(n <= 9999, F.format_string("%4d", n)).when(n <= 999999, F.format_string("%3dK", F.floor(n / 1000))).when(n < 10000000, F.format_string("%4.1fM", millions)).otherwise("----")


def format_large_count(n: Column) -> Column:
    """Counts of any size: whole thousands, then millions, billions and trillions, with one digit below ten of a unit."""
    out = F.format_string("%d", n)
    for unit, name in ((10**6, "M"), (10**9, "B"), (10**12, "T")):
        whole = F.format_string("%d" + name + ("+" if name == "T" else ""), F.floor(n / unit).cast("long"))
        out = F.when(n >= 10 * unit, whole).when(n >= unit, F.format_string("%.1f" + name, n / float(unit))).otherwise(out if unit > 10**6 else F.when(n >= 1000, F.format_string("%dK", F.floor(n / 1000).cast("long"))).otherwise(out))
    return out


def format_bytes(n: Column) -> Column:
    """Whole units of powers of 1024."""
    out = F.format_string("%2dB", n)
    for k, unit in enumerate("KMGTPE", 1):
        out = F.when(n >= 1024**k, F.format_string(f"%2.0f{unit}", n / float(1024**k))).otherwise(out)
    return out
