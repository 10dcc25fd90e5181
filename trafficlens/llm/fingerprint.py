"""Document fingerprints: the k smallest hashes of a text's distinct 5-word shingles.

DataFrame functions only. Sketches are sorted arrays of 48-bit hashes; the k smallest of the union of two sketches are the sketch of
the union of their sets, so sketches of parts merge to that of the whole. From two sketches follow the resemblance, the containment
and the number of distinct shingles; sets of at most k shingles are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5
BITS = 48
#: Rows of one stretch of neighbouring documents, about.
STRETCH_ROWS = 1500


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_sketch(text: Column, k: int = K) -> Column:
    """Sketch of a text, letters lower-cased; of fewer than 5 words the whole sequence is one shingle; no words: an empty sketch."""
    words = F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")

    def hashed(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(places, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, WORDS)), 64 - BITS)))

    return F.slice(F.sort_array(F.array_distinct(let(words, hashed))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts' shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of intersection / union. Two empty sets resemble each other fully."""
    both = let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of a set's size; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**BITS) / a[k - 1])


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's set that b's holds (0 to 1)."""
    inside = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inside))


def to_text(sketch: Column) -> Column:
    """A sketch as a string: base64 of its hashes, 6 bytes each; empty for an empty one."""
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), ""))), r"\s", "")


def from_text(fingerprint: Column) -> Column:
    """The sketch that a string holds."""
    digits = F.hex(F.unbase64(fingerprint))
    n = (F.length(digits) / (BITS // 4)).cast("int")
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(digits.substr((i - 1) * (BITS // 4) + 1, F.lit(BITS // 4)), 16, 10).cast("long"))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(parts)


def constant_array(values: list, kind: str) -> Column:
    """An array that the optimizer folds into one constant, made from one string in place of a literal for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def place_among(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most value, by halving; a null value counts none. The cuts are one constant of the plan."""
    array = constant_array(cuts, "bigint")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= value, at + step).otherwise(at))


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, distinct_shingles, kept_in_edited).

    The edited text has its last floor(n_chars/4) code points replaced by as many first ones of the next document by doc_id (after
    the last: the first). Null texts are empty. Of rows with one doc_id the one with the smaller text comes first. A table of one
    row is its own next. Other columns are ignored; an empty table gives no rows.

    Documents are dealt into stretches of neighbouring ids, each with the next stretch's first document as its last row, so that
    texts move once and no window spans the table.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = base.count()
    stretches = rows // STRETCH_ROWS + 1
    cuts: list[int] = []
    if stretches > 1:
        at = constant_array([i / stretches for i in range(1, stretches)], "double")
        cuts = sorted(set(base.agg(F.percentile_approx("doc_id", at, min(100 * stretches, 2**31 - 1))).first()[0] or []))
    base = base.withColumn("stretch", place_among(F.col("doc_id"), cuts) if cuts else F.lit(0))
    firsts = sorted((r[0], r[1]) for r in base.groupBy("stretch").agg(F.min("doc_id")).collect())
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    guest_of = docs.sparkSession.createDataFrame(before, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, stretch int")
    guests = base.drop("stretch").join(F.broadcast(guest_of), "doc_id")
    both = base.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))

    in_order = Window.partitionBy("stretch").orderBy("guest", "doc_id", "text")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n_chars - cut)"), F.expr("substring(next, 1, cut)"))
    paired = both.withColumn("next", F.lead("text").over(in_order)).select("stretch", "guest", "doc_id", "text", n.alias("n_chars"), cut.alias("cut"), "next")
    paired = paired.select("stretch", "guest", "doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), F.when(~F.col("guest"), edited).alias("edited"))
    sketched = paired.select("stretch", "guest", "doc_id", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shingle_sketch(F.col("text"), k).alias("a"), F.when(~F.col("guest"), shingle_sketch(F.col("edited"), k)).alias("e"))
    sketched = sketched.withColumn("b", F.lead("a").over(in_order)).where("not guest")
    a, e, b = F.col("a"), F.col("e"), F.col("b")
    return sketched.select("doc_id", "n_chars", "edited_sha256", to_text(a).alias("fingerprint"), to_text(e).alias("edited_fingerprint"), resemblance(a, e, k).alias("near_edited"), resemblance(a, b, k).alias("near_next"), distinct_shingles(a, k).alias("distinct_shingles"), containment(a, e, k).alias("kept_in_edited"))
