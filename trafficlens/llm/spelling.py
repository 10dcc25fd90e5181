"""Spelling variants: words that differ by one inserted, deleted or replaced character, by permuterm rotations.

A word w of length L is marked with a terminator, w$, and turned: the rotation from place i is w[i:] $ w[:i].

* Take the rotation in which character i comes last and leave that character out: w[i+1:] $ w[:i]. Words that differ from w only at
  place i begin with the same L characters there. So replacements of a character are the words in one range of this prefix.
* The same string is a whole rotation of the word that w becomes without character i. So deletions and insertions meet there too.

Every word gives its L shortened rotations and its L + 1 whole ones. All rotations are brought together and sorted by their text; one
scan of each range counts the neighbours of each of its members and finds the most frequent one. A range holds at most one whole
rotation and one word for each character of the alphabet (90 here), however large the table is, and no pair of words is written out:
a member's neighbours are the range without itself. Where a word repeats a character (aab), leaving out either of the two gives the
same shorter word; only the first of such a run counts for deletions, so each neighbour is counted once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release_worker, spool

#: One in so many occurrences of a run loses a character.
EDIT_EVERY = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent as its variant.
FORM_TIMES = 5
#: Different words that a task counts before it hands its counts on.
HELD_WORDS = 300_000

TERMINATOR = "$"  # no letter


def _letters() -> bytes:
    """Of each Latin-1 character: its lower-case form for A-Z, itself for other letters a-z and from U+00C0, else a blank."""
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0
    return bytes((c + 32 if c <= 90 else c) if letter(c) else 32 for c in range(256))


_LETTERS = _letters()


def count_words(docs: DataFrame, edit_every: int = EDIT_EVERY, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): occurrences of every word of at least so many characters in all whole texts.

    A run is a maximal one of [A-Za-z\\u00C0-\\u00FF], with A-Z lower-cased. Where edit_every divides the crc32 of
    `<doc_id>:<run>`, that run loses its character at crc32 modulo its length. A null id counts as an empty one, a null text as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        total: Counter = Counter()
        for b in batches:
            ids = b.column(0).cast(pa.string()).to_numpy(zero_copy_only=False)
            for i, t in zip(ids, b.column(1).to_numpy(zero_copy_only=False), strict=True):
                if not t:
                    continue
                begun = zlib.crc32(f"{i or ''}:".encode())
                for w, n in Counter(t.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begun)
                    if not h % edit_every:
                        h %= len(w)
                        w = w[:h] + w[h + 1 :]
                    if len(w) >= least_length:
                        total[w] += n
                if len(total) > HELD_WORDS:
                    yield counted(total)
                    total.clear()
        yield counted(total)

    def counted(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    per_task = bounded_batches(docs).select("doc_id", "text").mapInArrow(run, "word string, n long")
    return per_task.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(key, kind, word, n): kind 0 is a whole rotation, 1 one without its last character, 2 one whose last character repeats the one before it in the word."""
    w, size = F.col("word"), F.length("word")
    tail = lambda i: F.substr(w, i, size)  # noqa: E731  from place i on
    head = lambda n: F.substr(w, F.lit(1), n)
    end = F.lit(TERMINATOR)
    whole = F.transform(F.sequence(F.lit(1), size + 1), lambda i: F.struct(F.concat(tail(i), end, head(i - 1)).alias("key"), F.lit(0).alias("kind")))
    again = lambda i: (i > 1) & (F.substr(w, i, F.lit(1)) == F.substr(w, i - 1, F.lit(1)))
    short = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.concat(tail(i + 1), end, head(i - 1)).alias("key"), F.when(again(i), 2).otherwise(1).alias("kind")))
    return words.where(size > 0).select("word", "n", F.explode(F.concat(whole, short)).alias("r")).select("r.key", "r.kind", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words of the table are near each word that has any, and the most frequent one (word, n); ties to the smallest word."""
    order = Window.partitionBy("key").orderBy(F.col("kind") == 0, F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word"))
    scanned = rotations(words).select(
        "word",
        "kind",
        F.count_if(F.col("kind") > 0).over(order).alias("shorts"),
        F.count_if(F.col("kind") == 1).over(order).alias("firsts"),
        F.max(F.when(F.col("kind") == 0, me)).over(order).alias("whole"),
        F.first(me).over(order).alias("one"),
        F.nth_value(me, 2).over(order).alias("two"),
    )
    short = F.col("kind") > 0
    near = F.when(short, F.col("shorts") - 1 + F.when((F.col("kind") == 1) & F.col("whole").isNotNull(), 1).otherwise(0)).otherwise(F.col("firsts"))
    # the second of a range may be its whole rotation, which is a neighbour of all the others
    other = F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one"))
    found = scanned.select("word", near.alias("near"), F.when(short, F.least(other, F.coalesce("whole", other))).otherwise(F.when(F.col("firsts") > 0, F.col("one"))).alias("best"))
    return found.where("near > 0").groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def follow_forms(forms: DataFrame, most: int, times: int = FORM_TIMES, least: int = LEAST_COUNT) -> DataFrame:
    """(word, root): the last form from each word on. forms: (word, form).

    A form is `times` as frequent as its word, so a way has at most log(most / least) steps to that base; each round doubles what a
    row has gone.
    """
    steps = max(1, math.floor(math.log(max(most, least) / least, times) + 1e-9))
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        on = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = out.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return out


def spelling_groups(docs: DataFrame, least_count: int = LEAST_COUNT, times: int = FORM_TIMES, edit_every: int = EDIT_EVERY, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word that occurs least_count times.

    form: the near word of largest n (ties: the smallest in code-point order) if it is `times` as frequent as the word. root: the
    last form from here on, the word itself if it has none. n_near counts near words. Repeated rows count again. Other columns are
    ignored. An empty table, or one without words, gives no rows.
    """
    words = spool(count_words(docs, edit_every, least_length).where(F.col("n") >= least_count), "words")
    near = neighbours(words)
    formed = F.when(-F.col("best.minus") >= times * F.col("n"), F.col("best"))
    judged = spool(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), formed["word"].alias("form"), (-formed["minus"]).alias("form_n")), "forms")
    most = judged.agg(F.max("n")).first()[0] or least_count
    roots = follow_forms(judged.where("form is not null"), most, times, least_count)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
