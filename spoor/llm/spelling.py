"""Spelling variants: words one edit apart, found by permuterm rotations, and the form each is taken for.

Every word gets a terminator and is written in all its rotations. The rotation that begins behind
a letter ends in that letter: without it, it is the word with that letter skipped, and all words
that differ in that letter alone have it as a prefix. A word that lacks the letter altogether has the
prefix as a whole rotation. So rotations, filed under their prefix and sorted, lie next to all
their neighbours, and one scan tells each how many there are and which is the most frequent
other one. A prefix has one word for each letter at most, so no group is large, and pairs are never
written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import store

TERMINATOR = "$"
RATIO = 5
LEAST_LETTERS, LEAST_COUNT = 6, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Runs of letters of Latin-1, as the contract has them.
LETTERS = r"([A-Za-zÀ-ÿ]++)"


def letter_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (doc_id, run) for every maximal run of letters, A-Z lower-cased; null texts have none."""
    runs = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(LETTERS), F.lit(1)))
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), runs.alias("run"))
    return found.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def misspelt(doc_id: Column, run: Column, one_in: int = 199) -> Column:
    """The run with one letter lost in about one of ``one_in`` documents and runs, by checksum."""
    given = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    h = F.crc32(given.cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(one_in)) == 0, cut).otherwise(run)


def count_words(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, of those with enough letters (code points) and occurrences; null words are none."""
    long_enough = words.filter(F.length("word") >= least_letters)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _filed(words: DataFrame) -> DataFrame:
    """Rotations under their prefixes.

    ``whole`` rotations are prefixes themselves: their word lacks the skipped letter. Of equal letters in
    a row only the first counts as the one that is ``lacked``, as without any of them the word is the same.
    """
    marked = F.concat("word", F.lit(TERMINATOR))
    letters = F.length("word")
    rest = lambda i: F.substring(marked, i + 1, letters + 1)
    head = lambda i: F.substring(marked, F.lit(1), i)
    letter = lambda i: F.substring("word", i + 1, F.lit(1))
    skipped = F.transform(
        F.sequence(F.lit(0), letters - 1),
        lambda i: F.struct(
            F.concat(rest(i + 1), head(i)).alias("prefix"),
            F.lit(False).alias("whole"),
            ((i == 0) | (letter(i) != letter(i - 1))).alias("lacked"),
        ),
    )
    whole = F.transform(
        F.sequence(F.lit(0), letters),
        lambda i: F.struct(F.concat(rest(i), head(i)).alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("lacked")),
    )
    # Most frequent first, and of equally frequent ones the first in code-point order.
    ranked = F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("word"))
    return words.select(ranked.alias("me"), F.inline(F.concat(skipped, whole)))


def _scanned(filed: DataFrame) -> DataFrame:
    """For each rotation the number of its word's neighbours under the prefix, and the best of them."""
    group = Window.partitionBy("prefix")
    along = group.orderBy("whole", "me")
    replaced = ~F.col("whole")
    others = F.count(F.when(replaced, 1)).over(group) - 1
    best = F.min(F.when(replaced, F.col("me"))).over(group)
    longer = F.count(F.when(F.col("lacked"), 1)).over(group)
    best_longer = F.min(F.when(F.col("lacked"), F.col("me"))).over(group)
    shorter = F.min(F.when(F.col("whole"), F.col("me"))).over(group)
    # Of words with a letter in this place the next best stands next in order.
    next_ = F.when(F.lead("whole").over(along) == F.lit(False), F.lead("me").over(along))
    seen = filed.select(
        "me",
        "whole",
        "lacked",
        others.alias("others"),
        longer.alias("longer"),
        best_longer.alias("best_longer"),
        shorter.alias("shorter"),
        F.when(F.col("me") == best, next_).otherwise(best).alias("best"),
    )
    lacks_one = F.col("lacked") & F.col("shorter").isNotNull()
    return seen.select(
        "me",
        F.when(F.col("whole"), F.col("longer")).otherwise(F.col("others") + lacks_one.cast("long")).alias("near"),
        F.when(F.col("whole"), F.col("best_longer"))
        .otherwise(F.least(F.col("best"), F.when(F.col("lacked"), F.col("shorter"))))
        .alias("best"),
    )


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row (word, n) of distinct words.

    Two words are near if they differ by one inserted, deleted or replaced code point. ``form`` is
    the near word of largest n (of several the first in code-point order) if that n is ``ratio``
    times the word's or more, else null; ``root`` follows forms to the last and is the word itself
    if it has none. Ratios above 1 make that chain short: it grows by the logarithm of the largest n.
    Words must not be null or hold the terminator; an empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent, or chains of forms need not end")
    judged = (
        _scanned(_filed(words))
        .groupBy("me")
        .agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
        .select(F.col("me.word").alias("word"), (-F.col("me.minus_n")).alias("n"), "n_near", "best")
    )
    taken = -F.col("best.minus_n") >= ratio * F.col("n")
    judged = store(
        judged.select(
            "word", "n", "n_near", F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.minus_n")).alias("form_n")
        ),
        "variants",
    )
    roots = _follow(judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    joined = judged.join(roots, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _follow(steps: DataFrame) -> DataFrame:
    """Each word with the last word of its chain; every round doubles the steps taken at once."""
    steps = store(steps, "steps")
    while True:
        onward = steps.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = steps.join(onward, F.col("root") == F.col("_word"), "left")
        moved = store(joined.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("on")), "steps")
        steps = moved.drop("on")
        if moved.filter("on").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """``variants`` of the words of all documents as the contract makes them.

    Null texts have no words, a null id counts as an empty one, repeated rows count as often as they
    occur. Words come from whole texts, however long; further columns are not read.
    """
    runs = letter_runs(docs, doc_id, text)
    words = runs.select(misspelt(F.col("doc_id"), F.col("run")).alias("word"))
    return variants(store(count_words(words), "words"), ratio)
