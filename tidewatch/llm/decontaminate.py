"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring words; words under its gaps are ignored, so a
replaced word does not hide a hit.  The two masks are chosen such that any aligned stretch
of 15 words with at most 3 replaced ones is hit (checked over all 455 cases in the tests),
hence every overlap of 15 words and more in which at least 0.8 of the words agree.  Items of
fewer than 15 words have masks over the whole item, by its length (``short_masks``).  Hits
give a document, an item and a shift; the overlap around them is verified word by word.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, small, text_key

#: Word positions that count.  The first mask alone finds exact runs of five words.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5))
#: Items with fewer words have masks of their own.
_LONG = 15
#: Seeds of the benchmark are broadcast up to this many rows of about 40 bytes.
SEED_ROWS = 500_000


#: Slots of the tables that say which hashes the benchmark has; more slots only save time.
_SLOTS = 1 << 16


# Hashes of the lower-cased runs of letters, marks and digits, with an empty word where the
# text begins or ends with another sign.
_WORDS = r"transform(split(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}]+', -1), w -> xxhash64(w))"


def words(text: Column) -> Column:
    """Hashes of the words of a text without empty ones; empty for NULL."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over a whole item of ``n`` words: whichever ``n // 5`` of them are replaced, one mask ignores all these."""
    return [tuple(k for k in range(n) if k % 5 not in gone) for gone in combinations(range(5), n // 5)]


def _whole(n: int, tokens: str, at: str) -> str:
    """SQL of the array of seeds of an item of ``n`` words that begins at ``at``."""
    seeds = (
        f"xxhash64({n}, {m}, {', '.join(f'{tokens}[{at} + {k}]' for k in mask)})" for m, mask in enumerate(short_masks(n))
    )
    return f"array({', '.join(seeds)})"


def _short_lengths(items: DataFrame) -> list[int]:
    """Which lengths below 15 words occur."""
    return sorted(r["n"] for r in items.select(F.size("item_words").alias("n")).where(F.col("n") < _LONG).distinct().collect())


def _short_item_seeds(items: DataFrame, lengths: list[int]) -> DataFrame:
    """``item_key, item_at, seed`` of the items of ``lengths``."""
    cases = " ".join(f"WHEN {n} THEN {_whole(n, 'item_words', '0')}" for n in lengths)
    seeds = F.expr(f"CASE size(item_words) {cases} END")
    short = items.where(F.size("item_words") < _LONG)
    return short.select("item_key", F.lit(0).alias("item_at"), F.explode(seeds).alias("seed"))


def _short_places(items: DataFrame, seeds: DataFrame, lengths: list[int]) -> str:
    """SQL of the places of ``t`` with those whole-item seeds that may be an item's."""
    # a mask begins at one of the first three words
    first = items.where(F.size("item_words") < _LONG).select(F.explode(F.slice("item_words", 1, 3)).alias("h"))
    begins = " OR ".join(_in_slot("b.first", f"get(t, i + {k})") for k in range(3))
    each = ", ".join(f"IF(i + {n} <= size(t), {_whole(n, 't', 'i')}, array())" for n in lengths)
    at = f"struct(i AS i, filter(flatten(array({each})), s -> {_in_slot('b.seeds', 's')}) AS seeds)"
    present = f"named_struct('first', {_present(first)}, 'seeds', {_present(seeds.select(F.col('seed').alias('h')))})"
    places = f"filter(sequence(0, size(t) - 1), i -> {begins})"
    return f"transform(array({present}), b -> filter(transform({places}, i -> {at}), p -> size(p.seeds) > 0))[0]"


def _seed(mask: tuple[int, ...], number: int, tokens: str) -> str:
    return f"xxhash64({number}, {', '.join(f'{tokens}[i + {k}]' for k in mask)})"


def _seeds(frame: DataFrame, tokens: str, *keep: str, where: str = "true", more: str = "") -> DataFrame:
    """``keep``, ``seed, at``: a row per mask and each place in the array ``t`` that passes ``where``, and those of ``more``.

    ``tokens`` is SQL for the array.  It is bound to ``t`` by a lambda, because a column could
    be replaced by its definition and then be evaluated for every element.
    """
    least = MASKS[0][-1] + 1
    per_place = ", ".join(
        f"IF(i + {mask[-1]} < size(t), {_seed(mask, m, 't')}, NULL)" if mask[-1] >= least else _seed(mask, m, "t")
        for m, mask in enumerate(MASKS)
    )
    places = f"filter(sequence(0, size(t) - {least}), i -> {where})"
    long = f"IF(size(t) < {least}, array(), transform({places}, i -> struct(i AS i, array({per_place}) AS seeds)))"
    found = f"transform(array({tokens}), t -> {f'concat({long}, {more})' if more else long})[0]"
    each = frame.select(*keep, F.explode(F.expr(found)).alias("at"))
    return each.select(*keep, F.col("at.i").alias("at"), F.explode("at.seeds").alias("seed")).where("seed IS NOT NULL")


def _present(values: DataFrame) -> str:
    """SQL of a bytes literal with a 1 in the slot of each hash ``h``; its length is fixed."""
    found = bytearray(_SLOTS)
    for row in values.select(F.pmod("h", F.lit(_SLOTS)).alias("slot")).distinct().collect():
        found[row["slot"]] = 1
    return f"X'{found.hex()}'"


def _in_slot(present: str, h: str) -> str:
    """SQL whether the slot of hash ``h`` is set in ``present``."""
    return f"substring({present}, CAST(pmod({h}, {_SLOTS}) AS INT) + 1, 1) = X'01'"


def _plausible(items: DataFrame) -> str:
    """Whether a seed of an item can begin at ``t[i]``: its first word, then its first three, occur there."""
    items = items.where(F.size("item_words") >= len(MASKS[0]))
    word = items.select(F.explode("item_words").alias("h"))
    run = "xxhash64({0}[i], {0}[i + 1], {0}[i + 2])"
    runs = f"transform(sequence(0, size(item_words) - {MASKS[0][-1] + 1}), i -> {run.format('item_words')})"
    three = items.select(F.explode(F.expr(runs)).alias("h"))
    return f"{_in_slot(_present(word), 't[i]')} AND {_in_slot(_present(three), run.format('t'))}"


# Slides a stretch of ``least`` words over an alignment.  ``best`` is the largest number of
# equal words in a stretch, ``covered`` the number of words in stretches that are good enough.
_NOW = "s.equal + hits[i] - IF(i < least, 0, hits[i - least])"
_GOOD = f"i >= least - 1 AND 5 * ({_NOW}) >= 4 * least"
_SLIDE = f"""
aggregate(sequence(0, size(hits) - 1),
  named_struct('equal', 0, 'best', 0, 'covered', 0, 'until', -1),
  (s, i) -> named_struct(
    'equal', {_NOW},
    'best', IF(i < least - 1, s.best, greatest(s.best, {_NOW})),
    'covered', s.covered + IF({_GOOD}, array_min(array(least, i - s.until)), 0),
    'until', IF({_GOOD}, i, s.until)))
"""
# The aligned parts of document and item, word by word.  Every array is bound to a name by a
# lambda.  Only good alignments are exploded, so no filter can be moved below the join.
_VERIFY = f"""
filter(transform(transform(array({_WORDS}), d -> struct(
    slice(d, greatest(shift, 0) + 1, greatest(size(item_words) + least(shift, 0), 0)) AS there,
    slice(item_words, greatest(-shift, 0) + 1, greatest(size(d) - greatest(shift, 0), 0)) AS ours)),
  p -> transform(array(zip_with(p.there, slice(p.ours, 1, size(p.there)), (x, y) -> IF(x = y, 1, 0))),
    hits -> IF(size(hits) < least, NULL, {_SLIDE}))[0]),
  found -> found.covered > 0)
"""


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_words: int = 15,
) -> DataFrame:
    """``id, key, item, shift, overlap_words, best_equal`` of every verified overlap.

    An overlap is a stretch of ``min_words`` aligned words (the whole item, if that is shorter)
    of which at least 0.8 are equal.  ``shift`` is where the item would begin in the document,
    ``overlap_words`` the number of its words in such stretches, ``best_equal`` the most equal
    words in one of them.  With fewer than 15 ``min_words`` some of them may have no hit.
    Items of one to four words have to agree in all of them and are reported at their first
    place in a document.  A run of letters without blanks is one word.  NULL texts and texts
    without words overlap with nothing.  Rows equal in id and text, and items equal in id and
    text, count once.
    """
    items = materialize(
        benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("item_words"))
        .where(F.size("item_words") > 0)
        .distinct()
        .withColumn("item_key", F.xxhash64("item", "item_words")),
        "items",
    )
    seeds = _seeds(items, "item_words", "item_key").withColumnRenamed("at", "item_at")
    lengths, more = _short_lengths(items), ""
    if lengths:
        short = materialize(_short_item_seeds(items, lengths), "short-seeds")
        seeds, more = seeds.unionByName(short), _short_places(items, short, lengths)
    once = items.select("item_key", (F.size("item_words") < len(MASKS[0])).alias("once"))
    seeds = materialize(seeds.join(small(once), "item_key"), "item-seeds")
    named = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    hits = materialize(
        _seeds(named, _WORDS, "id", "key", where=_plausible(items), more=more)
        .join(small(seeds, SEED_ROWS), "seed")
        .withColumn("shift", F.col("at") - F.col("item_at"))
        .groupBy("id", "key", "item_key", F.when(~F.col("once"), F.col("shift")).alias("place"))
        .agg(F.min("shift").alias("shift"))
        .drop("place"),
        "hits",
    )
    here = hits.join(small(items), "item_key").select(
        F.col("id").alias("_id"), F.col("key").alias("_key"), "item", "item_words", "shift"
    )
    here = small(materialize(here, "hit-items"))
    return (
        named.join(here, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
        .withColumn("least", F.least(F.lit(min_words), F.size("item_words")))
        .select("id", "key", "item", "shift", F.explode(F.expr(_VERIFY)).alias("found"))
        .select("id", "key", "item", "shift", F.col("found.covered").alias("overlap_words"), F.col("found.best").alias("best_equal"))
        .distinct()
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """``id, item, overlap_words, best_equal``: the longest overlap of each document and item."""
    found = overlaps(docs, benchmark, **names)
    return (
        found.groupBy("id", "item")
        .agg(F.max(F.struct("overlap_words", "best_equal")).alias("m"))
        .select("id", "item", "m.overlap_words", "m.best_equal")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows and columns of ``docs`` that overlap with no item."""
    found = overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **names)
    bad = small(
        materialize(found.select(F.col("id").alias("_bad_id"), F.col("key").alias("_bad_key")).distinct(), "contaminated")
    )
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return row.join(
        bad,
        F.col("_row")[id_col].eqNullSafe(F.col("_bad_id")) & (text_key(F.col("_row")[text_col]) == F.col("_bad_key")),
        "left_anti",
    ).select("_row.*")
