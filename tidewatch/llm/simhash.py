"""Near-duplicate documents by SimHash and deletion-variant signatures.

A fingerprint is cut into two 32-bit segments.  Two fingerprints that differ in at
most three bits differ in at most one bit of one segment, so both have the variant
of that segment in which this bit is a wildcard.  Each fingerprint is indexed under
its 2 x 32 variants, an equality join on the variants finds every candidate, and the
whole distance is verified inside the join.  Equal fingerprints are collapsed first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidewatch.llm.common import materialize
from tidewatch.llm.components import components

#: Shingle hashes whose bits are counted at a time; bounds memory for very long texts.
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one whole text; zero if it has no word."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*[tokens[k:] for k in range(words)], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        octets = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id, fp`` per row; ``fp`` is the fingerprint as a signed bigint.

    NULL and empty texts have fingerprint zero.  Lower-casing covers A-Z only; words are
    separated by ASCII white space; repeated shingles count each time.
    """

    @arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), words) for t in texts), dtype=np.uint64, count=len(texts))
        return pa.array(found.view(np.int64))

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).select("id", of("t").alias("fp"))


def _variants(prints: DataFrame) -> DataFrame:
    """``key, fp`` for both segments and each wildcard bit; the key names segment and bit."""
    keyed = prints.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(63))))
    segment = F.expr("CASE WHEN at < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END")
    masked = segment.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, at % 32)")))
    return keyed.select((F.expr("shiftleft(CAST(at AS BIGINT), 32)") + masked).alias("key"), "fp")


#: The pair meets here and in no other bucket: the first bit of equal segments, or the
#: differing bit; the upper segment only answers if the lower one differs in over one bit.
_FIRST_MEETING = """
  CASE WHEN a.key < 137438953472L
    THEN (a.fp ^ b.fp) & 4294967295L IN (0L, shiftleft(1L, CAST(shiftright(a.key, 32) AS INT)))
      AND ((a.fp ^ b.fp) & 4294967295L != 0L OR a.key < 4294967296L)
    ELSE bit_count((a.fp ^ b.fp) & 4294967295L) > 1
      AND shiftrightunsigned(a.fp ^ b.fp, 32) IN (0L, shiftleft(1L, CAST(shiftright(a.key, 32) - 32 AS INT)))
      AND (shiftrightunsigned(a.fp ^ b.fp, 32) != 0L OR a.key < 141733920768L) END
"""


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Edges ``u, v`` that connect all fingerprints at most ``bits`` (0 to 3) bits apart.

    The edges have the same components as the full link graph.  Buckets of one member
    are dropped.  Members near their bucket's least fingerprint are tied to it; after
    that only pairs of different components are compared, so a dense group of near
    copies yields a star and not all of its pairs.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two segments cover at most 3 differing bits")
    # one exchange serves the counts and the join; a bucket has at most one variant in 64
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = _variants(prints).repartition(parts, "key")
    shared = variants.groupBy("key").agg(F.min("fp").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = materialize(variants.join(shared.hint("merge"), "key").select("key", "fp", "pivot"), "variants")
    star = materialize(
        members.where(f"fp != pivot AND bit_count(fp ^ pivot) <= {bits}")
        .select(F.col("fp").alias("u"), F.col("pivot").alias("v"))
        .distinct(),
        "star",
    )
    known = materialize(components(star), "star-roots")
    placed = members.join(known, F.col("fp") == F.col("node"), "left").select(
        "key", "fp", F.coalesce("root", "fp").alias("root")
    )
    mixed = materialize(
        placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high"), "mixed"
    )
    open_ = materialize(placed.join(mixed.select("key"), "key"), "open-buckets")
    rest = (
        open_.alias("a")
        .join(
            open_.alias("b"),
            F.expr(f"a.key = b.key AND a.fp < b.fp AND a.root != b.root AND bit_count(a.fp ^ b.fp) <= {bits} AND ({_FIRST_MEETING})"),
        )
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )
    return star.unionByName(rest)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3
) -> DataFrame:
    """``id, fp, component_id`` per row of ``docs``.

    ``component_id`` is the least id whose fingerprint is reachable by links of at most
    ``bits`` differing bits, the row's own included; NULL only if all ids of the component
    are NULL.  Documents without words share fingerprint zero and link like any other.
    Repeated rows are repeated in the result.  An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    roots = materialize(components(links(classes.select("fp"), bits)), "roots")
    rooted = materialize(
        classes.join(roots, F.col("fp") == F.col("node"), "left").select(
            "fp", "first_id", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    least = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    answer = materialize(rooted.join(least, "root").select("fp", "component_id"), "answer")
    return prints.join(answer, "fp").select("id", "fp", "component_id")


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] = near_duplicates
) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: that of the least id.

    ``groups(docs, id_col, text_col)`` says which rows belong together, by ``component_id``.
    Columns are those of ``docs``.  Where rows share the least id, the text with the least
    hash stays, and one of equal rows.  NULL counts as the least id.
    """
    keys = materialize(
        groups(
            docs.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("k")).alias("i"), F.col(text_col).alias("t")),
            "i",
            "t",
        ),
        "groups",
    )
    stay = keys.groupBy("component_id").agg(F.lit(1).alias("one")).select(
        F.col("component_id.i").alias("_stay_id"), F.col("component_id.k").alias("_stay_key")
    )
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    named = named.select(
        "_row", F.col("_row")[id_col].alias("_row_id"), F.xxhash64(F.col("_row")[text_col]).alias("_row_key")
    )
    met = named.join(
        stay, F.col("_row_id").eqNullSafe(F.col("_stay_id")) & (F.col("_row_key") == F.col("_stay_key")), "left_semi"
    )
    return met.dropDuplicates(["_row_id", "_row_key"]).select("_row.*")
