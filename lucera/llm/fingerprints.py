"""Operator 3: one-permutation MinHash fingerprints, in DataFrame functions alone.

A text's 5-word shingles are hashed once; the high bits of a hash name its bin and a bin keeps
its least hash. Optimal densification: an empty bin looks in a random sequence of its own for a
full one; after 8 looks it takes the full bin that a hash of (bin, full bin) ranks first, so
every bin draws uniformly and independently from the full ones, and always ends. Each bin keeps its low BITS bits; a fingerprint is their
hex string. Likeness corrects the share of equal bins for chance agreement.

Defined results: null text is empty; a text of 1 to 4 words has one shingle of all its words;
a text without words has an empty fingerprint, like another such text 1 and any other 0.
The next document is the next by (doc_id, hash of text); null doc_id comes first; the last is
followed by the first, so a table of one row follows itself; rows of equal doc_id and text follow
each other; rows of one doc_id (null too) are one group, sorted on disk if need be. Empty tables
give empty results; extra columns are left out.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucera.llm.common import table, words_of

SHINGLE = 5
BIN_BITS, BITS = 8, 4
BINS = 1 << BIN_BITS
LONGS = BINS * BITS // 64
#: Rows of one group of neighbours, and most groups (a group spills when larger; their bounds are one constant of 8 bytes each).
GROUP_ROWS, MAX_GROUPS = 1000, 1 << 16

#: Bins an empty bin looks in, one after another; beyond them it ranks all full bins.
_r = random.Random(3)
_PROBES = [[_r.randrange(BINS) for _ in range(BINS)] for _ in range(8)]


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    df = df.withColumn("_w", words_of(F.col(text)))
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x))).withColumn("_n", F.size("_w")).drop("_w")
    h, n = F.col("_h"), F.col("_n")
    grams = F.transform(
        F.slice(h, 1, F.greatest(n - (SHINGLE - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, SHINGLE)]),
    )
    grams = F.when(n >= SHINGLE, grams).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_g", F.sort_array(grams)).drop("_h", "_n")
    g = F.col("_g")
    least = F.filter(g, lambda x, i: (i == 0) | (F.shiftright(x, 64 - BIN_BITS) != F.shiftright(F.get(g, i - 1), 64 - BIN_BITS)))
    df = df.withColumn("_m", least).drop("_g")
    # least hashes by bin number, null where empty
    m = F.col("_m")
    gaps = F.transform(m, lambda x, i: F.concat(F.array(x), F.array_repeat(F.lit(None).cast("long"), F.coalesce(_bin(F.get(m, i + 1)), F.lit(BINS)) - _bin(x) - 1)))
    bins = F.concat(F.array_repeat(F.lit(None).cast("long"), _bin(F.get(m, F.lit(0)))), F.flatten(gaps))
    df = df.withColumn("_b", F.when(F.size(m) > 0, bins))
    b = F.col("_b")

    def filled(v: Column, j: Column) -> Column:
        ranked = F.transform(m, lambda x: F.struct(F.xxhash64(j, _bin(x)).alias("r"), x.alias("v")))
        return F.coalesce(v, *[F.get(b, F.get(_literal(p), j)) for p in _PROBES], F.array_min(ranked)["v"])

    full = F.when(F.size(m) == BINS, m).otherwise(F.transform(b, filled))
    hexed = F.array_join(F.transform(full, lambda v: F.get(_literal("0123456789abcdef"), F.shiftright(v, 20).bitwiseAND((1 << BITS) - 1).cast("int"))), "")
    return df.withColumn(out, F.coalesce(hexed, F.lit(""))).drop("_b", "_m")


def _bin(x: Column) -> Column:
    return (F.shiftright(x, 64 - BIN_BITS) + BINS // 2).cast("int")


def _literal(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    differ = F.lit(0)
    for i in range(LONGS):
        x, y = (F.conv(F.substring(c, 16 * i + 1, 16), 16, -10).cast("long") for c in (a, b))
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(0x1111111111111111)
        differ = differ + F.bit_count(z)
    chance = 1.0 / (1 << BITS)
    same = (F.lit(BINS) - differ) / F.lit(float(BINS))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same - chance) / (1 - chance)))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.round(value, 9))


def _constant(values: list[int | None]) -> Column:
    """An array constant, as one literal however long (the optimiser folds it)."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _bounds(df: DataFrame, key: str) -> list[int]:
    """At most MAX_GROUPS - 1 ascending quantiles of the key (a bounded list)."""
    n = df.count()
    groups = max(1, min(MAX_GROUPS, n // GROUP_ROWS))
    if groups == 1:
        return []
    at = df.agg(F.percentile_approx(key, [i / groups for i in range(1, groups)], 10 * groups)).first()[0] or []
    return sorted(set(at))


def _group_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the key, by binary search in a constant array; null: 0."""
    size = 1
    while size < len(bounds) + 1:
        size *= 2
    cells = _constant(bounds)
    steps = []
    while size > 1:
        size //= 2
        steps.append(size)
    if not bounds:
        return F.lit(0)
    found = F.lit(0)
    search = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), found,
        lambda acc, s: F.when(F.get(cells, acc + s - 1) <= key, acc + s).otherwise(acc),
    )
    return F.coalesce(search, F.lit(0))


def with_next(df: DataFrame, key: str, tie: str, carry: list[str]) -> DataFrame:
    """Adds next_<c> for each c of carry: the value in the next row by (key, tie), cyclically.

    Rows are grouped by ranges of the key (one shuffle). The first rows of a group also go to
    the end of the group before, so no row needs another group.
    """
    bounds = _bounds(df.select(key), key)
    keyed = df.withColumn("_grp", _group_of(F.col(key), bounds))
    firsts = keyed.groupBy("_grp").agg(F.min(F.struct(F.col(key).isNotNull().alias("nn"), F.col(key).alias("k"))).alias("f")).orderBy("_grp").collect()
    groups = [r["_grp"] for r in firsts]
    if not groups:
        return keyed.drop("_grp").select("*", *[F.col(c).alias(f"next_{c}") for c in carry])
    # by group number, one cell a group
    before, first = [0] * (groups[-1] + 1), [None] * (groups[-1] + 1)
    for i, r in enumerate(firsts):
        before[r["_grp"]], first[r["_grp"]] = groups[i - 1], r["f"]["k"]
    is_first = F.col(key).eqNullSafe(F.get(_constant(first), "_grp"))
    here = F.struct(F.col("_grp").alias("g"), F.lit(0).alias("end"))
    there = F.struct(F.get(_constant(before), "_grp").cast("int").alias("g"), F.lit(1).alias("end"))
    rows = keyed.withColumn("_to", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here)))).drop("_grp")
    rows = rows.withColumn("_g", F.col("_to")["g"]).withColumn("_end", F.col("_to")["end"]).drop("_to")
    w = Window.partitionBy("_g").orderBy("_end", F.col(key).asc_nulls_first(), tie)
    out = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return out.filter("_end = 0").drop("_g", "_end")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_fingerprint(docs, "text", "fingerprint").withColumn("_tie", F.xxhash64("text"))
    pairs = with_next(own, "doc_id", "_tie", ["text", "fingerprint"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    out = pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
        edited.alias("_edited"),
    )
    out = out.withColumn("edited_sha256", F.sha2(F.encode("_edited", "UTF-8"), 256))
    out = with_fingerprint(out, "_edited", "edited_fingerprint")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
