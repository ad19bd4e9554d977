"""Operator 8: Jaccard self-join on 5-word shingles at 0.8 by MinHash banding and exact checks.

Equal texts are one class representative (rep) from the start. Each text gets BANDS x ROWS
MinHash values, numbers chosen by `bands_for` so that a pair at the threshold shares a band
with TARGET_RECALL. Reps meet in buckets (band, value). Buckets with the same members are one
bucket. Members' whole shingle sets go to their buckets and every pair of a bucket is checked
on them, in blocks held as arrays, inside the task: rows out are one per member (its links)
and at most one edge per member, never a row per pair. A bucket above BLOCK members is cut in
blocks, and each two blocks meet in a task of their own, so no task holds a whole group. A pair
that meets in several buckets counts only in that of its first shared band.

Defined results: words are taken unchanged; a text of 1 to 4 words has one shingle of all its
words; texts without words equal only the same text; null text is empty; equal texts are linked;
a class's id is its least doc_id, null if all are null; empty tables give empty results; repeated
rows stay. Where doc_ids are null or repeated, unrelated classes can have one id: near_classes also
gives each class's root, which is its own, and the pipeline's stage keeps a document of each root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucera.llm.common import Work, Words, mix64, signed, slices, small_batches, table, text_buffers, whole_rows
from lucera.llm.components import connected

SHINGLE, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.999
BLOCK = 400
MAX_ROWS = 5


def bands_for(threshold: float, recall: float, rows: int = MAX_ROWS) -> tuple[int, int]:
    """Least number of bands of so many rows that a pair at the threshold shares one with this recall."""
    bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
    return bands, rows


BANDS, ROWS = bands_for(THRESHOLD, TARGET_RECALL)
_r = np.random.default_rng(8)
_A = _r.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _r.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_C = _r.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_values(grams: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) band values; all-zero rows for texts without shingles."""
    n = len(offs) - 1
    out = np.zeros((n, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(offs))
    lo = 0
    while lo < len(full):  # some texts at a time: the products stay in cache
        hi = lo + 1
        while hi < len(full) and offs[full[hi] + 1] - offs[full[lo]] <= 1 << 15:
            hi += 1
        part = grams[offs[full[lo]] : offs[full[hi - 1] + 1]]
        starts = offs[full[lo:hi]] - offs[full[lo]]
        for b in range(BANDS):
            v = np.full(hi - lo, b, np.uint64)
            for r in range(ROWS):
                k = b * ROWS + r
                v += np.minimum.reduceat(part * _A[k] + _B[k], starts) * _C[r]
            out[full[lo:hi], b] = mix64(v) | np.uint64(1)
        lo = hi
    return out


def _signatures(batches):
    for batch in slices(batches):
        raw, offs = text_buffers(batch.column("text"))
        bands = band_values(*Words(raw, offs).grams(SHINGLE))
        flat = pa.array(signed(bands.reshape(-1)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), flat)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h1"), batch.column("h2"), lists], ["doc_id", "h1", "h2", "bands"])


def _sets(batches):
    """Sorted distinct shingle hashes of each text."""
    for batch in slices(batches):
        raw, offs = text_buffers(batch.column("text"))
        g, at = Words(raw, offs).grams(SHINGLE)
        sets = [np.unique(g[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = pa.array(signed(np.concatenate(sets))) if sets else pa.array([], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["rep", "grams"])


def _pairs(x: list, y: list | None, bucket: int):
    """Links among members x, or between x and y: boolean matrix. A member: (rep, copies, canon, grams)."""
    z = x if y is None else y
    both = x if y is None else [*x, *y]
    sizes = np.array([len(m[3]) for m in both])
    vocab, ids = np.unique(np.concatenate([m[3] for m in both]), return_inverse=True)
    # columns that only one member has can't be shared: drop them before the dense product
    shared = np.flatnonzero(np.bincount(ids, minlength=len(vocab)) > 1)
    place = np.full(len(vocab), -1)
    place[shared] = np.arange(len(shared))
    row, col = np.repeat(np.arange(len(both)), sizes), place[ids]
    row, col = row[col >= 0], col[col >= 0]
    common = np.zeros((len(x), len(z)), np.float32)
    for lo in range(0, len(shared), 8192):
        hit = (col >= lo) & (col < lo + 8192)
        dense = np.zeros((len(both), min(8192, len(shared) - lo)), np.float32)
        dense[row[hit], col[hit] - lo] = 1
        common += dense[: len(x)] @ (dense if y is None else dense[len(x) :]).T
    nx, nz = sizes[: len(x)], sizes if y is None else sizes[len(x) :]
    union = nx[:, None] + nz[None, :] - common
    linked = common >= THRESHOLD * union - 1e-3
    if y is None:
        linked &= np.triu(np.ones(linked.shape, bool), 1)
    # only pairs whose first shared band lies in this bucket
    cx, cz = np.stack([m[2] for m in x]), np.stack([m[2] for m in z])
    i, j = np.nonzero(linked)
    same = (cx[i] == cz[j]) & (cx[i] != 0)
    first = cx[i, same.argmax(1)]
    keep = same.any(1) & (first == bucket)
    return i[keep], j[keep]


def _links(batches):
    """From rows sorted by (bucket, block pair): links and a spanning edge per member."""

    def flush(key, left, right):
        if not left or (key[1] != key[2] and not right) or (key[1] == key[2] and len(left) < 2):
            return None
        i, j = _pairs(left, right if key[1] != key[2] else None, key[0])
        z = left if key[1] == key[2] else right
        wx, wz = np.array([m[1] for m in left]), np.array([m[1] for m in z])
        nx, nz = np.zeros(len(left), np.int64), np.zeros(len(z), np.int64)
        np.add.at(nx, i, wz[j])
        np.add.at(nz, j, wx[i])
        # spanning forest by minimum label within the block pair
        reps = [m[0] for m in left] + ([] if z is left else [m[0] for m in z])
        shift = 0 if z is left else len(left)
        label = list(range(len(reps)))

        def find(a):
            while label[a] != a:
                label[a] = label[label[a]]
                a = label[a]
            return a

        edges = []
        for a, b in zip(i.tolist(), (j + shift).tolist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                label[max(p, q)] = min(p, q)
                edges.append((reps[a], reps[b], 0))
        counts = [(m[0], None, int(c)) for m, c in zip(left, nx, strict=True) if c] + [(m[0], None, int(c)) for m, c in zip(z, nz, strict=True) if c]
        rows = edges + counts
        names = ["rep", "other", "links"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names) if rows else None

    key, left, right = None, [], []
    for batch in batches:
        bucket, bi, bj, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "bi", "bj", "side"))
        rep, copies = batch.column("rep").to_pylist(), batch.column("copies").to_pylist()
        canon, grams = batch.column("canon"), batch.column("grams")
        for k in range(len(batch)):
            now = (int(bucket[k]), int(bi[k]), int(bj[k]))
            if now != key:
                if key is not None and (out := flush(key, left, right)) is not None:
                    yield out
                key, left, right = now, [], []
            member = (rep[k], copies[k], canon[k].values.to_numpy(), grams[k].values.to_numpy())
            (left if side[k] == 0 else right).append(member)
    if key is not None and (out := flush(key, left, right)) is not None:
        yield out


def near_classes(spark: SparkSession, docs: DataFrame, work: Work) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, class_id, n_links, h1, h2 (hashes of the text), root (one per class)."""
    small_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.reverse("text"), F.length("text")).alias("h2"))
    signed_ = work.save(hashed.mapInArrow(_signatures, "doc_id long, h1 long, h2 long, bands array<long>"), "signatures")
    reps = signed_.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    # a row of its own identifies a rep, whatever doc_id is
    reps = work.save(reps.withColumn("rep", F.xxhash64("h1", "h2")), "reps")
    member = reps.select("rep", F.posexplode("bands").alias("band", "value")).filter("value <> 0")
    buckets = member.groupBy("band", "value").agg(
        F.count(F.lit(1)).alias("members"), F.bit_xor("rep").alias("x1"), F.bit_xor(F.xxhash64("rep")).alias("x2")
    ).filter("members > 1")
    buckets = buckets.withColumn("bucket", F.xxhash64("members", "x1", "x2"))
    hits = member.join(buckets.select("band", "value", "bucket", "members"), ["band", "value"])
    hits = hits.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("band", "bucket"))).alias("by"), F.collect_set(F.struct("bucket", "members")).alias("buckets"))
    canon = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.coalesce(F.element_at("by", b), F.lit(0)))
    hits = work.save(hits.select("rep", "buckets", canon.alias("canon")).join(reps.select("rep", "first", "copies", "h1", "h2"), "rep"), "hits")
    wanted = hits.select("rep", "first", "h1", "h2").hint("merge")  # one way at every size
    found = hashed.join(wanted, (hashed["doc_id"].eqNullSafe(wanted["first"])) & (hashed["h1"] == wanted["h1"]) & (hashed["h2"] == wanted["h2"]), "inner")
    sets = work.save(found.select("rep", "text").mapInArrow(_sets, "rep long, grams array<long>"), "sets")
    sets = sets.dropDuplicates(["rep"])
    at = hits.select("rep", "copies", "canon", F.explode("buckets").alias("b")).select("rep", "copies", "canon", "b.bucket", "b.members")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", "bucket"), blocks).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda o: F.struct(F.least(own, o).alias("bi"), F.greatest(own, o).alias("bj"), (o < own).cast("int").alias("side")),
    )
    at = at.join(sets, "rep").withColumn("m", F.explode(meets)).select("rep", "copies", "canon", "grams", "bucket", "m.bi", "m.bj", "m.side")
    at = at.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    found = work.save(at.mapInArrow(_links, "rep long, other long, links long"), "links")
    work.drop("sets")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected(spark, found.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")), work)
    named = reps.select("rep", "first", "copies", "h1", "h2").join(labels, F.col("rep") == F.col("node"), "left")
    named = named.withColumn("root", F.coalesce("root", "rep")).join(counts, "rep", "left")
    least = named.filter("node IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(least, "root", "left").select(
        "h1", "h2", "first", "root", F.coalesce("least", "first").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    named = work.save(named, "classes")
    work.drop("reps", "hits", "links", *[k for k in work.paths if k.startswith("cc")])
    return signed_.select("doc_id", "h1", "h2").join(named, ["h1", "h2"])


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), Work(spark, "op8"))
    return out.select("doc_id", "class_id", "n_links")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the document with the least doc_id of each class stays (one row of it). All columns of docs
    stay as they are; a null text counts as empty, and null doc_ids as least only of classes without ids."""
    classes = near_classes(spark, docs.select("doc_id", "text"), Work(spark, "near"))
    # by root, not class_id: classes without ids, or with repeated ones, share that
    least = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "h1")).alias("k"))
    keep = least.select(F.col("k.doc_id").alias("_id"), F.col("k.h1").alias("_h"))
    rows = whole_rows(docs).select("_row", F.col("_row.doc_id").alias("_d"), F.xxhash64(F.coalesce("_row.text", F.lit(""))).alias("_t"))
    kept = rows.join(keep, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h")), "left_semi")
    return kept.dropDuplicates(["_d", "_t"]).select("_row.*")
