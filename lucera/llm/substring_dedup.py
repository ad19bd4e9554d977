"""Operator 9: remove words of 50-word windows that already start in a document of smaller id.

1. Winnowing finds where texts could share a window, exactly: each 50-word window picks the
   8-word shingle of least hash within it (an anchor); equal windows pick equal anchors. The
   windows that pick one anchor form a segment, of 43 windows at most. Only anchors seen under two
   different doc_ids matter, which a count on (anchor, doc_id) decides.
2. Segments go to a shard by anchor; equal segments are one content before the shuffle, with its
   least doc_id as owner. An anchor of over HOT_CONTENTS contents would not fit a shard, so its
   contents go to shards by finer keys: each window that two of them share by all its words, and
   each content that several documents have by all of its.
3. Each shard's contents are indexed in an FM-index: Burrows-Wheeler transform in a wavelet
   matrix of packed bits with block counts, and the least owner under a suffix interval. The
   documents' segments are streamed against it (equal ones once): backward search in lock step
   goes on while the suffix interval holds an owner below the document. A search that stops at a
   word rules out all windows over that stretch; one that runs through proves all windows within:
   matching statistics, reported as runs of starts above the threshold. Nothing is removed but
   what a search has found: a content is searched for owners below its own, and for documents
   beyond its owner.
4. Runs join back to the documents' segments and cut the words.

Defined results: null text has no words; equal doc_ids never remove from each other; null
doc_id counts as least; repeated rows each get the result; texts of under 50 words, and texts
that share nothing, keep every word; empty tables give empty results; extra columns are left out
by the query and kept by the stage.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucera.llm.common import HOT_SHARE, Work, Words, mix64, signed, slices, small_batches, table, text_buffers, whole_rows

WINDOW, GRAM = 50, 8
#: Contents of one anchor that a shard holds at most; words of one FM-index (more if one anchor has them).
HOT_CONTENTS, SHARD_WORDS = 2000, 400_000
#: Queries that go through an index in lock step.
QUERIES = 20_000


def anchors(words: Words) -> tuple[np.ndarray, ...]:
    """(text, hash, first start, number of starts) of each segment of a batch."""
    n = words.counts()
    g, offs = words.grams(GRAM)
    wide = WINDOW - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(g) < wide or not (n >= WINDOW).any():
        return none, none.astype(np.uint64), none, none
    # least of each run of `wide` shingles; the low bits hold the place, so ties go to the left
    at = np.arange(len(g)) - np.repeat(offs[:-1], np.diff(offs))
    bits = np.uint64(max(1, int(n.max()).bit_length()))
    v = (g >> bits << bits) | at.astype(np.uint64)
    have, low = 1, v
    while have * 2 <= wide:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[: len(v) - wide + 1], low[wide - have : wide - have + len(v) - wide + 1])
    doc = np.repeat(np.arange(len(n)), np.diff(offs))
    start = at[: len(low)]
    ok = start + WINDOW <= n[doc[: len(low)]]
    doc, start, low = doc[: len(low)][ok], start[ok], low[ok]
    if not len(doc):
        return none, none.astype(np.uint64), none, none
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])]))
    size = np.diff(np.concatenate([new, [len(doc)]]))
    place = (low[new] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return doc[new], g[offs[doc[new]] + place], start[new], size


def _spans(raw: np.ndarray, offs: np.ndarray, i: int) -> bytes:
    return raw[offs[i] : offs[i + 1]].tobytes()


def _scan(batches):
    """Per document: word count, digest of all words, and its segments."""
    for batch in slices(batches):
        raw, offs = text_buffers(batch.column("text"))
        words = Words(raw, offs)
        doc, h, start, size = anchors(words)
        ends = np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32)
        seg = pa.StructArray.from_arrays([pa.array(signed(h)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["h", "a", "n"])
        sha = [hashlib.sha256(b" ".join(_spans(raw, offs, i).split())).hexdigest() for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("k"), pa.array(words.counts()), pa.array(sha), pa.ListArray.from_arrays(pa.array(ends), seg)],
            ["doc_id", "k", "n_words", "full_sha256", "segments"],
        )


def _contents(batches):
    """Per shared segment: anchor, its words' hashes, a hash of them, and where it lies."""
    for batch in slices(batches):
        raw, offs = text_buffers(batch.column("text"))
        words = Words(raw, offs)
        segs = batch.column("segments")
        count = np.diff(segs.offsets.to_numpy())
        flat = segs.flatten()
        h, a, n = (flat.field(f).to_numpy() for f in ("h", "a", "n"))
        doc = np.repeat(np.arange(len(batch)), count)
        size = n.astype(np.int64) + WINDOW - 1
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(words.first[doc] + a - ends[:-1], size) + np.arange(ends[-1])
        content = words.hashes[at]
        digest = np.zeros(0, np.uint64)
        if len(size):
            place = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
            digest = mix64(np.add.reduceat(mix64(content + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), ends[:-1]) + size.astype(np.uint64))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(content)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(batch.column("doc_id").take(pa.array(doc))), pa.array(batch.column("k").take(pa.array(doc))), pa.array(h), pa.array(a), pa.array(n), pa.array(signed(digest)), lists],
            ["doc_id", "k", "h", "a", "n", "c", "words"],
        )


class FMIndex:
    """FM-index of integer sequences with the least owner (an int32 rank) under each suffix interval.

    It keeps no suffix array: about 14 bytes a word, three int32 of owners, and a bit and half a
    block count for each level of the wavelet matrix."""

    def __init__(self, seqs: list[np.ndarray], owners: np.ndarray):
        text = np.concatenate(seqs)
        self.alphabet, ids = np.unique(text, return_inverse=True)
        sizes = np.array([len(s) for s in seqs])
        ends = np.cumsum(sizes + 1) - 1
        t = np.zeros(len(text) + len(seqs) + 1, np.int64)
        body = np.ones(len(t), bool)
        body[ends] = False
        body[-1] = False
        t[body] = ids + 1
        self.n, self.sigma = len(t), len(self.alphabet) + 1
        sa = self._suffixes(t)
        owner = np.full(len(t), np.iinfo(np.int32).max, np.int32)
        owner[np.flatnonzero(body)] = np.repeat(owners.astype(np.int32), sizes)
        self._least(owner[sa])
        bwt = t[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=self.sigma))])
        self.levels = []
        for bit in range(max(1, int(self.sigma - 1).bit_length()) - 1, -1, -1):
            ones = ((bwt >> bit) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            cells = np.zeros(len(ones) // 64 + 1, np.uint64)
            cells.view(np.uint8)[: len(packed)] = packed
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(cells))]).astype(np.int32)
            self.levels.append((bit, cells, counts, len(ones) - int(ones.sum())))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])

    @staticmethod
    def _suffixes(t: np.ndarray) -> np.ndarray:
        """Suffix order by the first 128 symbols at least (segments end well before), by doubling."""
        rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
        k, n = 1, len(t)
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[:-k] = rank[k:] + 1
            key = rank * (n + 2) + nxt
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank[order] = new
            k *= 2
            if k >= 128 or new[-1] == n - 1:
                return order

    def _least(self, v: np.ndarray) -> None:
        """Owners, their minima from each cell's block start and to its end, and a sparse table over blocks of 64."""
        n = -(-len(v) // 64) * 64
        cells = np.full(n, np.iinfo(np.int32).max, np.int32)
        cells[: len(v)] = v
        grid = cells.reshape(-1, 64)
        self.owner = cells
        self.from_start = np.minimum.accumulate(grid, axis=1).reshape(-1)
        self.to_end = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.blocks = [grid.min(axis=1)]
        while 2 ** len(self.blocks) <= len(self.blocks[0]):
            half, last = 2 ** (len(self.blocks) - 1), self.blocks[-1]
            self.blocks.append(np.minimum(last[:-half], last[half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least owner in [lo, hi), where not empty."""
        a, b = lo >> 6, (hi - 1) >> 6
        out = np.minimum(self.to_end[lo], self.from_start[hi - 1])
        near = np.flatnonzero(a == b)
        if len(near):  # within one block: cell by cell
            size = hi[near] - lo[near]
            ends = np.cumsum(size)
            at = np.repeat(lo[near] - (ends - size), size) + np.arange(ends[-1])
            out[near] = np.minimum.reduceat(self.owner[at], ends - size)
        far = np.flatnonzero(b > a + 1)
        if len(far):
            p, q = a[far] + 1, b[far]
            level = np.frexp((q - p).astype(np.float64))[1] - 1
            for k in np.unique(level):
                m = level == k
                t = self.blocks[k]
                out[far[m]] = np.minimum(out[far[m]], np.minimum(t[p[m]], t[q[m] - (1 << int(k))]))
        return out

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the interval of c followed by what [lo, hi) stands for."""
        base = self.before[c]
        p, q, s = lo, hi, np.zeros(len(c), np.int64)
        for bit, cells, counts, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            p1, q1, s1 = (counts[x >> 6] + np.bitwise_count(cells[x >> 6] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64) for x in (p, q, s))
            p, q, s = np.where(one, p1 + zeros, p - p1), np.where(one, q1 + zeros, q - q1), np.where(one, s1 + zeros, s - s1)
        return base + p - s, base + q - s


class Shard:
    """One FM-index over contents; queries are streamed against it."""

    def __init__(self, seqs: list[np.ndarray], owners: np.ndarray):
        self.ranked, self.rank = np.unique(owners, return_inverse=True)
        self.fm = FMIndex(seqs, self.rank)

    def matched(self, seqs: list[np.ndarray], limits: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
        """Per query a mask of window starts whose window lies in a content with an owner below its limit."""
        fm = self.fm
        flat = np.concatenate(seqs)
        text = np.searchsorted(fm.alphabet, flat)
        known = fm.alphabet[np.minimum(text, len(fm.alphabet) - 1)] == flat
        text, limit = np.where(known, text + 1, -1), np.searchsorted(self.ranked, limits)
        offs = np.cumsum([0, *map(len, seqs)])
        found = [np.zeros(max(0, len(s) - window + 1), bool) for s in seqs]
        # a piece of work: query, unknown starts a..b, and the start whose window's end is searched from
        work = [(i, 0, len(m) - 1, len(m) - 1) for i, m in enumerate(found) if len(m)]
        while work:
            seq, a, b, mid = (np.array(x, np.int64) for x in zip(*work, strict=True))
            stop = np.full(len(work), -1, np.int64)  # last word not matched, relative; a - 1 if all are
            lo, hi = np.zeros(len(work), np.int64), np.full(len(work), fm.n, np.int64)
            live, pos = np.arange(len(work)), mid + window - 1
            while len(live):
                c = text[offs[seq[live]] + pos[live]]
                l2, h2 = fm.step(np.maximum(c, 0), lo[live], hi[live])
                good = (h2 > l2) & (c > 0)
                good[good] = fm.least(l2[good], h2[good]) < limit[seq[live[good]]]
                stop[live[~good]] = pos[live[~good]]
                live, l2, h2 = live[good], l2[good], h2[good]
                lo[live], hi[live] = l2, h2
                pos[live] -= 1
                over = pos[live] < a[live]
                stop[live[over]] = a[live[over]] - 1
                live = live[~over]
            nxt = []
            for i, s, e, m, p in zip(seq.tolist(), a.tolist(), b.tolist(), mid.tolist(), stop.tolist(), strict=True):
                if p < m:  # windows p + 1 .. m are matched
                    found[i][p + 1 : m + 1] = True
                    rest = ((s, p), (m + 1, e))
                else:  # windows m .. min(p, e) hold an unmatched stretch
                    rest = ((s, m - 1), (p + 1, e))
                for x, y in rest:
                    if x <= y:
                        nxt.append((i, x, y, x if m == e and p >= m else (x + y) // 2))
            work = nxt
        return found


def _search(batches):
    """Contents sorted by shard key g (kind, h, c, owner, words, strict, copies) in; runs of matched starts
    out: own says that they hold for the owner too. Rows of one g stay together."""

    def flush(rows):
        shard = Shard([r[4] for r in rows], np.array([r[3] for r in rows], np.int64))
        # each content against owners below its own, and against its own, for the documents beyond
        queries = [(r, own) for r in rows for own in (True, False) if (r[5] if own else r[6])]
        out = []
        for lo in range(0, len(queries), QUERIES):
            part = queries[lo : lo + QUERIES]
            masks = shard.matched([r[4] for r, _ in part], np.array([r[3] + (not own) for r, own in part], np.int64))
            for (r, own), m in zip(part, masks, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], m.astype(np.int8), [0]]))).tolist()
                out += [(r[0], r[1], r[2], f, t, own) for f, t in zip(edge[::2], edge[1::2], strict=True)]
        types = {"kind": pa.int32(), "h": pa.int64(), "c": pa.int64(), "f": pa.int32(), "t": pa.int32(), "own": pa.bool_()}
        cols = zip(*out, strict=True) if out else [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, types.values(), strict=True)], list(types))

    rows, total, last = [], 0, None
    for batch in batches:
        g, kind, h, c, owner, strict, copies = (batch.column(x).to_pylist() for x in ("g", "kind", "h", "c", "owner", "strict", "copies"))
        words = batch.column("words")
        at, flat = words.offsets.to_numpy(), words.values.to_numpy()
        for i in range(len(batch)):
            if total >= SHARD_WORDS and last != g[i]:
                yield flush(rows)
                rows, total = [], 0
            rows.append((kind[i], h[i], c[i], owner[i], flat[at[i] : at[i + 1]].copy(), strict[i], copies[i]))
            total, last = total + len(rows[-1][4]), g[i]
    if rows:
        yield flush(rows)


def _apply(batches):
    """Cuts the words of a document's runs [from, to) and digests what is kept."""
    for batch in slices(batches):
        raw, offs = text_buffers(batch.column("text"))
        runs = batch.column("runs").to_pylist()
        gone, sha, kept = [], [], []
        for i, rs in enumerate(runs):
            words = _spans(raw, offs, i).split()
            keep = np.ones(len(words), bool)
            for r in rs or []:
                keep[r["f"] : r["t"]] = False
            left = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
            gone.append(int(len(words) - keep.sum()))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode())
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["k", "n_removed", "kept_sha256", "kept_text"])


def even_join(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with a table of one row a key, whose n counts the key's rows, where a key may
    hold any share of the rows: hot keys are broadcast, so their rows stay where they are."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    few, rest = keys.filter(hot).drop("n"), keys.filter(~hot).drop("n")
    others = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(rest, on)
    return rows.join(F.broadcast(few), on).unionByName(others)


def text_key(row: str = "") -> Column:
    """64 bits of a document's id and text."""
    return F.xxhash64(F.struct(F.col(f"{row}doc_id").alias("d")), F.col(f"{row}text"), F.length(f"{row}text"))


def repeats(spark: SparkSession, docs: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """docs has doc_id, text. Scanned rows (doc_id, k, n_words, full_sha256) and, for each key k
    (a hash of doc_id and text) with something to remove, n_removed, kept_sha256, kept_text."""
    small_batches(spark)
    keyed = docs.select("doc_id", "text", text_key().alias("k"))
    scanned = work.save(keyed.mapInArrow(_scan, "doc_id long, k long, n_words long, full_sha256 string, segments array<struct<h:long,a:int,n:int>>"), "scan")
    low = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    segs = scanned.select(low.alias("d"), "k", F.explode("segments").alias("s")).select("d", "k", "s.h", "s.a", "s.n")
    shared = segs.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("h", "n")
    shared = work.save(shared, "shared")
    picked = even_join(segs.withColumnRenamed("n", "size"), shared, ["h"]).withColumnRenamed("size", "n").groupBy("k").agg(F.collect_set(F.struct("h", "a", "n")).alias("segments"))
    source = keyed.select(low.alias("doc_id"), "text", "k").join(picked, "k").dropDuplicates(["k"])
    source = work.save(source, "source")
    pieces = work.save(source.mapInArrow(_contents, "doc_id long, k long, h long, a int, n int, c long, words array<long>"), "pieces")
    contents = pieces.groupBy("h", "c").agg(F.min("doc_id").alias("owner"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    contents = work.save(contents, "contents")
    # the words are in contents now: of the segments only their places stay
    places = work.save(pieces.select("doc_id", "k", "h", "a", "c"), "places")
    work.drop("shared", "pieces")
    sizes = work.save(contents.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_CONTENTS), "sizes")
    placed = contents.withColumn("copies", F.col("last") > F.col("owner"))
    hot = work.save(even_join(placed.withColumnRenamed("n", "docs"), sizes, ["h"]), "hot")
    plain = placed.join(F.broadcast(sizes.select("h")) if sizes.count() < HOT_SHARE * HOT_SHARE else sizes.select("h"), "h", "left_anti")
    cut = hot.select("h", "c", "owner", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("f", "w"))
    cut = work.save(cut, "cut")
    least = F.min(F.struct("owner", "h", "c", "f"))
    twice = cut.groupBy("w").agg(least.alias("x"), F.max("owner").alias("hi"), F.count(F.lit(1)).alias("n")).filter("x.owner < hi")
    twice = work.save(twice.select("w", "n", F.col("x.owner").alias("lo"), "x.h", "x.c", "x.f"), "twice")
    windows = twice.join(hot.select("h", "c", "words"), ["h", "c"])
    yes, no = F.lit(True), F.lit(False)
    todo = plain.select(F.col("h").alias("g"), F.lit(0).alias("kind"), "h", "c", "owner", "words", yes.alias("strict"), "copies")
    todo = todo.unionByName(hot.filter("copies").select(F.col("c").alias("g"), F.lit(0).alias("kind"), "h", "c", "owner", "words", no.alias("strict"), "copies"))
    todo = todo.unionByName(windows.select(F.col("w").alias("g"), F.lit(1).alias("kind"), F.col("w").alias("h"), F.lit(0).cast("long").alias("c"), F.col("lo").alias("owner"), F.slice("words", F.col("f") + 1, WINDOW).alias("words"), no.alias("strict"), yes.alias("copies")))
    runs = todo.repartition("g").sortWithinPartitions("g").mapInArrow(_search, "kind int, h long, c long, f int, t int, own boolean")
    runs = work.save(runs, "runs")
    # a window found under its least owner goes from all contents of later owners
    seen = twice.select("w", "lo", "n").join(runs.filter("kind = 1").select(F.col("h").alias("w")).distinct(), "w")
    by_window = even_join(cut, seen, ["w"]).filter("lo < owner").select("h", "c", "f", (F.col("f") + 1).alias("t"), yes.alias("own"))
    found = runs.filter("kind = 0").select("h", "c", "f", "t", "own").unionByName(by_window).groupBy("h", "c").agg(F.collect_list(F.struct("f", "t", "own")).alias("found"))
    found = work.save(contents.select("h", "c", "owner", "n").join(found, ["h", "c"]), "found")
    placed = even_join(places, found, ["h", "c"])
    gone = placed.select("k", "a", "owner", "doc_id", F.explode("found").alias("r")).filter("r.own OR owner < doc_id")
    gone = gone.select("k", (F.col("a") + F.col("r.f")).alias("f"), (F.col("a") + F.col("r.t") + WINDOW - 1).alias("t"))
    gone = gone.groupBy("k").agg(F.collect_set(F.struct("f", "t")).alias("runs"))
    cutted = source.select("k", "text").join(gone, "k").mapInArrow(_apply, "k long, n_removed long, kept_sha256 string, kept_text string")
    cutted = work.save(cutted, "removed")
    work.drop("source", "places", "contents", "sizes", "hot", "cut", "twice", "runs", "found")
    return scanned.select("doc_id", "k", "n_words", "full_sha256"), cutted


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned, removed = repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), Work(spark, "op9"))
    out = scanned.join(removed.drop("kept_text"), "k", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "full_sha256").alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: repeated passages go from the texts; a document with no word left of some goes. Columns
    stay as they are but for text and n_chars, which tell what is kept; texts that nothing is removed from,
    null ones too, stay untouched."""
    _, removed = repeats(spark, docs.select("doc_id", "text"), Work(spark, "substring"))
    out = whole_rows(docs).withColumn("_k", text_key("_row.")).join(removed.select(F.col("k").alias("_k"), "kept_text"), "_k", "left")
    row = F.col("_row").withField("text", F.coalesce("kept_text", "_row.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(F.coalesce("kept_text", "_row.text")).cast("long"))
    return out.filter("kept_text IS NULL OR kept_text <> ''").select(row.alias("_row")).select("_row.*")
