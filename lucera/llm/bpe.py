"""Operator 7: byte-level BPE by overlapping chunks.

A text longer than CHUNK is cut in chunks that overlap; each chunk is pre-tokenised on its own.
The first boundary that two neighbours' pre-tokens share in the overlap (resynchronise) stitches
them: from there on both would go on alike, so the pre-tokens are those of the whole text. If an
overlap has no such boundary, the chunk is pre-tokenised again from the last good boundary. Runs
of pre-tokens are then encoded, cut where a pre-token ends without white space, so a run alone
splits as it does in the text. Decoding concatenates the ids' bytes.

A text of over SPREAD characters spreads over tasks: its chunks are rows, pre-tokenised in any
task; one task stitches their boundaries as they stream by, and keeps only cuts, one a chunk at
most; the pieces between cuts are rows again, encoded and decoded in any task; digests run over
the pieces in order. Only boundaries, ids and bytes of such texts are shuffled.

Defined results: null text is empty, with no ids; every text is encoded whole; empty tables give
empty results; repeated rows pass through; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucera.llm.common import Work, slices, small_batches, table

CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Characters from which a text's chunks are spread over tasks, and chunks of such texts (CHUNK is too small a row).
SPREAD, WIDE = 1 << 21, 1 << 18

_cache: dict[str, Bpe] = {}


class Bpe:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.pattern, self.chunk, self.overlap = regex.compile(pattern), chunk, overlap

    def chunk_ends(self, text: str, start: int) -> list[int]:
        """Ends of the pre-tokens of one chunk, those that the chunk's end may have cut left out."""
        stop = min(len(text), start + self.chunk + self.overlap)
        ends = [m.end() for m in self.pattern.finditer(text[start:stop])]
        if stop < len(text):
            # the last pre-token, and white space before it, may go on beyond the chunk
            keep = len(ends) - 1
            while keep > 0 and text[start + ends[keep - 1] - 1].isspace():
                keep -= 1
            ends = ends[:keep]
        return [start + e for e in ends]

    def boundaries(self, text: str) -> list[int]:
        """Ends of all pre-tokens of the text, from chunks stitched where they resynchronise."""
        starts = range(0, len(text), self.chunk)
        chunks = [self.chunk_ends(text, s) for s in starts]  # each on its own
        done = list(chunks[0]) if chunks else []
        for s, ends in zip(list(starts)[1:], chunks[1:], strict=True):
            known = done[self._from(done, s) :]
            own = set(ends)
            # a boundary after a pre-token without white space at its end leaves no context behind
            meet = next((e for e in known if e in own and not text[e - 1].isspace() and e > s), None)
            if meet is None:
                last = next((e for e in reversed(done) if not text[e - 1].isspace()), 0)
                done = [e for e in done if e <= last] + self._rest(text, last, s)
            else:
                done = [*done[: self._from(done, meet)], *ends[self._from(ends, meet) :]]
        if starts and (not done or done[-1] < len(text)):
            last = next((e for e in reversed(done) if not text[e - 1].isspace()), 0)
            done = [e for e in done if e <= last] + [last + m.end() for m in self.pattern.finditer(text[last:])]
        return done

    def _rest(self, text: str, start: int, chunk: int) -> list[int]:
        """Boundaries from a good one to the end of the chunk, widened until there are some."""
        stop = min(len(text), chunk + self.chunk + self.overlap)
        while True:
            ends = [m.end() for m in self.pattern.finditer(text[start:stop])]
            if stop == len(text):
                return [start + e for e in ends]
            keep = len(ends) - 1
            while keep > 0 and text[start + ends[keep - 1] - 1].isspace():
                keep -= 1
            if keep > 0:
                return [start + e for e in ends[:keep]]
            stop = min(len(text), start + 2 * (stop - start))

    @staticmethod
    def _from(ends: list[int], at: int) -> int:
        return int(np.searchsorted(ends, at)) if ends else 0

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.chunk:
            return self.encoding.encode_ordinary(text)
        out, start = [], 0
        for e in self.boundaries(text):
            if e - start >= self.chunk // 4 and not text[e - 1].isspace():
                out += self.encoding.encode_ordinary(text[start:e])
                start = e
        return out + self.encoding.encode_ordinary(text[start:])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def tokenizer(path: str) -> Bpe:
    if path not in _cache:
        _cache[path] = Bpe(path)
    return _cache[path]


def chunk_rows(long: DataFrame) -> DataFrame:
    """k, length, no and chunk (with its overlap) of long texts (k, text)."""
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.ceil(n / WIDE).cast("int") - 1)
    rows = long.select("k", "text", n.alias("length"), F.explode(starts).alias("no"))
    return rows.select("k", "length", "no", F.substr("text", F.col("no") * WIDE + 1, F.lit(WIDE + OVERLAP)).alias("chunk"))


def _chunk_ends(path: str, wide: int, overlap: int):
    def run(batches):
        pattern = tokenizer(path).pattern
        for batch in slices(batches, "chunk"):
            ends = []
            for text, no, length in zip(batch.column("chunk").to_pylist(), batch.column("no").to_pylist(), batch.column("length").to_pylist(), strict=True):
                at = [m.end() for m in pattern.finditer(text)]
                if no * wide + len(text) < length:  # the last pre-token may go on beyond the chunk
                    at = at[:-1]
                # ends without white space before them leave no context behind; only those in an overlap can meet
                ends.append([no * wide + e for e in at if not text[e - 1].isspace() and (e <= overlap or e > wide)])
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("length"), batch.column("no"), pa.array(ends, pa.list_(pa.int64()))], ["k", "length", "no", "ends"])

    return run


def _cuts(wide: int, overlap: int):
    """Chunks' ends by (k, no) in; places where a text can be cut out, one a chunk at most. A chunk's ends
    count once an end of it is also one of its predecessor's that count: from there on both go on alike.
    Where none is, the rest of the text stays one piece."""

    def run(batches):
        key, known, out = None, None, []
        for batch in batches:
            for k, no, ends in zip(batch.column("k").to_pylist(), batch.column("no").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if k != key:
                    key, known = k, set(ends)
                    continue
                if known is None:
                    continue
                start = no * wide
                meet = next((e for e in ends if start < e <= start + overlap and e in known), None)
                if meet is None:
                    known = None
                else:
                    out.append((k, meet))
                    known = {e for e in ends if e >= meet}
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["k", "cut"])
            out = []

    return run


def _pieces(path: str):
    def run(batches):
        bpe = tokenizer(path)
        for batch in slices(batches, "piece"):
            ids = [bpe.encode(t) for t in batch.column("piece").to_pylist()]
            raw = [np.array(x, "<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("no"), pa.array([len(x) for x in ids], pa.int64()), pa.array(raw, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())], ["k", "no", "n", "ids", "bytes"]
            )

    return run


def _digests(batches):
    """Pieces by (k, no) in, one row a text out."""
    key, n, ids, text, out = None, 0, hashlib.sha256(), hashlib.sha256(), []
    names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"]
    for batch in batches:
        for k, m, a, b in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "ids", "bytes")), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, n, ids.hexdigest(), text.hexdigest()))
                key, n, ids, text = k, 0, hashlib.sha256(), hashlib.sha256()
            n += m
            ids.update(a)
            text.update(b)
    if key is not None:
        out.append((key, n, ids.hexdigest(), text.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names)


def encoded_long(docs: DataFrame, path: str, work: Work) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of texts of over SPREAD characters; equal texts are encoded once."""
    keyed = work.save(docs.filter(F.length("text") > SPREAD).select("doc_id", "text", F.xxhash64("text").alias("k")), "long")
    long = keyed.select("k", "text").dropDuplicates(["k"])
    ends = chunk_rows(long).repartition("k", "no").mapInArrow(_chunk_ends(path, WIDE, OVERLAP), "k long, length int, no int, ends array<long>")
    cuts = work.save(ends.repartition("k").sortWithinPartitions("k", "no").mapInArrow(_cuts(WIDE, OVERLAP), "k long, cut long"), "cuts")
    # cuts of a text: one a chunk at most
    cuts = cuts.groupBy("k").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    rows = long.join(cuts, "k", "left").withColumn("cuts", F.concat(F.array(F.lit(0).cast("long")), F.coalesce("cuts", F.array().cast("array<long>")), F.array(F.length("text").cast("long"))))
    spans = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(i.alias("no"), F.get("cuts", i).cast("int").alias("a"), F.get("cuts", i + 1).cast("int").alias("b")))
    rows = rows.select("k", "text", F.explode(spans).alias("s")).select("k", "s.no", F.substr("text", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("piece"))
    done = rows.repartition("k", "no").mapInArrow(_pieces(path), "k long, no int, n long, ids binary, bytes binary")
    digests = done.repartition("k").sortWithinPartitions("k", "no").mapInArrow(_digests, "k long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    digests = work.save(digests, "digests")
    return keyed.select("doc_id", "k").join(digests, "k").drop("k")


def encoded(docs: DataFrame, path: str, work: Work) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text."""
    short = encoded_short(docs.filter("coalesce(length(text), 0) <= " + str(SPREAD)), path)
    return short.unionByName(encoded_long(docs, path, work))


def encoded_short(docs: DataFrame, path: str) -> DataFrame:
    """The same of texts that one task takes whole."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for t in batch.column("text").to_pylist():
                ids = bpe.encode(t or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), Work(spark, "op7"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents' ids, last of all: a row a document, as op7; other columns are left out, null text is empty."""
    small_batches(spark)
    return encoded(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), Work(spark, "bpe"))
