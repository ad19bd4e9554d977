"""Operator 6: token ids in ORC files, in doc_id order.

Texts are range-partitioned and sorted by doc_id, encoded with the tokenizers library and
written by Spark's ORC writer: stripes with integer run-length encoding of the ids, row indexes,
and Bloom filters on doc_id. A row keeps its start within its file; files' totals, read from the
narrow columns alone, give each file's offset. Reading is parallel by stripe, and lookups by
doc_id prune files and stripes from min/max and Bloom filters (`lookup`).

The tokenizer splits a text before every space that starts a word, so ids of equal pieces are
equal wherever they stand: each worker keeps the ids of pieces seen so far (a bounded cache)
and gives only new pieces to the library. A text that holds one of the tokenizer's added tokens,
such as <|endoftext|>, goes to the library whole, which gives it that token's id.

Defined results: null text is empty and has the end id alone; null doc_id comes first; rows of
equal doc_id follow each other by hash of text; empty tables give empty results; extra columns
are left out. read_tokens works out files' offsets in one task over one row a file.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucera.llm.common import _IS_SPACE, new_path, slices, small_batches, span_hashes, table, text_buffers

END_ID = 0
CACHE_PIECES = 1_000_000
#: Unicode white space, as the tokenizer's pattern has it.
_WS = r"\t-\r \x85\xa0  -     　"
#: A piece: a run without white space with the space before it, or white space the tokenizer leaves apart.
_PIECE = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


#: White space beyond ASCII; texts that have such take the plain way.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


#: 0 white space, 1 letters, 2 digits, 3 signs, 4 what pieces are not cut by.
_SORT = np.full(256, 4, np.uint8)
_SORT[33:127] = 3
_SORT[48:58] = 2
_SORT[65:91] = _SORT[97:123] = 1
_SORT[[9, 10, 11, 12, 13, 32]] = 0
_SORT[39] = 4


def _turns(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where letters, digits and signs meet: the tokenizer's pattern always cuts there, but for
    apostrophes. Pieces with an apostrophe or letters beyond Latin-1 stay whole."""
    sort = _SORT[raw]
    second = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)) + 1
    sort[second] = sort[second - 1] = 1
    turn = np.zeros(len(raw), bool)
    turn[1:] = (sort[1:] != sort[:-1]) & (sort[1:] != 0) & (sort[:-1] != 0)
    starts = np.flatnonzero(begin[:-1])
    odd = np.add.reduceat(sort == 4, starts) > 0
    if odd.any():
        turn &= ~np.repeat(odd, np.diff(np.concatenate([starts, [len(raw)]])))
    return turn


class Encoder:
    """Ids of texts through a bounded table of pieces, keyed by 64-bit hashes of their bytes.

    A batch's pieces are found and hashed with numpy; an open-addressing table gives their ids.
    Only pieces not in the table become strings and go to the library.
    """

    def __init__(self, path: str, capacity: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.capacity, self.slots = capacity, 1 << (2 * capacity - 1).bit_length()
        self._clear()

    def _clear(self):
        self.n, self.used = 0, 0
        self.keys, self.where = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where absent."""
        mask = np.uint64(self.slots - 1)
        slot = (keys & mask).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == keys, self.where[slot], -1).astype(np.int64)
        left = np.flatnonzero((got != keys) & (got != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            got = self.keys[slot[left]]
            hit = got == keys[left]
            out[left[hit]] = self.where[slot[left[hit]]]
            left = left[~hit & (got != 0)]
        return out

    def _add(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Enters distinct new keys."""
        for lo in range(0, len(pieces), 4096):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[lo : lo + 4096], add_special_tokens=False)]
            flat = np.fromiter((i for x in ids for i in x), np.int32)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            n = self.n
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n + len(ids) > len(self.starts):
                self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
            self.flat[self.used : self.used + len(flat)] = flat
            self.starts[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[n : n + len(ids)] = sizes
            self.used += len(flat)
            self.n += len(ids)
            left, new = np.arange(n, self.n), keys[lo : lo + 4096]
            slot = (new & np.uint64(self.slots - 1)).astype(np.int64)
            while len(left):  # of keys that meet in a free slot the last one written stays
                free = self.keys[slot] == 0
                self.keys[slot[free]], self.where[slot[free]] = new[free], left[free]
                lost = self.keys[slot] != new
                left, new, slot = left[lost], new[lost], (slot[lost] + 1) & (self.slots - 1)

    def _ids(self, keys: np.ndarray, piece_at) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has; piece_at(i) is the string of piece i."""
        found = self._find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            if self.n + len(fresh) > self.capacity:
                self._clear()
                if len(fresh) < self.capacity:
                    return self._ids(keys, piece_at)
            if len(fresh) >= self.capacity:  # more than the table holds: in halves
                h = len(keys) // 2
                parts = self._ids(keys[:h], piece_at), self._ids(keys[h:], lambda i: piece_at(i + h))
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            self._add(fresh, [piece_at(i) for i in new[first].tolist()])
            found[new] = self._find(keys[new])
        sizes = self.sizes[found]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[found] - (ends - sizes), sizes) + np.arange(total)], sizes

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch(pa.array([text], pa.large_string()))[0]

    def encode_batch(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the n + 1 places where texts begin and end in them."""
        raw, offs = text_buffers(column)
        parts, counts, lo, n = [], [], 0, len(offs) - 1
        while lo < n:  # some texts at a time
            hi = lo + 1
            while hi < n and offs[hi + 1] - offs[lo] <= 1 << 18:
                hi += 1
            for ids, count in self._texts(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]):
                parts.append(ids)
                counts.append(count)
            lo = hi
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), ends

    def _texts(self, raw: np.ndarray, offs: np.ndarray):
        lead = (raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3)
        wide = np.zeros(len(offs) - 1, bool)
        at = np.flatnonzero(lead)
        if len(at):
            for i in np.unique(np.searchsorted(offs, at, "right") - 1).tolist():
                wide[i] = bool(_WIDE_SPACE.search(raw[offs[i] : offs[i + 1]].tobytes().decode()))
        data = raw.tobytes()
        for token in self.special:  # texts with the tokenizer's own tokens go to it whole
            place = data.find(token)
            while place >= 0:
                wide[np.searchsorted(offs, place, "right") - 1] = True
                place = data.find(token, place + 1)
        lo = 0
        while lo < len(wide):
            hi = lo + 1
            if wide[lo]:
                yield self._plain(raw[offs[lo] : offs[hi]].tobytes().decode())
            else:
                while hi < len(wide) and not wide[hi]:
                    hi += 1
                yield self._fast(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            lo = hi

    def _plain(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        data = text.encode()
        pieces = [text] if any(t in data for t in self.special) else _PIECE.findall(text)
        ids = [i for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False) for i in e.ids]
        return np.array(ids, np.int32), np.array([len(ids)])

    def _fast(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e = self._pieces(raw, offs)
        ids, sizes = self._ids(span_hashes(raw, s, e), lambda i: raw[s[i] : e[i]].tobytes().decode())
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.searchsorted(s, offs)])

    @staticmethod
    def _pieces(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of pieces of texts whose white space is ASCII: a space joins the word after it; of
        other white space before a word, all but the last character stand together."""
        space = _IS_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offs] = True
        begin = np.zeros(len(raw) + 1, bool)
        begin[:-1] |= edge[:-1]
        # a run of either kind begins
        begin[1:-1] |= space[1:] != space[:-1]
        # the last white space before a word begins a piece
        last = np.zeros(len(raw) + 1, bool)
        last[:-2] = space[:-1] & ~space[1:] & ~edge[1:-1]
        begin |= last
        # a word after a space does not
        joined = np.flatnonzero(last[:-1] & (raw == 32)) + 1
        begin[joined] = False
        if len(raw):
            begin[:-1] |= _turns(raw, begin)
        s = np.flatnonzero(begin[:-1])
        return s, np.concatenate([s[1:], [len(raw)]]) if len(s) else s


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The process's encoder: tasks that follow each other in a worker share its table."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, **options: str) -> None:
    """doc_id, text -> ORC files of (doc_id, part, start, n_tokens, ids) in doc_id order; options of the ORC writer."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, start = encoder_of(tokenizer), 0
        part = TaskContext.get().partitionId()
        for batch in slices(batches):
            flat, at = encoder.encode_batch(batch.column("text"))
            flat = np.insert(flat, at[1:], END_ID).astype(np.int32)
            sizes = np.diff(at) + 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + ends[:-1]), pa.array(sizes), ids], ["doc_id", "part", "start", "n_tokens", "ids"]
            )
            start += int(ends[-1])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    out = rows.mapInArrow(run, "doc_id long, part int, start long, n_tokens long, ids array<int>")
    out.write.options(**options).option("orc.compress", "ZSTD").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start over all files, n_tokens, ids."""
    rows = spark.read.orc(path)
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    # one row per file: a bounded table
    joined = rows.join(F.broadcast(files), "part")
    return joined.select("doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Rows of some documents; files and stripes that can't hold them are not read."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(ids))


def _digests(batches):
    for batch in batches:
        lists = batch.column("ids")
        at, flat = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).view(np.uint8))
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = new_path(spark, "op6-orc")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
