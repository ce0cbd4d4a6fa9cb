"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Documents become pieces (:func:`tokenize_pieces`); only their lengths travel. The
pieces are dealt over partitions, each packed best-fit decreasing. For each partition
dual-feasible functions give a number of bins that no packing can go below: where
best-fit decreasing meets it, the partition is certified and done. Partitions with a
gap hand on all pieces but those in full bins, certified ones only those of bins with
much room; these are dealt anew over fewer partitions, and best-fit decreasing is run
again, until nothing is handed on or a deal saves no bin. That last deal is not kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, materialize_table
from .textnp import SOLID, Texts, padded, span_keys

CAPACITY = 4096
END_ID = 1
#: Pieces dealt to one partition, roughly.
DEAL_ROWS = 50_000
#: A certified partition hands on its bins that are filled less than this: every
#: partition's last bins are, and they fill up with those of others.
SEALED = 0.97

# -- tokens ------------------------------------------------------------------


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file whose pre-tokens never span white space.

    A text's ids are then those of its runs of other characters, one after the other,
    so each distinct run is given to the tokenizer once and looked up after that.
    Texts that hold one of the file's special tokens are given to it as a whole. The
    table is direct-mapped and of fixed size: a run that loses its place is
    tokenised again.
    """

    SLOTS = 1 << 21
    ARENA = 1 << 24
    SEPARATOR = "<|startoftext|>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.separator = self.whole.token_to_id(self.SEPARATOR)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.at = np.zeros(self.SLOTS, np.int64)
        self.size = np.zeros(self.SLOTS, np.int32)
        self.arena = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        joined = [self.SEPARATOR.join(words[k:k + 512]) for k in range(0, len(words), 512)]
        sizes, out = [], []
        for e in self.whole.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(ids == self.separator)
            sizes.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
            out.append(np.delete(ids, cut))
        sizes, out = np.concatenate(sizes), np.concatenate(out)
        assert len(sizes) == len(words)
        return sizes, out

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        if self.used > self.ARENA:
            self.clear()
        doc, start, end = texts.spans(SOLID)
        buf = padded(texts.buf, lower=True)
        key = span_keys(buf, start, end)
        slot = (key >> np.uint64(64 - 21)).astype(np.int64)
        hit = self.keys[slot] == key
        at, size = np.where(hit, self.at[slot], 0), np.where(hit, self.size[slot], 0)
        miss = np.flatnonzero(~hit)
        if len(miss):
            fresh, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            raw = buf.tobytes()
            words = [raw[a:b].decode("utf-8", "replace") for a, b in
                     zip(start[miss[first]].tolist(), end[miss[first]].tolist())]
            if any(token in raw for token in self.special):  # such texts are taken whole, see _specials
                words = ["" if any(token in w.encode() for token in self.special) else w for w in words]
            sizes, ids = self._encode(words)
            while self.used + len(ids) > len(self.arena):
                self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
            self.arena[self.used:self.used + len(ids)] = ids
            places = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
            to = slot[miss[first]]
            self.keys[to], self.at[to], self.size[to] = fresh, places, sizes
            at[miss], size[miss] = places[back], sizes[back]
        per_doc = np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        out = self.arena[np.repeat(at - (upto - size), size) + np.arange(total)]
        return self._specials(texts, out, per_doc)

    def _specials(self, texts: Texts, out: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, odd = texts.buf.tobytes(), set()
        lowered = raw.lower()  # as the runs were given to the tokenizer
        for token in self.special:
            k = lowered.find(token)
            while k >= 0:
                odd.add(int(np.searchsorted(texts.starts, k, "right") - 1))
                k = lowered.find(token, k + 1)
        if not odd:
            return out, per_doc
        parts = np.split(out, np.cumsum(per_doc)[:-1])
        for d in odd:
            text = raw[texts.starts[d]:texts.ends[d]].decode("utf-8", "replace")
            parts[d] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


PIECE_FIELDS = [
    ("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
    ("ids_crc32", T.LongType())]


def tokenize_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                    capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of each row of ``docs``: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids (null: none) and ``end_id``. Longer ones than
    ``capacity`` are cut into pieces of that length; the last one may be shorter.
    ``keep_ids`` adds the column ``ids``. Rows that repeat an id are documents of
    their own with the same ``doc_id``.
    """
    schema = T.StructType([T.StructField(n, t) for n, t in PIECE_FIELDS])
    if keep_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokenizer(tokenizer)
        for batch in arrow_rows(batches, "_text"):
            ids, sizes = encoder.ids(Texts(batch.column("_text")))
            ends = np.cumsum(sizes + 1)
            flat = np.insert(ids, ends - np.arange(len(sizes)) - 1, end_id).astype("<u4")
            n = -(-(sizes + 1) // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, (sizes + 1)[row] - start)
            low = (ends - sizes - 1)[row] + start
            crc = [zlib.crc32(flat[a:a + k]) for a, k in zip(low.tolist(), length.tolist())]
            columns = [batch.column("_doc").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start),
                       pa.array(length), pa.array(crc, pa.int64())]
            if keep_ids:
                offsets = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat.view("<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    rows = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(cut, schema)


# -- bins --------------------------------------------------------------------


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length. Bins are found by the room they have left,
    so the work is a step per item and per distinct room."""
    order = np.argsort(-lengths, kind="stable")
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r left
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room, count = count, capacity, count + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            rooms[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets


def bins_needed(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """A lower bound on the number of bins: the best of the total length and of two
    families of dual-feasible functions, each over all their thresholds.

    * f_e: lengths above capacity - e count as full, those below e as nothing;
    * u_k: a length x counts as floor((k + 1) x / capacity) / k, unchanged where
      (k + 1) x / capacity is whole.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    number = np.concatenate([[0], np.cumsum(counts)])  # number[x]: items below x
    total = np.concatenate([[0], np.cumsum(counts * size)])
    e = np.arange(1, capacity // 2 + 1)
    full = number[-1] - number[capacity - e + 1]
    middle = total[capacity - e + 1] - total[e]
    best = max(best, int((full + -(-middle // capacity)).max()))
    for k in range(1, 101):
        scaled = (k + 1) * size
        # in units of 1 / (k * capacity)
        value = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def _deal(pieces: DataFrame, parts: int, salt: int) -> DataFrame:
    # Equal lengths are spread as well, so every partition gets the same mixture.
    return pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "copy", F.lit(salt)), F.lit(parts)))


def _pack_schema() -> str:
    return "doc_id long, piece int, copy long, length long, part long, bin long, offset long, used long, sealed boolean"


def _packer(capacity: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        count = int(bins.max()) + 1 if len(bins) else 0
        used = np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)
        certified = count == bins_needed(lengths, capacity)
        return pd.DataFrame({
            "doc_id": frame["doc_id"], "piece": frame["piece"], "copy": frame["copy"], "length": lengths,
            "part": frame["_part"], "bin": bins, "offset": offsets, "used": used[bins],
            "sealed": (used[bins] == capacity) | (certified & (used[bins] >= SEALED * capacity))})

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, deal_rows: int = DEAL_ROWS) -> DataFrame:
    """Places pieces (doc_id, piece, copy, length) in sequences: adds sequence_id and offset.

    ``copy`` tells rows apart that repeat a document. Full pieces are sequences of
    their own. Sequences are numbered per deal and partition; numbers are unique but not
    gapless. Lengths run from 1 to ``capacity``.
    """
    spark: SparkSession = pieces.sparkSession
    keys = ["doc_id", "piece", "copy", "length"]
    open_pieces = pieces.select(*keys)
    left = open_pieces.count()
    done: list[DataFrame] = []
    deal, kept, bins_kept = 0, None, None
    while True:
        parts = max(1, -(-left // deal_rows))
        dealt = _deal(open_pieces, parts, deal)
        packed = materialize_table(dealt.groupBy("_part").applyInPandas(_packer(capacity), _pack_schema()))
        number = ((F.lit(deal) * F.lit(1 << 24) + F.col("part")) * F.lit(1 << 32) + F.col("bin")).alias("sequence_id")
        placed = packed.select(*keys, "offset", number, "sealed")
        is_open = (F.col("offset") == 0) & ~F.col("sealed")  # a bin has one piece at offset 0
        bins = placed.agg(F.count_if(F.col("offset") == 0).alias("all"), F.count_if(is_open).alias("open"),
                          F.count_if(~F.col("sealed")).alias("rows")).first()
        if kept is not None and bins["all"] >= bins_kept:
            done.append(kept.drop("sealed"))
            break
        done.append(placed.where("sealed").drop("sealed"))
        kept, bins_kept, left = placed.where("NOT sealed"), bins["open"], bins["rows"]
        if not left:
            break
        open_pieces, deal = kept.select(*keys), deal + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are documents of one token; an empty table gives no rows;
    rows that repeat a document are packed each on its own; other columns are ignored.
    The tokenised pieces are written once under spark.checkpoint.dir, without ids.
    """
    pieces = tokenize_pieces(docs, tokenizer, doc_id, text, capacity, end_id)
    pieces = materialize_table(pieces.withColumn("copy", F.monotonically_increasing_id()))
    placed = pack_pieces(pieces, capacity).withColumnRenamed("copy", "_copy").drop("length", "doc_id", "piece")
    return pieces.join(placed, F.col("copy") == F.col("_copy")).drop("copy", "_copy")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id and their ids, from pieces with ``ids`` and their places."""
    joined = pieces.join(placed.select("doc_id", "piece", "copy", "sequence_id", "offset"), ["doc_id", "piece", "copy"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
