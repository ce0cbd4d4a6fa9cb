"""BPE encoding and decoding with an index of pair occurrences.

A task takes its texts in blocks. The pieces that the pre-tokenizer's pattern cuts are
encoded once per distinct piece, all new ones of a block together:

* their bytes stand in one array of symbols, linked to the left and right neighbour;
* an index maps each pair that has a merge to the list of all its positions;
* the ranks that have positions are applied in ascending order. A rank replaces all its
  pairs at once (of overlapping ones, as in ``aaa``, every second from the left), and
  only the lists of the pairs to the left and right of a replacement change. A pair
  that has gone since it was listed no longer shows its two symbols and is passed over.

This gives what merging piece by piece gives: a merge makes a symbol that no merge of a
lower rank holds (checked when the merges are read).

The ids of a text are then gathered from its pieces. Decoding gathers the bytes of the
ids. No row meets another, so there is no shuffle; memory is bounded by a block and by
``KNOWN_IDS`` remembered ids (one text longer than a block is taken alone).

Rows: a null text is the empty text, without ids. Repeated rows are kept, each with its
own result; ties do not occur; an empty table gives no rows. Only the id and the text column are
read, so other columns may have any name. Ids are kept as packed little-endian unsigned
32-bit integers; ``unpack`` gives them as an array.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows

#: Ids of known pieces that a task keeps from block to block.
KNOWN_IDS = 1_000_000
#: Fixed value: how byte-level vocabularies cut texts into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class is the same in every Unicode version since long; a text that
#: holds others is cut by the tokenizer's own splitter, whose version decides.
SETTLED = "\x00-՗ -⁤ぁ-ゖァ-ヺ一-龥가-힣"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1
    characters for themselves, the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(own))}
    return [chr(rest.get(b, b)) for b in range(256)]


class Vocabulary:
    """The merges of a byte-level BPE file as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout") if model.get(k)]
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
                or spec.get("normalizer") or odd or any(a.get(k) for a in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        ids: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.byte_id = np.array([ids[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        rank_made = np.full(max(ids.values()) + 1, -1, np.int64)
        rank_made[made] = np.arange(len(made))
        if len(set(made.tolist())) < len(made) or (np.maximum(rank_made[left], rank_made[right]) >= np.arange(len(made))).any():
            raise ValueError(f"{path}: a merge makes a symbol twice or uses one that is made later")
        self.left, self.right, self.made = left, right, made
        keys = left << 32 | right
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.added = {a["content"]: a["id"] for a in added}
        texts = {i: t for t, i in ids.items()} | {i: t for t, i in self.added.items()}
        of = {c: b for b, c in enumerate(letters)}
        parts = [b""] * (max(texts) + 1)
        for i, t in texts.items():
            parts[i] = t.encode() if i in self.added.values() or any(c not in of for c in t) else bytes(of[c] for c in t)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.length = np.array([len(p) for p in parts] + [0], np.int64)  # the last: unknown ids
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair key, -1 where there is no merge."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rank[at], -1) if len(self.keys) else np.full(len(keys), -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Positions by rank of the pair that starts there, and the ranks in use."""

    def __init__(self) -> None:
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, at: np.ndarray) -> None:
        live = ranks >= 0
        ranks, at = ranks[live], at[live]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        low = 0
        for high in [*cuts.tolist(), len(ranks)]:
            r = int(ranks[low])
            if r in self.lists:
                self.lists[r].append(at[low:high])
            else:
                self.lists[r] = [at[low:high]]
                heapq.heappush(self.active, r)
            low = high

    def pop(self) -> tuple[int, np.ndarray]:
        r = heapq.heappop(self.active)
        parts = self.lists.pop(r)
        return r, parts[0] if len(parts) == 1 else np.concatenate(parts)


def _every_second(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of positions in order, each linked to the next of a run: the first, third, ... of every run."""
    if len(at) < 2:
        return at
    first = np.concatenate(([True], following[:-1] != at[1:]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - start) % 2 == 0]


def encode_pieces(pieces: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces in one array, and how many each piece has."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = int(lengths.sum())
    ends = np.cumsum(lengths)
    sym = np.append(v.byte_id[np.frombuffer(b"".join(pieces), np.uint8)], -1)  # n: no neighbour
    nxt = np.arange(1, n + 2)
    prv = np.arange(-1, n)
    full = lengths > 0
    nxt[ends[full] - 1] = n
    prv[(ends - lengths)[full]] = n
    nxt[n] = n
    prv = np.append(prv, n)

    def pair_ranks(at: np.ndarray) -> np.ndarray:
        other = sym[nxt[at]]
        return np.where(other < 0, -1, v.ranks(sym[at] << 32 | np.maximum(other, 0)))

    index = PairIndex()
    everywhere = np.arange(n)
    index.add(pair_ranks(everywhere), everywhere)
    while index.active:
        r, at = index.pop()
        a, b = v.left[r], v.right[r]
        at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
        if a == b:
            at = np.sort(at)
            at = _every_second(at, nxt[at])
        if not len(at):
            continue
        gone = nxt[at]
        beyond = nxt[gone]
        sym[at] = v.made[r]
        sym[gone] = -2
        nxt[at] = beyond
        prv[beyond] = at
        before = prv[at]
        changed = np.unique(np.concatenate((at, before[before != n])))
        index.add(pair_ranks(changed), changed)
    alive = sym[:n] >= 0
    counts = np.concatenate(([0], np.cumsum(alive)))
    return sym[:n][alive].astype(np.uint32), counts[ends] - counts[ends - lengths]


class Encoder:
    """Encodes texts block by block; remembers the ids of pieces that it has met."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.v = vocabulary(path)
        self.cut = regex.compile(PATTERN).findall
        self.unsettled = regex.compile(f"[^{SETTLED}]").search
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.added, key=len, reverse=True))) + ")") \
            if self.v.added else None
        self._splitter = None
        self.forget()

    def forget(self) -> None:
        self.known: dict = {}
        self.flat = np.empty(0, np.uint32)
        self.start = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)

    def _cut(self, text: str) -> list:
        if text.isascii() or not self.unsettled(text):
            return self.cut(text)
        if self._splitter is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._splitter = ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list:
        """The pieces of a text; an added token is a tuple that holds its id."""
        if self.special is None or not self.special.search(text):
            return self._cut(text)
        out: list = []
        for part in self.special.split(text):
            if part in self.v.added:
                out.append((self.v.added[part],))
            elif part:
                out.extend(self._cut(part))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.flat) > KNOWN_IDS:
            self.forget()
        known, new, numbered = self.known, [], []
        for t in texts:
            cut = self.pieces(t)
            for p in set(cut).difference(known):
                known[p] = len(known)
                new.append(p)
            numbered.append(np.fromiter(map(known.__getitem__, cut), np.int64, len(cut)))
        if new:
            ids, counts = encode_pieces([p.encode() for p in new if isinstance(p, str)], self.v)
            tokens = [p for p in new if not isinstance(p, str)]
            if tokens:  # added tokens: one id each, in their places
                plain = np.array([isinstance(p, str) for p in new])
                full = np.ones(len(new), np.int64)
                full[plain] = counts
                where = np.repeat(plain, full)
                merged = np.empty(len(where), np.uint32)
                merged[where], merged[~where] = ids, [p[0] for p in tokens]
                ids, counts = merged, full
            begin = len(self.flat) + np.concatenate(([0], np.cumsum(counts)[:-1]))
            self.flat = np.concatenate((self.flat, ids))
            self.start = np.concatenate((self.start, begin))
            self.count = np.concatenate((self.count, counts))
        return [_gather(self.flat, self.start[w], self.count[w]) for w in numbered]


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches (start, count) of ``flat``, one after the other."""
    total = int(count.sum())
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) if len(count) else np.empty(0, np.int64)
    return flat[shift + np.arange(total)]


def decode_ids(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of the ids, added tokens included; unknown ids give nothing, broken UTF-8 U+FFFD."""
    at = np.minimum(ids.astype(np.int64), len(v.length) - 1)
    return _gather(v.bytes, v.start[at], v.length[at]).tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """The ids of every whole text: the id column, n_tokens long, ids binary (packed).

    ``decoded`` adds the text that the ids give, from the same pass.
    """
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for part in arrow_rows(batches, "_text"):
            found = encoder.encode(part.column("_text").to_pylist())
            columns = {"_doc": part.column("_doc"), "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                       "ids": pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())}
            if decoded:
                columns["decoded"] = pa.array([decode_ids(x, encoder.v) for x in found], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    fields = [rows.schema["_doc"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))
    return rows.mapInArrow(work, T.StructType(fields)).withColumnRenamed("_doc", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of packed ids as ``out_col`` (a null gives the empty text); other columns stay."""
    if out_col in encoded.columns:
        raise ValueError(f"there is a column {out_col} already")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part in arrow_rows(batches, ids_col):
            texts = [decode_ids(np.frombuffer(x or b"", "<u4"), v) for x in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out_col])

    return encoded.mapInArrow(work, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))


def unpack(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Packed ids as an array of long."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_rows(batches, ids_col):
            lists = [None if x is None else np.frombuffer(x, "<u4").astype(np.int64) for x in part.column(ids_col).to_pylist()]
            k = part.schema.get_field_index(ids_col)
            columns = [pa.array(lists, pa.list_(pa.int64())) if j == k else c for j, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    fields = [T.StructField(f.name, T.ArrayType(T.LongType())) if f.name == ids_col else f for f in encoded.schema.fields]
    return encoded.mapInArrow(work, T.StructType(fields))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: id, n_tokens, ids_sha256, decoded_sha256."""
    both = encode(docs, path, id_col, text_col, decoded=True)
    return both.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
