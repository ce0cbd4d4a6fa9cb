"""Removal of byte strings that already start in an earlier document, by suffix sorting.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a
smaller id goes. Comparing all suffixes of a corpus at once would move each text dozens
of times, so the suffixes are first brought together by anchors:

1. Each ``LENGTH``-byte window names as its anchor the ``GRAM``-byte string in it with
   the least hash (the leftmost of equals). Equal windows have equal anchors, and
   consecutive windows mostly share one. Anchors are exchanged as packed hashes; those that
   occur in one row of the table only are done with.
2. The stretch of text that an anchor's windows cover is exchanged, whole and byte by
   byte, for the anchors left. All suffixes of a stretch that hold a full window are
   sorted, eight bytes a symbol, to ``SHALLOW`` bytes; the groups with longer common
   prefixes are then split at the first symbol where they branch. (That symbol is found by
   reading a group's symbols, not from the nodes of a blind trie.) Windows equal over their whole length end up in one class,
   and its least document id decides.
3. The marked intervals go back to their texts.

Exact copies of an earlier text are found by their sha256 and marked as a whole. What a
task finds repeated among its own texts is settled there, and only one representative
is sent on, so a passage that very many texts share arrives once per task. (Where the
texts differ around it, the stretches at its two ends differ as well and are all sent.)

An anchor that very many texts hold would bring all their stretches to one task. Anchors
are counted first, and the stretches of hot ones are cut into their windows, which meet by
the hash of their own ``LENGTH`` bytes instead: equal windows still meet, the others go
to many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows
from .textnp import Texts, U, mix, padded, span_keys, words64

LENGTH = 50
GRAM = 20
SHALLOW = 16
#: Text bytes searched for anchors at a time.
SEARCH_BYTES = 1 << 20
#: Keys, and stretches, that a task gathers before it sends them on.
ASK_KEYS, CUT_STRETCHES = 1 << 20, 1 << 18
#: Windows sorted at a time (a key with more is taken whole).
SORT_WINDOWS = 400_000
#: An anchor with more stretches is hot; below ``HOT_LOCAL`` in ``ASK_KEYS`` of them it is not counted.
HOT_STRETCHES, HOT_LOCAL = 4096, 8
NO_ID = (1 << 63) - 1

# -- anchors -----------------------------------------------------------------


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (8 to 24) bytes from each position of a padded buffer.
    Positions whose gram would end behind the text are not meaningful."""
    at8 = words64(np.concatenate([buf, np.zeros(32, np.uint8)]))
    n = len(buf) - 16
    h = at8[:n] * U(0x9E3779B97F4A7C15)
    k = 8
    for c in (U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)):
        if k >= gram:
            break
        at = min(k, gram - 8)
        h ^= h >> U(29)
        h += at8[at:at + n]
        h *= c
        k = at + 8
    return mix(h)


def stretches(texts: Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The anchors of all windows: text, key (hash of the anchor), first and last window start
    of each run of windows with one anchor (positions in the buffer)."""
    n = len(texts.buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, np.zeros(0, np.uint64), none, none
    h = gram_hashes(padded(texts.buf), gram)
    order = (h & ~U(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    width, span = length - gram + 1, 1
    low = order
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:n - width + 1], low[width - span:width - span + n - width + 1])
    anchor = (low[:n - length + 1] & U(0xFFFFFFFF)).astype(np.int64)
    own = texts.owner()
    whole = own[:n - length + 1] == own[length - 1:]
    start = np.flatnonzero(whole)
    if not len(start):
        return none, np.zeros(0, np.uint64), none, none
    a, o = anchor[start], own[start]
    new = np.ones(len(start), bool)
    new[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return o[first].astype(np.int64), h[a[first]], start[first], start[last]


def _index_in_text(doc: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of equal values."""
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    return np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def _once(row: np.ndarray, place: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """``columns`` at one of the entries for each (row, place): rows that repeat id and text share both."""
    order = np.lexsort((place, row))
    r, p = row[order], place[order]
    first = np.ones(len(order), bool)
    first[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    keep = np.sort(order[first])
    return [c[keep] for c in columns]


def _repeated(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by key, the starts of its groups, and which groups hold different rows."""
    order = np.argsort(key, kind="stable")
    starts = _groups(key[order])
    if not len(starts):
        return order, starts, np.zeros(0, bool)
    r = row[order]
    return order, starts, np.minimum.reduceat(r, starts) != np.maximum.reduceat(r, starts)


# -- suffix sorting ----------------------------------------------------------


def _big_endian(at8: np.ndarray, at: np.ndarray) -> np.ndarray:
    return at8[at].byteswap()


def _refine(order: np.ndarray, starts: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts within groups by ``symbol`` (given in ``order``) and splits them where it differs."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    by = np.lexsort((symbol, group))
    symbol = symbol[by]
    new = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])])
    return order[by], np.flatnonzero(new)


def sort_windows(buf: np.ndarray, at: np.ndarray, length: int = LENGTH,
                 shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``at`` by their first ``length`` bytes, and the starts of
    the classes of equal ones. ``buf`` comes from :func:`padded`."""
    at8 = words64(buf)
    places = [min(d, length - 8) for d in range(0, length, 8)]
    # Shallow: multikey quicksort with symbols of eight bytes, groups of one left alone.
    first = _big_endian(at8, at)
    order = np.argsort(first, kind="stable")
    starts = _groups(first[order])
    deep = [p for p in places if p >= shallow]
    for p in places[1:len(places) - len(deep)]:
        order, starts = _step(at8, at, order, starts, lambda live, p=p: np.full(len(live), p))
    # Deep: a group is split at the first symbol at which it branches.
    while True:
        sizes = np.diff(np.append(starts, len(order)))
        big = np.flatnonzero(sizes > 1)
        if not len(big):
            return order, starts
        inside = np.repeat(sizes > 1, sizes)
        live = order[inside]
        heads = np.cumsum(sizes[big]) - sizes[big]
        branch = np.full(len(big), -1)
        for p in reversed(deep):
            s = _big_endian(at8, at[live] + p)
            differs = np.minimum.reduceat(s, heads) != np.maximum.reduceat(s, heads)
            branch[differs] = p
        if (branch < 0).all():
            return order, starts
        at_place = np.repeat(np.maximum(branch, 0), sizes[big])
        order, starts = _step(at8, at, order, starts, lambda live, w=at_place: w)


def _step(at8, at, order, starts, place):
    sizes = np.diff(np.append(starts, len(order)))
    inside = np.repeat(sizes > 1, sizes)
    live = order[inside]
    if not len(live):
        return order, starts
    big = sizes[sizes > 1]
    sub, sub_starts = _refine(live, np.cumsum(big) - big, _big_endian(at8, at[live] + place(live)))
    places = np.flatnonzero(inside)
    order = order.copy()
    order[places] = sub
    new = np.zeros(len(order), bool)
    new[starts] = True
    new[places[sub_starts]] = True
    return order, np.flatnonzero(new)


def earlier_windows(strings: Texts, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``strings`` that also occur in a string of a smaller ``doc``:
    string, first byte, end (relative to the string)."""
    count = np.maximum(strings.lengths - length + 1, 0)
    owner = np.repeat(np.arange(len(strings)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = strings.starts[owner] + inner
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    order, starts = sort_windows(padded(strings.buf), at, length)
    least = np.minimum.reduceat(doc[owner[order]], starts)
    earlier = np.zeros(len(at), bool)
    earlier[order] = np.repeat(least, np.diff(np.append(starts, len(order)))) < doc[owner[order]]
    some = np.flatnonzero(earlier)
    if not len(some):
        none = np.zeros(0, np.int64)
        return none, none, none
    new = np.concatenate([[True], (np.diff(some) > 1) | (owner[some[1:]] != owner[some[:-1]])])
    first, last = some[new], some[np.append(np.flatnonzero(new)[1:], len(some)) - 1]
    return owner[first], inner[first], inner[last] + length


# -- the job -----------------------------------------------------------------


def _route(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = mix(out ^ p.astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def _runs_of(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted row hashes as the different ones and how often each occurs."""
    starts = _groups(rows)
    return rows[starts].tobytes(), np.diff(np.append(starts, len(rows))).astype("<u4").tobytes()


def _planes(values: np.ndarray) -> bytes:
    """Integers byte by byte, all lowest bytes first: planes of equal bytes compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(raw: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def _rows_from(rows: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(rows, np.int64), np.frombuffer(counts, "<u4"))


_NOT_WANTED = 0xFFFFFFFF  # the asking row needs no answer
_ASK = "route int, keys binary, rows binary, counts binary, idx binary, known_rows binary, known_counts binary, known_idx binary"


def _steps(values: np.ndarray) -> bytes:
    """Differences of consecutive numbers (modulo 2 ** 32), in planes."""
    v = values.astype("<u4")
    return _planes(np.diff(v, prepend=np.zeros(1, "<u4")))


def _from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, "<u4"), dtype="<u4")


def _ask_anchors(parts: int):
    """Per task: which keys occur, for each of ``parts`` routes as one packed row. What the
    task itself finds in several rows of the table is sent as known, spread over the routes,
    and one row asks for the key."""
    names = [f.split()[0] for f in _ASK.split(", ")]

    def send(key: np.ndarray, row: np.ndarray, idx: np.ndarray) -> pa.RecordBatch:
        key, row, idx = _once(row, idx, key, row, idx)
        order, starts, many = _repeated(key, row)
        sizes = np.diff(np.append(starts, len(order)))
        settled = order[np.repeat(many, sizes)]
        ask = order[starts]
        wanted = np.where(many, _NOT_WANTED, idx[ask])
        more = np.ones(len(order), bool)  # repeats within one row follow the first
        more[starts] = False
        more = order[more & ~np.repeat(many, sizes)]
        ask, wanted = np.concatenate([ask, more]), np.concatenate([wanted, idx[more]]).astype("<u4")
        route = (key[ask] % U(parts)).astype(np.int64)
        by = np.lexsort((wanted, row[ask], route))
        ask, wanted, route = ask[by], wanted[by], route[by]
        other = (_route(row[settled], idx[settled]).view(np.uint64) % U(parts)).astype(np.int64)
        by = np.lexsort((idx[settled], row[settled], other))
        settled, other = settled[by], other[by]
        out = {n: [] for n in names}
        bounds, known = np.searchsorted(route, np.arange(parts + 1)), np.searchsorted(other, np.arange(parts + 1))
        for r in range(parts):
            a, k = slice(bounds[r], bounds[r + 1]), slice(known[r], known[r + 1])
            if a.start == a.stop and k.start == k.stop:
                continue
            hashed = key[ask[a]] // U(parts)  # 32 of the bits that the route leaves
            rows, counts = _runs_of(row[ask[a]])
            known_rows, known_counts = _runs_of(row[settled[k]])
            values = (r, hashed.astype("<u4").tobytes(), rows, counts, _steps(wanted[a]), known_rows, known_counts,
                      _steps(idx[settled[k]]))
            for n, v in zip(names, values):
                out[n].append(v)
        types = [pa.int32()] + [pa.binary()] * (len(names) - 1)
        return pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names=names)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in arrow_rows(batches, "text", SEARCH_BYTES):
            doc, key, _, _ = stretches(Texts(batch.column("text")))
            if len(doc):
                held.append((key, batch.column("row").to_numpy()[doc], _index_in_text(doc)))
                size += len(doc)
            if size >= ASK_KEYS:
                yield send(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if held:
            yield send(*(np.concatenate(x) for x in zip(*held)))

    return ask_anchors


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the keys that many stretches have, and how many."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        some = n >= HOT_LOCAL
        return pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(n[some])], names=["key", "n"])

    held, size = [], 0
    for batch in arrow_rows(batches, "text", SEARCH_BYTES):
        held.append(stretches(Texts(batch.column("text")))[1])
        size += len(held[-1])
        if size >= ASK_KEYS:
            yield counted(held)
            held, size = [], 0
    if held:
        yield counted(held)


def hot_anchors(base: DataFrame, least: int) -> np.ndarray:
    """The keys with more than ``least`` stretches, sorted: one in ``least`` stretches at most."""
    counts = base.select("text").mapInArrow(_count_anchors, "key long, n long")
    hot = counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("key").toArrow()
    return np.sort(hot.column("key").to_numpy().view(np.uint64))


def _among(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of ``key`` are in the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(key), bool)
    return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One route: the keys that occur in several rows, as (row, index of the key in it)."""
    keys, rows, idx, known_rows, known_idx = ([np.zeros(0, d)] for d in ("<u8", "<i8", "<u4", "<i8", "<u4"))
    for batch in batches:
        for r in batch.to_pylist():
            keys.append(np.frombuffer(r["keys"], "<u4").astype(np.uint64) | U(r["route"]) << U(32))
            rows.append(_rows_from(r["rows"], r["counts"]))
            idx.append(_from_steps(r["idx"]))
            known_rows.append(_rows_from(r["known_rows"], r["known_counts"]))
            known_idx.append(_from_steps(r["known_idx"]))
    key, row, index = np.concatenate(keys), np.concatenate(rows), np.concatenate(idx)
    order, starts, many = _repeated(key, row)
    found = order[np.repeat(many, np.diff(np.append(starts, len(order))))]
    found = found[index[found] != _NOT_WANTED]
    row = np.concatenate([row[found], *known_rows])
    index = np.concatenate([index[found], *known_idx])
    index = index.astype(np.int32)
    for k in range(0, len(row), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(row[k:k + (1 << 16)]), pa.array(index[k:k + (1 << 16)])], names=["row", "idx"])


_CUT = ("route int, keys binary, rows binary, docs binary, counts binary, at binary, size binary, text binary, "
        "known_rows binary, known_docs binary, known_counts binary, known_at binary, known_size binary")


def _cut_stretches(parts: int, hot: np.ndarray):
    """The wanted stretches of each text, for each of ``parts`` routes as one packed row. Those
    of ``hot`` anchors are cut into windows."""
    names = [f.split()[0] for f in _CUT.split(", ")]

    def packed(row: np.ndarray, doc: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[bytes, ...]:
        starts = _groups(row)
        counts = np.diff(np.append(starts, len(row))).astype("<u4")
        return row[starts].tobytes(), doc[starts].tobytes(), counts.tobytes(), _steps(at), size.astype(np.uint8).tobytes()

    def repeats(doc, place, size, raw: bytes, same) -> np.ndarray:
        """Which strings equal one of a smaller document, by ``same``, their hashes."""
        order = np.lexsort((doc, same))
        starts = _groups(same[order])
        head = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
        later = np.flatnonzero(doc[order] > doc[head])
        equal = [raw[a:a + n] == raw[b:b + m] for a, n, b, m in zip(
            *(x.tolist() for i in (order[later], head[later]) for x in (place[i], size[i])))]
        out = np.zeros(len(doc), bool)
        out[order[later[np.array(equal, bool)]]] = True
        return out

    def send(key, doc, row, at, size, place, raw: bytes) -> Iterator[pa.RecordBatch]:
        buf = padded(np.frombuffer(raw, np.uint8))
        key, doc, row, at, size, place = _once(row, at, key, doc, row, at, size, place)
        # Equal stretches: the least document asks for all, the others are marked.
        gone = repeats(doc, place, size, raw, span_keys(buf, place, place + size))
        cut = ~gone & _among(hot, key)
        yield sent(*(x[~cut] for x in (key, doc, row, at, size, place, gone)), raw)
        # And so do equal windows of hot anchors, under keys of their own.
        cut = np.flatnonzero(cut)
        cut = cut[np.argsort(key[cut], kind="stable")]
        block = np.cumsum(size[cut] - LENGTH + 1) // SORT_WINDOWS
        for some in np.split(cut, np.flatnonzero(np.diff(block)) + 1) if len(cut) else ():
            count = size[some] - LENGTH + 1
            owner = np.repeat(some, count)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            where, wide = place[owner] + inner, np.full(len(owner), LENGTH)
            windows = span_keys(buf, where, where + LENGTH)
            yield sent(windows, doc[owner], row[owner], at[owner] + inner, wide, where,
                       repeats(doc[owner], where, wide, raw, windows), raw)

    def sent(key, doc, row, at, size, place, gone, raw: bytes) -> pa.RecordBatch:
        marked, ask = np.flatnonzero(gone), np.flatnonzero(~gone)
        route = (key[ask] % U(parts)).astype(np.int64)
        by = np.lexsort((at[ask], row[ask], route))
        ask, route = ask[by], route[by]
        other = (_route(row[marked], at[marked]).view(np.uint64) % U(parts)).astype(np.int64)
        by = np.lexsort((at[marked], row[marked], other))
        marked, other = marked[by], other[by]
        bounds, known = np.searchsorted(route, np.arange(parts + 1)), np.searchsorted(other, np.arange(parts + 1))
        out = {n: [] for n in names}
        for r in range(parts):
            a, k = ask[bounds[r]:bounds[r + 1]], marked[known[r]:known[r + 1]]
            if not len(a) and not len(k):
                continue
            text = b"".join([raw[p:p + n] for p, n in zip(place[a].tolist(), size[a].tolist())])
            # Keys only bring stretches together: 32 of the bits that the route leaves are enough.
            values = (r, (key[a] // U(parts)).astype("<u4").tobytes(), *packed(row[a], doc[a], at[a], size[a]), text,
                      *packed(row[k], doc[k], at[k], size[k]))
            for n, v in zip(names, values):
                out[n].append(v)
        types = [pa.int32()] + [pa.binary()] * (len(names) - 1)
        return pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names=names)

    def cut_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts_held, size_held, count = [], [], 0, 0
        for batch in arrow_rows(batches, "text", SEARCH_BYTES):
            texts = Texts(batch.column("text"))
            doc, key, first, last = stretches(texts)
            lists = batch.column("anchors")
            wanted = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy())
            wanted = np.unique(wanted.astype(np.int64) << 32 | lists.flatten().to_numpy().astype(np.int64))
            pick = np.flatnonzero(np.isin(doc << 32 | _index_in_text(doc), wanted, assume_unique=True))
            if not len(pick):
                continue
            doc, first, size = doc[pick], first[pick], last[pick] + LENGTH - first[pick]
            held.append((key[pick], batch.column("doc").to_numpy()[doc], batch.column("row").to_numpy()[doc],
                         first - texts.starts[doc], size, first + size_held))
            texts_held.append(texts.buf.tobytes())
            size_held += len(texts.buf)
            count += len(pick)
            if count >= CUT_STRETCHES:
                yield from send(*(np.concatenate(x) for x in zip(*held)), b"".join(texts_held))
                held, texts_held, size_held, count = [], [], 0, 0
        if held:
            yield from send(*(np.concatenate(x) for x in zip(*held)), b"".join(texts_held))

    return cut_stretches


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One route of stretches: those with one key meet here."""

    def out(r, d, a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(r), pa.array(d), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["row", "doc", "at", "end"])

    def unpacked(r: dict, known: str) -> tuple[np.ndarray, ...]:
        counts = np.frombuffer(r[known + "counts"], "<u4")
        row, doc = (np.repeat(np.frombuffer(r[known + c], "<i8"), counts) for c in ("rows", "docs"))
        return row, doc, _from_steps(r[known + "at"]).astype(np.int64), np.frombuffer(r[known + "size"], np.uint8).astype(np.int64)

    held, keys, raw = [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            row, doc, at, size = unpacked(r, "known_")
            if len(row):
                yield out(row, doc, at, at + size)
            held.append(unpacked(r, ""))
            keys.append(np.frombuffer(r["keys"], "<u4"))
            raw.append(r["text"])
    if not held:
        return
    row, doc, at, size = (np.concatenate(x) for x in zip(*held))
    key, raw = np.concatenate(keys), b"".join(raw)
    offsets = np.concatenate([[0], np.cumsum(size)])
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    order = np.argsort(key, kind="stable")
    starts = _groups(key[order])
    upto = np.concatenate([[0], np.cumsum((size - LENGTH + 1)[order])])
    bounds, low = np.append(starts, len(order)), 0
    while low < len(starts):
        # as many whole keys as make up a block of windows
        high = max(low + 1, int(np.searchsorted(upto[bounds], upto[bounds[low]] + SORT_WINDOWS, "right")) - 1)
        part = order[bounds[low]:bounds[high]]
        string, a, b = earlier_windows(Texts(text.take(pa.array(part))), doc[part])
        part = part[string]
        if len(part):
            yield out(row[part], doc[part], at[part] + a, at[part] + b)
        low = high


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_rows(batches, "text"):
        texts = Texts(batch.column("text"))
        raw = texts.buf.tobytes()
        out = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for doc, low, high, marks in zip(batch.column("doc").to_pylist(), texts.starts.tolist(), texts.ends.tolist(),
                                         batch.column("marks").to_pylist()):
            spans: list[list[int]] = []
            for m in sorted((m["at"], min(m["end"], high - low)) for m in marks or () if m["doc"] == doc):
                if spans and m[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], m[1])
                else:
                    spans.append(list(m))
            kept, at = hashlib.sha256(), low
            for a, b in spans:
                kept.update(raw[at:low + a])
                at = low + b
            kept.update(raw[at:high])
            out["n_bytes"].append(high - low)
            out["n_removed"].append(sum(b - a for a, b in spans))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, list) else v for v in out.values()], names=list(out))


def _base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"),
                       F.xxhash64("doc_id", "text").alias("row"), "text")


def marked_bytes(base: DataFrame) -> DataFrame:
    """``row``, ``doc``, ``at``, ``end``: the intervals to remove (they may overlap)."""
    digests = base.select("row", "doc", F.sha2(F.col("text").cast("binary"), 256).alias("hash"),
                          F.octet_length("text").alias("size"))
    firsts = digests.where(F.col("size") >= LENGTH).groupBy("hash").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    copies = digests.join(firsts, "hash").where("doc > first").select("row", "doc", "size").distinct()

    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Copies need no look at their strings: what they hold, an earlier text holds.
    others = base.join(copies.select("row").distinct(), "row", "left_anti").select("row", "doc_id", "doc", "text")
    asked = others.mapInArrow(_ask_anchors(parts), _ASK)
    anchors = asked.repartitionById(parts, F.col("route")).mapInArrow(_answer_anchors, "row long, idx int")
    lists = anchors.groupBy("row").agg(F.collect_set("idx").alias("anchors"))
    hot = hot_anchors(others, HOT_STRETCHES)
    cut = base.join(lists, "row").select("row", "doc_id", "doc", "text", "anchors").mapInArrow(
        _cut_stretches(parts, hot), _CUT)
    marks = cut.repartitionById(parts, F.col("route")).mapInArrow(_mark, "row long, doc long, at int, end int")
    return marks.unionByName(copies.select("row", "doc", F.lit(0).alias("at"), F.col("size").cast("int").alias("end")))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty. Strings never cross rows. Rows with the same id have no order
    among them, so none of their strings goes for another's sake; rows without an id
    come after all others. Texts under ``LENGTH`` bytes stay whole. An empty table gives
    no rows; other columns are ignored.
    """
    base = _base(docs, doc_id, text)
    marks = marked_bytes(base).groupBy("row").agg(F.collect_set(F.struct("doc", "at", "end")).alias("marks"))
    return base.join(marks, "row", "left").select("row", "doc_id", "doc", "text", "marks").mapInArrow(
        _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
