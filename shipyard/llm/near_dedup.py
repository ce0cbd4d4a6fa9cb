"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is a weighted set of its five-word shingles (weight 1 + ln of the count). The
area above each element, weight across and rank upwards, is cut into unit regions;
each region holds a Poisson number of darts that depends on the element alone. The
darts of a text are those inside its weights and below a rank limit that makes their
number about the same for every text. A dart falls on one of ``k`` coordinates, and a
coordinate keeps its earliest dart: two texts share it with a probability equal to
their weighted Jaccard similarity. Bands of coordinates become bucket keys.

Classes are the connected components of the links (similarity >= 0.8, checked on whole
texts) among the texts that share a bucket. Not all pairs of a bucket are needed for
that: copies are first merged by hash, each text is then compared with the least
partner of its buckets, and after that only pairs that the links found so far leave
in different components are compared: first within blocks of a bucket, drawn anew each
time, where only the pairs go on that could join components; then every pair that is
left, whatever a bucket's size, so no link between components is lost. Signatures are
compared block by block inside the tasks, and only pairs that come close are sent on to
have their texts read. So a group of near copies costs pairs in proportion to its rows.
Texts that are nearly near (signatures cannot tell 0.75 from 0.8) would still be read in
pairs that grow with the square of their number; their binned weights bound the similarity
from above, and a pair whose bound is too low is no link and is not read.

Links that are found later lie between components, so only those few are joined again
and not all links. What is left of a graph is joined in one task once it has at most
``LAST_EDGES`` edges: each of the passes over it costs a task per partition, however
few rows there are. The second draw of blocks is left out where a draw would compare no
fewer pairs than are left in all.

Joins are sort-merge joins: a broadcast would take a side that grows with the corpus
through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize_table
from .textnp import WORD, Texts, U, mix, padded, span_keys

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Coordinates of a signature; the bands take the first half of them or less.
COORDINATES = 384
#: Two texts at the least similarity share no band once in so many cases.
MISSED = 16_000
#: Texts signed at a time: each throws about 3,000 darts, each dart some hundred bytes.
SIGN_BYTES, SIGN_ROWS = 1 << 20, 256
#: Members of a bucket that are compared with each other at a time.
BLOCK_MEMBERS = 256
#: Bins of a text's shingle weights, and their parts of a unit weight.
BINS, BIN_PARTS = 2048, 4
#: So many edges at most are joined in one task.
LAST_EDGES = 1 << 14


def banding(similarity: float) -> tuple[int, int]:
    """Bands, and coordinates in each: the longest bands with which half a signature
    misses one pair in ``MISSED`` at this similarity (32 of 6 at 0.8). Where none are
    that sure (below a similarity of about 0.05), all coordinates are bands of their own."""
    for rows in range(12, 0, -1):
        bands = math.ceil(-math.log(MISSED) / math.log(1 - similarity ** rows)) if similarity < 1 else 1
        if bands * rows <= COORDINATES // 2:
            return bands, rows
    return COORDINATES, 1


def least_agreement(similarity: float) -> float:
    """Pairs whose signatures agree less are not read: 4 standard deviations below the
    agreement expected at this similarity."""
    return similarity - 4 * math.sqrt(similarity * (1 - similarity) / COORDINATES)


# -- signatures --------------------------------------------------------------

#: P(at most n darts in a region), up to 12.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(13)])


def shingles(texts: Texts, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, key and count of each different shingle. Words are runs of letters and digits in
    lower case; a text of fewer words has them all as its one shingle."""
    doc, start, end = texts.spans(WORD)
    key = span_keys(padded(texts.buf, lower=True), start, end)
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    size = np.minimum(n, words)
    count = np.where(n > 0, n - size + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    made = np.zeros(len(owner), np.uint64)
    for k in range(words):
        live = np.flatnonzero(size[owner] > k)
        made[live] = mix((made[live] ^ key[at[live] + k]) + U(k + 1))
    bits = U((1 << 12) - 1)  # a block has fewer texts
    both, times = np.unique((made & ~bits) | owner.astype(np.uint64), return_counts=True)
    return (both & bits).astype(np.int64), both & ~bits, times


def dart_minhash(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """The rank of the earliest dart on each of ``k`` coordinates for each of ``n`` weighted
    sets; infinite for a set without elements."""
    out = np.full((n, k), np.inf)
    total = np.bincount(owner, weights=weight, minlength=n)
    strips = np.ceil(weight).astype(np.int64)
    element = np.repeat(np.arange(len(owner)), strips)
    strip = np.arange(len(element)) - np.repeat(np.cumsum(strips) - strips, strips)
    width = np.minimum(weight[element] - strip, 1.0)
    seed = mix(key[element] + U(0xD1B54A32D192ED03) * strip.astype(np.uint64))
    own = owner[element]
    darts = k * (math.log(k) + 2)
    todo = total > 0
    while todo.any():
        limit = np.where(todo, darts / np.maximum(total, 1e-300), 0)
        some = np.flatnonzero(todo[own])
        # unit regions [m, m + 1) of rank above each strip, up to the limit
        regions = np.ceil(limit[own[some]]).astype(np.int64)
        of = np.repeat(some, regions)
        m = np.arange(len(of)) - np.repeat(np.cumsum(regions) - regions, regions)
        region = mix(seed[of] ^ (U(0x9FB21C651E98DF25) * (m + 1).astype(np.uint64)))
        held = np.searchsorted(_POISSON, (region >> U(11)) * 2.0 ** -53, "right")
        which = np.repeat(np.arange(len(of)), held)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(held) - held, held)
        dart = mix(region[which] + U(0xA0761D6478BD642F) * (nth + 1).astype(np.uint64))
        rank = m[which] + (dart >> U(11)) * 2.0 ** -53
        of = of[which]
        place = mix(dart ^ U(0xE7037ED1A0B428DB))
        across = (place & U(0xFFFFFFFF)) * 2.0 ** -32
        inside = (rank < limit[own[of]]) & (across < width[of])
        cell = own[of[inside]] * k + ((place[inside] >> U(32)) * U(k) >> U(32)).astype(np.int64)
        np.minimum.at(out.reshape(-1), cell, rank[inside])
        todo &= ~np.isfinite(out).all(1)
        darts *= 2
    return out


def signatures(texts: Texts, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket keys (a row of ``bands``) and signature bytes of each text, and whether it has any."""
    owner, key, times = shingles(texts)
    ranks = dart_minhash(owner, key, 1 + np.log(times), len(texts), max(COORDINATES, bands * rows))
    some = np.isfinite(ranks).all(1)
    bits = mix(ranks.view(np.uint64).copy())
    parts = bits[:, :bands * rows].reshape(len(texts), bands, rows)
    bucket = mix(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(texts), bands)).copy())
    for r in range(rows):
        bucket = mix(bucket ^ parts[:, :, r])
    return bucket, (bits >> U(56)).astype(np.uint8), some


def similarities(a: Texts, b: Texts) -> np.ndarray:
    """Weighted Jaccard similarity of each text of ``a`` with its partner in ``b``
    (0 where either has no words)."""
    oa, ka, ta = shingles(a)
    ob, kb, tb = shingles(b)
    wa, wb = 1 + np.log(ta), 1 + np.log(tb)
    ua, ub = ka | oa.astype(np.uint64), kb | ob.astype(np.uint64)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    n = len(a)
    least = np.bincount(oa[ia], weights=np.minimum(wa[ia], wb[ib]), minlength=n)
    most = np.bincount(oa, weights=wa, minlength=n) + np.bincount(ob, weights=wb, minlength=n) - least
    return least / np.maximum(most, 1e-300)


def binned_weights(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Shingle weights of each text summed in ``BINS`` bins, rounded up to whole parts, and their total.

    The total is 0 where the bins do not hold (a sum beyond a byte): there is no bound for that text.
    """
    owner, key, times = shingles(texts)
    weight = 1 + np.log(times)
    place = owner * BINS + (mix(key) >> U(64 - BINS.bit_length() + 1)).astype(np.int64)
    # the slack is for sums that rounding has left below the true ones
    parts = np.ceil(np.bincount(place, weights=weight, minlength=len(texts) * BINS).reshape(-1, BINS) * BIN_PARTS - 1e-6)
    held = (parts <= 255).all(1)
    total = np.where(held, np.bincount(owner, weights=weight, minlength=len(texts)), 0.0)
    return np.minimum(parts, 255).astype(np.uint8), total


def may_link(bins: np.ndarray, total: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """False for pairs (x, y) of texts that are less similar for certain.

    Shingles that share a bin can only add to what two texts have in common, so the
    overlap of the bins is at least that of the texts.
    """
    common = np.minimum(bins[x], bins[y]).sum(1, dtype=np.int64) / BIN_PARTS
    known = (total[x] > 0) & (total[y] > 0)
    return ~known | (common >= (similarity - 1e-4) * (total[x] + total[y] - common))


def with_bins(bodies: DataFrame) -> DataFrame:
    """``bodies`` (id, text, buckets, sig) with bins and total of :func:`binned_weights`."""
    given = ["id", "text", "buckets", "sig"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, "text", SIGN_BYTES, SIGN_ROWS):
            bins, total = binned_weights(Texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in given), pa.array([r.tobytes() for r in bins], pa.binary()),
                 pa.array(total)], names=[*given, "bins", "total"])

    return bodies.select(*given).mapInArrow(
        work, "id long, text string, buckets array<long>, sig binary, bins binary, total double")


def signature_table(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``id``, ``hash``, ``buckets`` (null without words) and ``sig`` of each row of id, hash, text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, "text", SIGN_BYTES, SIGN_ROWS):
            bucket, sig, some = signatures(Texts(batch.column("text")), bands, rows)
            offsets = pa.array(np.arange(len(sig) + 1) * bands, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(bucket.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hash"),
                 pa.compute.if_else(pa.array(some), lists, pa.scalar(None, lists.type)),
                 pa.array([r.tobytes() for r in sig], pa.binary())], names=["id", "hash", "buckets", "sig"])

    return docs.mapInArrow(work, "id long, hash string, buckets array<long>, sig binary")


# -- links -------------------------------------------------------------------


def _join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def close(pairs: DataFrame, sigs: DataFrame, agreement: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree at least that much."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                           for c in ("sa", "sb"))
            ok = pa.array((left == right).mean(1) >= agreement)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    signed = _join(_join(pairs, sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a"),
                   sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return signed.select("a", "b", "sa", "sb").mapInArrow(near, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b, and other numbers) with ``link``: whether they are one, by their whole texts."""
    given = pairs.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, "ta", 1 << 20):
            s = similarities(Texts(batch.column("ta")), Texts(batch.column("tb")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), pa.array(s >= similarity - 1e-9)],
                                             names=[*given, "link"])

    full = _join(_join(pairs, texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a"),
                 texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return full.select(*given, "ta", "tb").mapInArrow(compare, "".join(f"{c} long, " for c in given) + "link boolean")


def _find(root: dict[int, int], x: int) -> int:
    while (up := root.setdefault(x, x)) != x:
        root[x] = x = root[up]
    return x


def _forest(edges: list[tuple[int, int]]) -> list[int]:
    """The places of the edges that join what the edges before them have not joined."""
    root: dict[int, int] = {}
    kept = []
    for k, (x, y) in enumerate(edges):
        x, y = _find(root, x), _find(root, y)
        if x != y:
            root[x] = y
            kept.append(k)
    return kept


def close_pairs(members: DataFrame, agreement: float, salt: int | None, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a > b, and their components ca, cb) of one bucket but different components whose signatures come close.

    ``members``: bucket, n (its members), top (the component that most of them are in),
    id, comp, buckets, sig, and bins and total if pairs that are less similar for certain
    are to be left out. With a ``salt`` a bucket is cut into blocks by a hash, pairs are
    compared within blocks, and only as many go on as could join the components of a
    block, those that agree best first. Without one all pairs are compared, each in one
    place: the members of ``top`` and the others are cut into blocks of their own, and a
    block meets all but those of the same side ``top``. A pair is given by its first
    common band only.
    """
    forest, binned = salt is not None, "bins" in members.columns
    if forest:
        blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
        own = F.pmod(F.xxhash64("id", F.lit(salt)), blocks).cast("int")
        spread = members.withColumn("block", own).withColumns({"low": F.col("block"), "high": F.col("block")})
    else:
        in_top = F.col("comp") == F.col("top")
        # blocks of the others come first, then those of the component that holds most
        rest = F.ceil(F.col("others") / BLOCK_MEMBERS).cast("int")
        main = F.ceil((F.col("n") - F.col("others")) / BLOCK_MEMBERS).cast("int")
        hashed = F.xxhash64("id")
        own = F.when(in_top, rest + F.pmod(hashed, main)).otherwise(F.pmod(hashed, rest)).cast("int")
        meets = F.when(in_top, rest).otherwise(rest + main) - 1
        spread = members.withColumn("block", own).where(meets >= 0).withColumn(
            "other", F.explode(F.sequence(F.lit(0), meets))).withColumns(
            {"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    met = spread.select("bucket", "low", "high", "block", "id", "comp", "buckets", "sig", *(["bins", "total"] if binned else [])).repartition(
        "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    def compare(table: pa.Table) -> pa.RecordBatch:
        bucket, low, high, block, node, comp = (table.column(c).to_numpy() for c in (
            "bucket", "low", "high", "block", "id", "comp"))
        bands = table.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(node), -1)
        if binned:
            bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(len(node), BINS)
            total = table.column("total").to_numpy()
        new = np.ones(len(node), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        starts = np.flatnonzero(new)
        end = np.repeat(np.append(starts[1:], len(node)), np.diff(np.append(starts, len(node))))
        later = end - np.arange(len(node)) - 1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        upto = np.cumsum(later)
        row = 0
        while row < len(node):
            stop = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + (1 << 17), "right")))
            left = np.repeat(np.arange(row, stop), later[row:stop])
            first = np.cumsum(later[row:stop]) - later[row:stop]
            right = left + 1 + np.arange(len(left)) - np.repeat(first, later[row:stop])
            ok = (comp[left] != comp[right]) & ((low[left] == high[left]) | (block[left] != block[right]))
            left, right = left[ok], right[ok]
            for k in range(0, len(left), 1 << 14):
                x, y = left[k:k + (1 << 14)], right[k:k + (1 << 14)]
                agree = (sigs[x] == sigs[y]).mean(1)
                near = agree >= agreement
                x, y, agree = x[near], y[near], agree[near]
                common = (bands[x] == bands[y]).argmax(1)
                once = bands[x, common] == bucket[x]
                x, y, agree = x[once], y[once], agree[once]
                if binned and len(x):
                    may = np.concatenate([may_link(bins, total, x[j:j + (1 << 11)], y[j:j + (1 << 11)], similarity)
                                          for j in range(0, len(x), 1 << 11)])
                    x, y, agree = x[may], y[may], agree[may]
                found.append((x, y, agree))
            row = stop
        x, y, agree = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
        if forest and len(x):
            group = np.cumsum(new)
            _, part = np.unique(np.stack([group, comp]), axis=1, return_inverse=True)  # a component within a group
            best = np.argsort(-agree, kind="stable")
            kept = best[_forest(list(zip(part[x[best]].tolist(), part[y[best]].tolist())))]
            x, y = x[kept], y[kept]
        x, y = np.where(node[x] > node[y], x, y), np.where(node[x] > node[y], y, x)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (node[x], node[y], comp[x], comp[y])], names=["a", "b", "ca", "cb"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 4 * BLOCK_MEMBERS:
                continue
            # all but the last group, which may go on in the next batch
            keys = [held.column(c).to_numpy() for c in ("bucket", "low", "high")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = held.num_rows - int(same[::-1].argmin() if not same.all() else len(same))
            if cut:
                yield compare(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield compare(held.combine_chunks())

    return met.mapInArrow(work, "a long, b long, ca long, cb long")


def _joined(edges: DataFrame) -> DataFrame:
    """:func:`components` of at most ``LAST_EDGES`` edges, in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = _find(root, a), _find(root, b)
                root[max(a, b)] = min(a, b)
        ids = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_find(root, x) for x in ids], pa.int64())],
                                         names=["id", "comp"])

    return materialize_table(edges.select("a", "b").where("a <> b").repartition(1).mapInArrow(work, "id long, comp long"))


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``comp`` (the least id it is connected with) for every node of ``edges`` (a, b).

    Alternates two steps until nothing changes: every larger neighbour of a node is
    linked to the node's least neighbour, then every smaller one. Each step is a
    minimum per node and a join, so a node with many neighbours is no single group.
    At most ``LAST_EDGES`` edges are joined in one task.
    """
    if edges.count() <= LAST_EDGES:
        return _joined(edges)
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = materialize_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    was = mark(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _join(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _join(large, least, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = materialize_table(small.select("e.*").where("a <> b").distinct())
        then, was = was, mark(now)
        if then == was:
            break
        if was[0] <= LAST_EDGES:
            return _joined(now)
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(roots)


def _body(text: str):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept.

    ``class_id`` is the least id of the row's class and ``kept`` marks the rows that bear
    it. Equal texts are one class, texts without a word too if they are equal (null
    counts as empty); other texts without words are linked to nothing. Rows with the
    same id are one document. Rows without an id stay alone, with a null class of size
    1, and are kept. An empty table gives no rows. Other columns are ignored.
    """
    return _classes(docs, doc_id, text, similarity, True).drop("hash")


def _classes(docs: DataFrame, doc_id: str, text: str, similarity: float, one_document: bool) -> DataFrame:
    """:func:`near_classes` with each row's text hash; only with ``one_document`` does an id link its texts."""
    body = _body(text)
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.md5(body.cast("binary")).alias("hash"),
                       F.lower(body).alias("text"))
    agreement = least_agreement(similarity)
    signed = signature_table(base.where("id IS NOT NULL"), *banding(similarity))
    # Copies: one row per text goes on. Equal texts have equal signatures.
    texts = signed.groupBy("hash").agg(
        F.min("id").alias("doc"), F.first("buckets").alias("buckets"), F.first("sig").alias("sig"))
    # A text goes by its least id, or by its hash where that id bears other texts too.
    bearers = base.where("id IS NOT NULL").select(F.col("id").alias("doc"), "hash")
    several = materialize_table(bearers.groupBy("doc").agg(F.min("hash").alias("one"), F.max("hash").alias("two")).where(
        "one < two").select("doc"))
    node = F.when(F.col("_several").isNull(), F.col("doc")).otherwise(F.xxhash64("hash"))
    texts = materialize_table(_join(texts, several.select("doc", F.lit(1).alias("_several")), "doc", "left").withColumn(
        "id", node).drop("_several"))
    of_one = several.limit(0).select(F.col("doc").alias("a"), F.col("doc").alias("b"))
    if one_document:
        borne = _join(_join(bearers, several, "doc"), texts.select("hash", "id"), "hash").select("doc", "id")
        least = borne.groupBy("doc").agg(F.min("id").alias("b"))
        of_one = materialize_table(_join(borne, least, "doc").select(F.col("id").alias("a"), "b").where("a <> b").distinct())

    members = texts.where("buckets IS NOT NULL").select("id", F.explode(F.array_distinct("buckets")).alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("other")).where("head < other")
    shared = materialize_table(_join(members, heads.select("bucket", "head"), "bucket"))
    involved = _join(shared.select("id").distinct(), texts.select("id", "doc", "hash", "buckets", "sig"), "id").select(
        F.col("id").alias("node"), F.col("doc").alias("id"), "hash", "buckets", "sig")
    bodies = materialize_table(with_bins(_join(base, involved, ["id", "hash"]).groupBy("node").agg(
        F.min("text").alias("text"), F.first("buckets").alias("buckets"), F.first("sig").alias("sig")).withColumnRenamed("node", "id")))
    signed_members = bodies.select("id", "buckets", "sig", "bins", "total")

    # Each text against the least partner of all its buckets.
    first = shared.groupBy(F.col("id").alias("a")).agg(F.min("head").alias("b")).where("b < a")
    tried = materialize_table(verified(close(first, bodies.select("id", "sig"), agreement), bodies, similarity))
    found = components(tried.where("link").select("a", "b").unionByName(of_one))
    single = _join(bodies.select("id", F.col("id").alias("comp")), found.select("id"), "id", "left_anti")
    comps = materialize_table(found.unionByName(single))
    tried = tried.select("a", "b")
    for salt in (1, 2, None):
        # Pairs that the links so far leave in different components: the likeliest first, then all.
        placed = _join(shared, comps, "id").select("bucket", "id", "comp")
        sizes = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"))
        most = F.max(F.struct("m", "comp"))
        mixed = sizes.groupBy("bucket").agg(F.sum("m").alias("n"), most["m"].alias("m"), most["comp"].alias("top")).where(
            "m < n").select("bucket", "n", (F.col("n") - F.col("m")).alias("others"), "top")
        if salt == 2:
            mixed = materialize_table(mixed)
            rows, left = mixed.agg(F.sum("n"), F.sum(F.col("others").cast("double") * F.col("n"))).first()
            if not rows:
                break
            if left <= BLOCK_MEMBERS * rows:
                salt = None
        rest = _join(_join(placed, mixed, "bucket"), signed_members, "id")
        # a pair is found once, in the bucket of its first common band
        pairs = _join(close_pairs(rest, agreement, salt, similarity), tried, ["a", "b"], "left_anti").select("a", "b", "ca", "cb")
        judged = materialize_table(verified(pairs, bodies, similarity))
        tried = tried.unionByName(judged.select("a", "b"))
        links = judged.where("link").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        if not links.isEmpty():
            moved = components(links).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
            comps = materialize_table(_join(comps, moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
        if salt is None:
            break

    copies = base.where("id IS NOT NULL").select("id", "hash")
    of_text = _join(texts.select("hash", "doc", "id"), comps, "id", "left").select("hash", "doc", F.coalesce("comp", "id").alias("comp"))
    heads = of_text.groupBy("comp").agg(F.min("doc").alias("class_id"))
    texts_class = _join(of_text, heads, "comp").select("hash", "comp", "class_id")
    classed = _join(copies, texts_class, "hash").select(F.col("id").alias("doc_id"), "hash", "comp", "class_id")
    sizes = classed.groupBy("comp").agg(F.count(F.lit(1)).alias("class_size"))
    known = _join(classed, sizes, "comp").select("doc_id", "hash", "class_id", "class_size",
                                               (F.col("doc_id") == F.col("class_id")).alias("kept"))
    alone = base.where("id IS NULL").select(F.col("id").alias("doc_id"), "hash", F.col("id").alias("class_id"),
                                            F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return known.unionByName(alone)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies: of each class the document with the least id stays,
    with all its columns. Of rows with the same id each goes by its own text."""
    classes = _classes(docs, doc_id, text, SIMILARITY, False)
    gone = classes.where("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("hash").alias("_hash")).distinct()
    return docs.join(gone.hint("merge"), (docs[doc_id] == gone["_gone"]) & (F.md5(_body(text).cast("binary")) == gone["_hash"]), "left_anti")
