"""SimHash near-duplicate groups with bit-sliced comparison.

A document's fingerprint has 128 bits: bit b is the majority of bit b over the hashes of all its word pairs, counted by a
carry-save tree. Candidates share one of KEYS minimum hashes of word triples; a block of candidates is compared by bit
planes: plane b holds bit b of 64 documents in a machine word, so one operation updates 64 distances, and words of lanes
are abandoned once all their distances exceed the radius. Groups are the connected components of the pairs within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import checkpointed, components, unused

BITS = 128
#: Bits in which near copies may differ. Copies with up to 10 % of their words changed differ in 35 or fewer; other texts in 45 or more.
RADIUS = 34
KEYS = 6
#: Planes that are added before the next look at which lanes are still within the radius.
STEP = 32
ROWS = 200_000
#: Rows of one candidate key that are compared in one block. A key with more is split, and all pairs of its parts are blocks.
BLOCK_ROWS = 1 << 15


def _triples(items: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One layer of full adders within each segment: sums, carries, and how many of either each segment has."""
    first = np.cumsum(counts) - counts
    made = (counts + 2) // 3
    padded = np.zeros(int(made.sum()) * 3, np.uint64)
    padded[words.ranges(3 * (np.cumsum(made) - made), counts)] = items[words.ranges(first, counts)]
    a, b, c = padded[0::3], padded[1::3], padded[2::3]
    half = a ^ b
    return half ^ c, (a & b) | (half & c), made


def majority(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each segment of 64-bit items, the bits that at least half of its items have set; every segment has an item."""
    ones = np.zeros((len(counts), 64), np.int64)
    for level in range(int(counts.max()).bit_length()):
        carries = []
        size = counts if level == 0 else sizes
        while size.max() > 1:
            items, carry, made = _triples(items, size)
            carries.append((carry, made))
            size = made
        ones += np.unpackbits(items.view(np.uint8)).reshape(-1, 64).astype(np.int64) << level
        if not carries:
            break
        sizes = sum(made for _, made in carries)
        at = np.cumsum(sizes) - sizes
        items = np.empty(int(sizes.sum()), np.uint64)
        for carry, made in carries:
            items[words.ranges(at, made)] = carry
            at = at + made
    return np.packbits(2 * ones >= counts[:, None], axis=1).view(np.uint64)[:, 0]


def fingerprints(seg: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that have words, their fingerprints as [text, 2] words, and their [text, KEYS] candidate keys."""
    w = words.plain(seg, bounds)
    counts = w.counts
    live = np.flatnonzero(counts)
    if not len(live):
        return live, np.zeros((0, 2), np.uint64), np.zeros((0, KEYS), np.uint64)
    h = words.hashes(w.seg, w.start, w.end)
    n, first = counts[live], w.first[:-1][live]

    def gram(k: int) -> tuple[np.ndarray, np.ndarray]:
        some = np.maximum(n - k + 1, 1)
        out = words.grams(h, k)[words.ranges(first, some)]
        if (n < k).any():  # too short for a gram: all its words, whatever their number
            short = np.flatnonzero(n < k)
            at = np.cumsum(some) - some
            sums = np.add.reduceat(h, first)[short] if len(first) else h[:0]
            out[at[short]] = words.mix(sums + n[short].astype(np.uint64))
        return out, some

    pairs, some = gram(2)
    prints = np.stack([majority(pairs, some), majority(words.mix(pairs + np.uint64(77)), some)], axis=1)
    triples, some = gram(3)
    at = np.cumsum(some) - some
    keys = np.stack([np.minimum.reduceat(words.mix(triples + np.uint64(1 + 7919 * k)), at) + np.uint64(k) for k in range(KEYS)], axis=1)
    return live, prints, keys


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seg, bounds in words.slices(batch, "text"):
            live, prints, keys = fingerprints(seg, bounds)
            if len(live):
                offsets = pa.array(np.arange(len(live) + 1, dtype=np.int32) * KEYS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(live)), words.as_signed(prints[:, 0].copy()), words.as_signed(prints[:, 1].copy()), pa.ListArray.from_arrays(offsets, words.as_signed(keys.ravel()))],
                    ["doc_id", "p0", "p1", "keys"],
                )


def _planes(prints: np.ndarray) -> np.ndarray:
    """[bits, words of 64 lanes]: bit planes of the rows' fingerprints, with one more word of padding."""
    lanes = -(-len(prints) // 64) + 1
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    padded = np.zeros((lanes * 64, bits.shape[1]), np.uint8)
    padded[: len(bits)] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view("<u8")


def _shifted(planes: np.ndarray, by: int) -> np.ndarray:
    """Lane i gets lane i + by."""
    whole, rest = divmod(by, 64)
    out = np.zeros_like(planes)
    left = planes.shape[-1] - whole
    if left > 0:
        out[..., :left] = planes[..., whole:] >> np.uint64(rest)
        if rest and left > 1:
            out[..., : left - 1] |= planes[..., whole + 1 :] << np.uint64(64 - rest)
    return out


def _count(planes: np.ndarray) -> list[np.ndarray]:
    """Bit-sliced number of set planes of each lane, lowest bit first, by a carry-save tree."""
    out, level = [], planes
    while len(level):
        carries = []
        while len(level) > 1:
            rest = level[len(level) // 3 * 3 :]
            a, b, c = level[0 : len(level) - len(rest) : 3], level[1 : len(level) - len(rest) : 3], level[2 : len(level) - len(rest) : 3]
            if len(a):
                half = a ^ b
                carries.append((a & b) | (half & c))
                level = np.concatenate([half ^ c, rest])
            else:
                carries.append((level[0] & level[1])[None])
                level = (level[0] ^ level[1])[None]
        out.append(level[0])
        level = np.concatenate(carries) if carries else level[:0]
    return out


def _added(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    out, carry = [], None
    for k in range(max(len(x), len(y))):
        bits = [v[k] for v in (x, y) if k < len(v)] + ([carry] if carry is not None else [])
        if len(bits) == 1:
            total, carry = bits[0], None
        elif len(bits) == 2:
            total, carry = bits[0] ^ bits[1], bits[0] & bits[1]
        else:
            half = bits[0] ^ bits[1]
            total, carry = half ^ bits[2], (bits[0] & bits[1]) | (half & bits[2])
        out.append(total)
    return out + ([carry] if carry is not None else [])


def _within(counter: list[np.ndarray], radius: int) -> np.ndarray:
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in reversed(range(max(len(counter), radius.bit_length()))):
        bit = counter[k] if k < len(counter) else np.zeros_like(more)
        if radius >> k & 1:
            same = same & bit
        else:
            more |= same & bit
            same = same & ~bit
    return ~more


def close_lanes(planes: np.ndarray, by: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Words of lanes i that are valid and whose row is within the radius of row i + by."""
    alive = np.flatnonzero(valid)
    out = np.zeros_like(valid)
    lanes, total = valid[alive], None
    for k in range(0, len(planes), STEP):
        if not len(alive):
            return out
        some = planes[k : k + STEP]
        differ = (some ^ _shifted(some, by))[:, alive]
        counter = _count(differ)
        total = counter if total is None else _added(total, counter)
        lanes = lanes & _within(total, radius)
        keep = np.flatnonzero(lanes)
        if len(keep) < len(alive):  # abandoned: all lanes of these words exceed the radius
            alive, lanes, total = alive[keep], lanes[keep], [t[keep] for t in total]
    out[alive] = lanes
    return out


def block_roots(keys: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by key, the first row of each row's component, where rows of equal key within the radius are joined."""
    n = len(keys)
    parent = np.arange(n)

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            x = parent[up]

    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    size = np.repeat(np.diff(edge), np.diff(edge))
    rows = np.flatnonzero(size > 1)
    by, most = 1, int(size.max(initial=0))
    planes = _planes(prints[rows]) if len(rows) else None
    while by < most:
        kept = rows[size[rows] > by]
        if len(kept) < 0.7 * len(rows):
            rows, planes = kept, _planes(prints[kept])
        k = keys[rows]
        same = np.zeros(planes.shape[1] * 64, np.uint8)
        same[: max(0, len(k) - by)] = k[:-by] == k[by:]
        valid = np.packbits(same, bitorder="little").view("<u8")
        hit = close_lanes(planes, by, valid, radius)
        words_hit = np.flatnonzero(hit)
        if len(words_hit):
            lanes = np.unpackbits(hit[words_hit].view(np.uint8), bitorder="little").reshape(-1, 64)
            w, lane = np.nonzero(lanes)
            i = words_hit[w] * 64 + lane
            a, b = roots(rows[i]), roots(rows[i + by])
            for x, y in zip(a[a != b].tolist(), b[a != b].tolist(), strict=True):
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
        by += 1
    return roots(parent)


def _close_batches(radius: int):
    def edges(keys: np.ndarray, prints: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        root = block_roots(keys, prints, radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["a", "b"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            key, ids, p0, p1 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            held.append((key, np.stack([p0, p1], axis=1).view(np.uint64), ids))
            if sum(len(k) for k, _, _ in held) >= ROWS:
                key, prints, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(key, key[-1]))  # a key's rows stay together
                if cut:
                    yield edges(key[:cut], prints[:cut], ids[:cut])
                held = [(key[cut:], prints[cut:], ids[cut:])]
        if held:
            yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return apply


def _cells(rows: DataFrame, block_rows: int) -> DataFrame:
    """(cell, id, p0, p1) out of (key, id, p0, p1): a key's rows are one cell, or, if they are more than block_rows, each pair of their parts is."""
    hot = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("parts")))
    rows = rows.join(hot, "key", "left")  # of at most rows / block_rows keys; its size is known, so Spark decides how
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: other != part), lambda other: F.xxhash64("key", F.least(other, part), F.greatest(other, part)))
    return rows.select(F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(pairs)).alias("cell"), "id", "p0", "p1")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, group_id): every document that has a near copy, with the smallest id of its group.

    Words are runs of letters and digits without regard to case. Texts that are null or have no words, and rows without an id,
    are in no group. Texts of one word or more are compared whole. Repeated rows of one id count once. Groups are transitive.
    An empty table gives an empty result. Candidates are found by KEYS minimum hashes, so a pair whose word triples have the
    Jaccard similarity j is missed, unless other members link it, with the probability (1 - j) ** KEYS. All candidates of a
    key are compared: those of a key with more than block_rows different fingerprints in blocks of a grid.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null and text is not null")
    prints = checkpointed(source.mapInArrow(_fingerprint_batches, "doc_id long, p0 long, p1 long, keys array<long>"))
    # equal fingerprints are one row in what follows, however many documents have them
    distinct = checkpointed(prints.groupBy("p0", "p1").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.min_by("keys", "doc_id").alias("keys")))
    cells = _cells(distinct.select(F.explode("keys").alias("key"), F.col("rep").alias("id"), "p0", "p1"), block_rows)
    close = cells.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_close_batches(radius), "a long, b long")
    parts = components(close)
    # what is in a group: fingerprints of several documents, and those that have a close one; documents are joined back only now
    grouped = distinct.join(parts, F.col("rep") == F.col("node"), "left").where("node is not null or rep <> last")
    grouped = grouped.select("p0", "p1", F.coalesce("component", "rep").alias("group_id"))
    # an id with several texts may be in several groups; it goes with the least
    return prints.join(grouped, ["p0", "p1"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one document of each group of near copies: the one of the smallest id. All columns stay.

    Rows without an id, or of an id that repeats, are told apart by their texts: of those with equal texts one stays, that
    of the smallest id, and it takes part in the groups like others, behind all rows with an id of their own. Ids are below
    2 ** 62. Texts that are null or have no words are in no group and all stay.
    """
    key, other = unused(docs, "_key"), unused(docs, "_shared")
    ids = docs.groupBy(F.col(id_column).cast("long").alias(other)).agg(F.count("*").alias("_n"))
    shared_ids = checkpointed(ids.where(f"_n > 1 or {other} is null").select(other))
    keyed = docs.withColumn(key, F.col(id_column).cast("long"))
    rest = None
    if not shared_ids.isEmpty():
        same = F.col(key).eqNullSafe(F.col(other))
        no_words = F.col(text_column).isNull() | ~F.col(text_column).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
        odd = keyed.join(shared_ids, same, "left_semi")
        rest = odd.where(no_words).drop(key)
        columns = [F.col(f"`{c}`") for c in docs.columns]
        order = F.struct(F.col(key).isNull(), key, F.xxhash64(F.to_json(F.struct(*columns))))
        one = odd.where(~no_words).groupBy(F.md5(text_column).alias("_text")).agg(F.min_by(F.struct(*columns), order).alias("_row"))
        name = F.shiftleft(F.lit(1).cast("long"), 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("_text"), 2))
        keyed = keyed.join(shared_ids, same, "left_anti").unionByName(one.select("_row.*", name.alias(key)))
    copies = near_duplicates(keyed, key, text_column).where("doc_id <> group_id").select(F.col("doc_id").alias(key))
    kept = keyed.join(copies, key, "left_anti").select(docs.columns)
    return kept if rest is None else kept.unionByName(rest)
