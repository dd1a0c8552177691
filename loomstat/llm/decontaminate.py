"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other parameters has the same template. Windows of
templates are joined by hash, and the slots of each alignment are checked: one value of the benchmark must always stand
for one value in the document and the other way round; windows that break this don't count. Where a window has too few words
besides slots, and for items too short for a template, the hash of the exact words, slot values included, is joined instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .shared import checkpointed, unused

WINDOW = 8
#: Words that aren't placeholders, at least, in a window; a shorter item needs half of its words.
LITERALS = 4
#: Items with fewer words than this have no template; only their exact words match.
SHORTEST = 5
#: A document is contaminated by an item if one alignment shares so many different windows with it, or that share of its windows.
#: Six windows of eight words are a run of thirteen, as in the usual test for contamination, whatever the item's length.
LEAST_WINDOWS = 6
LEAST_SHARE = 0.5
#: Bits a window of the benchmark in the filter that the documents' windows pass before the join, and the most of them.
FILTER_BITS = 64
MOST_BITS = 1 << 27
UNITS = (
    "m km cm mm mi mile miles ft foot feet inch inches yard yards meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters g kg mg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons "
    "s sec second seconds minute minutes min hour hours hr hrs day days week weeks month months year years ms l ml liter liters litre litres gallon gallons cup cups percent dollar dollars usd eur euro euros cent cents gbp yen "
    "degree degrees c f k w kw kwh watt watts joule joules j v volt volts a amp amps hz khz mhz ghz b kb mb gb tb byte bytes bit bits mph kph"
).split()
NUMBER, NAME, UNIT = 1, 2, 3
#: Added to the hash of exact words, so that it isn't that of a template.
EXACT = 1 << 32
_UNIT_HASHES = np.sort(np.array([words.hashes(b, np.array([0]), np.array([len(b)]))[0] for b in (np.frombuffer(u.encode(), np.uint8) for u in UNITS)], np.uint64))
_SLOT_HASHES = np.array([0, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F], np.uint64)
_ENDS = np.array([b in b".!?:\n\r\"" for b in range(256)])


def templates(seg: np.ndarray, bounds: np.ndarray) -> tuple[words.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their kinds (0 for a literal), their hashes, and their hashes in the template.

    A number begins with a digit and may hold points and commas between digits. A name has a capital first letter, isn't
    in capitals, and doesn't begin a sentence. A unit is a word of UNITS that follows a number.
    """
    low = words.lowered(seg)
    inside = words.ALNUM[low]
    digit = (low >= 48) & (low < 58)
    joint = np.flatnonzero(((low[1:-1] == 46) | (low[1:-1] == 44)) & digit[:-2] & digit[2:]) + 1 if len(low) > 2 else np.zeros(0, np.int64)
    inside[joint] = True
    w = words.split(low, bounds, inside)
    h = words.hashes(low, w.start, w.end)
    kind = np.zeros(len(h), np.int8)
    if not len(h):
        return w, kind, h, h
    ends = np.concatenate([[0], np.cumsum(_ENDS[seg])])
    opens = np.ones(len(h), bool)
    opens[1:] = ends[w.start[1:]] > ends[w.end[:-1]]
    begin = w.first[:-1][w.counts > 0]
    opens[begin] = True
    accent = seg[w.start] == 0xC3
    after = w.start + np.where(accent, 2, 1)
    capital = low[w.start] != seg[w.start]
    capital[accent] = low[w.start[accent] + 1] != seg[w.start[accent] + 1]
    rest = np.minimum(after, len(seg) - 1)
    mixed = (after < w.end) & (low[rest] == seg[rest])
    twice = np.minimum(rest + 1, len(seg) - 1)
    mixed &= (seg[rest] != 0xC3) | (low[twice] == seg[twice])
    kind[capital & mixed & ~opens] = NAME
    kind[digit[w.start]] = NUMBER
    follows = np.zeros(len(h), bool)
    follows[1:] = kind[:-1] == NUMBER
    follows[begin] = False
    at = np.flatnonzero(follows & (kind != NUMBER))
    known = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, h[at]), len(_UNIT_HASHES) - 1)] == h[at]
    kind[at[known]] = UNIT
    return w, kind, h, np.where(kind > 0, _SLOT_HASHES[kind], h)


def windows(seg: np.ndarray, bounds: np.ndarray, sizes: tuple[int, ...], exact: tuple[int, ...], whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each size: texts, places, hashes, for each window the number of its slots with all slots' values, and minus the size; then for each of exact, by the exact words, without slots and with that size.

    whole: only texts of exactly that size have windows of less than WINDOW words, and only windows that have no template
    are exact; for the benchmark's side. Else all windows of those sizes are, as kinds depend on the words before them.
    """
    w, kind, h, template = templates(seg, bounds)
    slots = np.concatenate([[0], np.cumsum(kind > 0)])
    values = h[kind > 0]

    def every(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        fits = w.counts >= size if size == WINDOW or not whole else w.counts == size
        many = np.where(fits, w.counts - size + 1, 0)
        place = words.ranges(w.first[:-1], many)
        filled = slots[place + size] - slots[place]
        return np.repeat(np.arange(len(many)), many), place, filled, (size >= SHORTEST) & (size - filled >= (LITERALS if size == WINDOW else (size + 1) // 2))

    for size in sizes:
        text, place, filled, keep = every(size)
        place, text, filled = place[keep], text[keep], filled[keep]
        # a hash tells the size too
        yield text, place - w.first[text], (words.grams(template, size)[place] + words.U64(size) if len(template) else template), filled, values[words.ranges(slots[place], filled)], -size
    for size in exact:
        text, place, _, keep = every(size)
        if whole:
            place, text = place[~keep], text[~keep]
        if len(place):
            yield text, place - w.first[text], words.grams(h, size)[place] + words.U64(EXACT + size), np.zeros(len(place), np.int64), values[:0], size


def _window_batches(id_name: str, sizes: tuple[int, ...], exact: tuple[int, ...], whole: bool, bits=None):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        for batch in batches:
            for part, seg, bounds in words.slices(batch, "text"):
                for text, place, h, filled, values, size in windows(seg, bounds, sizes, exact, whole):
                    if marks is not None:
                        bit = (h % words.U64(len(marks) * 8)).astype(np.int64)
                        hit = marks[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0
                        values = values[np.repeat(hit, filled)]
                        text, place, h, filled = text[hit], place[hit], h[hit], filled[hit]
                    if len(h):
                        offsets = np.concatenate([[0], np.cumsum(filled)]).astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(offsets), words.as_signed(np.ascontiguousarray(values)))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(place), words.as_signed(np.ascontiguousarray(h)), lists, pa.array(np.full(len(h), size, np.int32))], [id_name, "place", "window", "slots", "exact"])

    return apply


def _consistent(clean: DataFrame, clashing: DataFrame) -> DataFrame:
    """(doc_id, item_id, n, typed, pairs) of alignments. Of a clashing one, the windows with a pair that clashes are dropped.

    Of pairs that share only one of their two values a verbatim one holds, else the one in the most windows, and of equals
    none. The rest counts if it is at least LEAST_SHARE of the alignment's windows.
    """

    def places(hits: Column) -> Column:
        return F.array_distinct(F.transform(hits, lambda x: x["item_place"]))

    def typed(hits: Column) -> Column:
        return F.size(places(F.filter(hits, lambda x: x["exact"] < 0))).cast("long")

    count = F.size(places(F.col("hits"))).cast("long")
    weight = lambda p: F.struct(p["item_slots"] == p["slots"], F.size(F.filter("all", lambda x: x == p)))
    weighed = F.transform("pairs", lambda p: F.struct(p.alias("p"), weight(p).alias("w")))
    rival = lambda a, b: ((a["p"]["item_slots"] == b["p"]["item_slots"]) != (a["p"]["slots"] == b["p"]["slots"])) & (a["w"] <= b["w"])
    some = clashing.withColumn("before", count).withColumn("weighed", weighed)
    some = some.withColumn("lost", F.transform(F.filter("weighed", lambda a: F.exists("weighed", lambda b: rival(a, b))), lambda a: a["p"]))
    some = some.withColumn("hits", F.filter("hits", lambda x: ~F.arrays_overlap(x["pairs"], F.col("lost")))).withColumn("pairs", F.array_except("pairs", "lost"))
    some = some.where(count >= F.col("before") * LEAST_SHARE)
    columns = ["doc_id", "item_id", count.alias("n"), typed(F.col("hits")).alias("typed"), "pairs"]
    return clean.select(*columns).unionByName(some.select(*columns))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, item_windows, share, reparameterised) of each pair of a document and an item that it contains.

    windows: how many different windows of the item the document has in its best alignment, without those whose slots clash.
    share: of the item's windows. reparameterised: whether a slot's value differs in the best alignment. Windows without a template, and items of fewer than SHORTEST
    words, match by their exact words only; LEAST_WINDOWS or LEAST_SHARE hold for the windows with a template alone too,
    so windows without one never hide a reparameterised copy. Rows without an id and texts without words match nothing.
    Repeated rows of an id count once. An empty table gives an empty result. The benchmark's size isn't bounded: the
    filter's size is, and the join is Spark's to plan.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col(item_column).alias("item_id"), F.col(item_text_column).alias("text")).where("item_id is not null and text is not null")
    shape = [T.StructField("place", T.LongType()), T.StructField("window", T.LongType()), T.StructField("slots", T.ArrayType(T.LongType())), T.StructField("exact", T.IntegerType())]
    asked = items.mapInArrow(_window_batches("item_id", tuple(range(SHORTEST, WINDOW + 1)), tuple(range(1, WINDOW + 1)), True), T.StructType([items.schema["item_id"], *shape]))
    asked = checkpointed(asked.dropDuplicates(["item_id", "place", "window"]))
    totals = asked.groupBy("item_id").agg(F.countDistinct("place").alias("item_windows"), F.countDistinct(F.when(F.col("exact") < 0, F.col("place"))).alias("item_typed"))
    found = sorted((r[0], r[1]) for r in asked.groupBy("exact").count().collect())  # the sizes that items have, at most WINDOW of each kind
    sizes, exact = tuple(-k for k, _ in found if k < 0), tuple(k for k, _ in found if k > 0)
    bits = min(MOST_BITS, max(1 << 16, 1 << (FILTER_BITS * sum(n for _, n in found)).bit_length()))
    bit = F.pmod(F.expr(f"case when window >= 0 then window % {bits}L else (window % {bits}L) + {(1 << 64) % bits}L end"), F.lit(bits)) + 1
    parts = asked.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("marks")).collect()
    marks = bytearray(bits // 8)
    for bucket, some in parts:
        marks[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(some)] = some
    shared = spark.sparkContext.broadcast(bytes(marks))
    found = ids.mapInArrow(_window_batches("doc_id", sizes, exact, False, shared), T.StructType([ids.schema["doc_id"], *shape])).drop("exact").dropDuplicates(["doc_id", "place", "window", "slots"])
    theirs = asked.select("item_id", F.col("place").alias("item_place"), "window", "exact", F.col("slots").alias("item_slots"))
    pairs = found.join(theirs, "window").select("doc_id", "item_id", "item_place", "exact", (F.col("place") - F.col("item_place")).alias("shift"), F.arrays_zip("item_slots", "slots").alias("pairs"))
    aligned = pairs.groupBy("doc_id", "item_id", "shift").agg(F.collect_list(F.struct("item_place", "exact", "pairs")).alias("hits"), F.flatten(F.collect_list("pairs")).alias("all"))
    aligned = aligned.withColumn("pairs", F.array_distinct("all"))
    size = F.size("pairs")
    clean = (F.size(F.array_distinct("pairs.item_slots")) == size) & (F.size(F.array_distinct("pairs.slots")) == size)
    aligned = _consistent(aligned.where(clean), aligned.where(~clean))
    changed = F.exists("pairs", lambda p: p["item_slots"] != p["slots"])
    best = aligned.groupBy("doc_id", "item_id").agg(F.max(F.struct("n", "typed", (~changed).alias("same"))).alias("best"))
    totalled = best.join(totals, "item_id").select("doc_id", "item_id", "best.*", "item_windows", "item_typed", (~F.col("best.same")).alias("reparameterised"))
    n, typed = F.col("n"), F.col("typed")
    enough = (n >= LEAST_WINDOWS) | (F.round(n / F.col("item_windows"), 6) >= LEAST_SHARE) | ((F.col("item_typed") > 0) & (F.round(F.try_divide(typed, "item_typed"), 6) >= LEAST_SHARE))
    return totalled.where(enough).select("doc_id", "item_id", n.alias("windows"), "item_windows", F.round(n / F.col("item_windows"), 6).alias("share"), "reparameterised")


def cleaned(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the rows of documents that contain an item of the benchmark. All columns stay.

    Rows of one id are one document. A row without an id is a document of its own, named by a hash of its text; ids are below 2 ** 62.
    """
    unnamed = F.shiftleft(F.lit(1).cast("long"), 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64(text_column), 2))
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, F.coalesce(F.col(id_column).cast("long"), unnamed))
    leaks = contaminated(keyed, benchmark, key, text_column).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(leaks, key, "left_anti").select(docs.columns)
