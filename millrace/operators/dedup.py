"""Exact and near-duplicate removal in file order: the first one stays."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions.sketch import U, band_keys, mix, sketch
from millrace.functions.text import content_hash, strip
from millrace.sources.scratch import cut, discard


def turns_key(turns: Column) -> Column:
    """The hash of the first two turns' texts put together, whatever their roles; null for fewer turns."""
    value = lambda i: F.coalesce(F.get(turns, F.lit(i))["value"], F.lit(""))
    return F.when(F.size(turns) >= 2, content_hash(F.concat(value(0), value(1))))


def first_of_key(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The row with the least seq of each key; rows without a key all stay.

    The least seq is combined before the shuffle, so a key that many rows share doesn't gather them.
    """
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias(seq))
    kept = df.join(first.select(seq), seq, "left_semi")
    return kept.unionByName(df.filter(F.col(key).isNull()))


#: Coordinates of one sketch, and the probability at which a pair at the threshold may be missed.
COORDINATES, MISS = 252, 1e-9
#: Texts of a family that one cell takes from either side of its pairs, and pairs that cells have on average.
CELL = 400
#: Pairs for each place of a text in a band up to which all pairs are listed at once, and the share of texts that a round must settle at least.
DENSE, SETTLED = 8, 0.2


def banding(threshold: float) -> tuple[int, int, int]:
    """(sketches, bands of each, rows of a band): the longest bands of which a pair at the threshold shares two, but for probability MISS."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0 and up to 1 is needed")
    sketches = 2
    while True:
        for rows in range(12, 0, -1):
            bands, p = COORDINATES // rows, threshold**rows
            n = sketches * bands
            if (1 - p) ** n + n * p * (1 - p) ** (n - 1) <= MISS:
                return sketches, bands, rows
        sketches *= 2


def gram_hashes(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the stripped text's character n-grams; a shorter text is its own gram."""
    text = text.strip()
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    width = n if len(letters) >= n else len(letters)
    count = max(len(letters) - width + 1, 1) if width else 1
    h = np.full(count, 0x9E3779B97F4A7C15 + width, np.uint64)
    for j in range(width):
        h = (h ^ letters[j : j + count]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _banded(n: int, sketches: int, bands: int, rows: int):
    """(id, size, bands, packed text) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, packed = [], [], []
            for text in batch.column(1):  # one at a time: memory follows the longest one
                h = gram_hashes(text.as_py(), n)
                sizes.append(len(h))
                packed.append(zlib.compress(text.as_py().encode(), 1))
                own = [h, *(mix(h ^ mix(np.array([k], U))) for k in range(1, sketches))]
                keys.append(np.concatenate([mix((band_keys(sketch(x, bands * rows), bands, rows) + k).view(U)).view(np.int64) for k, x in enumerate(own)]))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())], ["id", "size", "bands", "text"])

    return run


def first_copies(df: DataFrame, text: str, seq: str) -> DataFrame:
    """(id, text): the least seq of each distinct stripped text; a null is empty."""
    own = df.select(F.col(seq).cast("long").alias("id"), strip(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    return own.groupBy("text").agg(F.min("id").alias("id")).select("id", "text")


def copies(df: DataFrame, text: str = "text", seq: str = "seq") -> DataFrame:
    """(a, b): every row b whose stripped text an earlier row has too, and the first row a that has it."""
    own = df.select(F.col(seq).cast("long").alias("b"), content_hash(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    return own.join(own.groupBy("key").agg(F.min("b").alias("a")), "key").filter("a < b").select("a", "b")


def near_pairs(df: DataFrame, text: str = "text", seq: str = "seq", n: int = K.NGRAM, threshold: float = K.SIMILAR) -> DataFrame:
    """(a, b, jaccard), a < b by seq, of all rows that are near each other, copies too: as many pairs as there are, which for a group of
    copies is the square of its size. ``near_classes`` and ``copies`` tell the same without the square."""
    member = cut(copies(df, text, seq).unionByName(first_copies(df, text, seq).select(F.col("id").alias("a"), F.col("id").alias("b"))))
    of = lambda x: member.select(F.col("a").alias(x), F.col("b").alias(f"{x}{x}"))
    apart = near_classes(df, text, seq, n, threshold).join(of("a"), "a").join(of("b"), "b").select(
        F.least("aa", "bb").alias("a"), F.greatest("aa", "bb").alias("b"), "jaccard"
    )
    alike = member.alias("x").join(member.alias("y"), "a").filter("x.b < y.b").select(F.col("x.b").alias("a"), F.col("y.b").alias("b"), F.lit(1.0).alias("jaccard"))
    return apart.unionByName(alike)


def near_classes(df: DataFrame, text: str = "text", seq: str = "seq", n: int = K.NGRAM, threshold: float = K.SIMILAR) -> DataFrame:
    """(a, b, jaccard), a < b by seq, of different texts whose n-gram sets have a Jaccard similarity above the threshold. Rows with one text are
    one class, which its least seq stands for (``first_copies``).

    Pairs are measured on their texts, so none is wrong. Those that are measured share two bands of sketches at least (``banding``); a pair
    right at the threshold fails to with probability 1e-9 at most, a nearer one with less. What is shipped follows the texts and the
    pairs that share bands: no list of grams is.
    """
    own = banded(df, text, seq, n, threshold)
    return _near(own, _met(shared(own.select("id", "size", F.explode("bands").alias("band"))), threshold), n, threshold)


def banded(df: DataFrame, text: str, seq: str, n: int, threshold: float) -> DataFrame:
    """(id, size, bands, packed text) of the first row of each text, written. Its ids are those of ``first_copies``."""
    sketches, bands, rows = banding(threshold)
    return cut(first_copies(df, text, seq).mapInArrow(_banded(n, sketches, bands, rows), "id long, size long, bands array<long>, text binary"))


def shared(placed: DataFrame) -> DataFrame:
    """(id, size, band, c, head, head_size) of the places in bands that several texts share, written: how many do, the least of them and its size."""
    band = Window.partitionBy("band")
    told = placed.select("id", "size", "band", F.count(F.lit(1)).over(band).alias("c"), F.min(F.struct("id", "size")).over(band).alias("h"))
    return cut(told.filter("c > 1").select("id", "size", "band", "c", F.col("h.id").alias("head"), F.col("h.size").alias("head_size")))


def _met(places: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of texts that share two bands and whose sizes allow the threshold."""
    left, right = places.select("band", F.col("id").alias("a"), F.col("size").alias("na")), places.select("band", F.col("id").alias("b"), F.col("size").alias("nb"))
    close = F.least("na", "nb") >= (threshold - 1e-9) * F.greatest("na", "nb")
    return left.join(right, "band").filter((F.col("a") < F.col("b")) & close).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("a", "b")


def _near(own: DataFrame, met: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, jaccard) of those of the pairs ``met`` whose texts in ``own`` are above the threshold."""

    def grams_of(packed: bytes) -> set[str]:
        value = zlib.decompress(packed).decode()
        return {value[i : i + n] for i in range(max(1, len(value) - n + 1))}

    def measured(some_pairs: pa.Table, texts: pa.Table) -> pa.Table:
        at = {i: k for k, i in enumerate(texts["id"].to_pylist())}
        column, out, last, base = texts["text"], [], None, set()
        for first, other in sorted(zip(some_pairs["a"].to_pylist(), some_pairs["b"].to_pylist())):
            if first != last:
                last, base = first, grams_of(column[at[first]].as_py())
            grams = grams_of(column[at[other]].as_py())
            both = len(base & grams)
            if both / (len(base) + len(grams) - both) > threshold:
                out.append((first, other, both / (len(base) + len(grams) - both)))
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 3, kinds)], ["a", "b", "jaccard"])

    # a text goes once to each cell that needs it, not once for each pair: pairs lie in the cell of their family, large families in several
    pairs = cut(met)
    low = pairs.select("a", F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("o"))).groupBy("a").agg(F.min("o").alias("o"))
    placed = cut(pairs.join(low.select("a", F.least("a", "o").alias("hub")), "a").select("hub", "a", "b"))
    sizes = placed.select("hub", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("hub").agg(F.count(F.lit(1)).alias("c"))
    large = F.broadcast(cut(sizes.filter(F.col("c") > CELL).select("hub", F.ceil(F.col("c") / CELL).alias("k"))))
    block = lambda c: F.pmod(F.xxhash64(c), F.coalesce("k", F.lit(1)))
    cells = max(1, placed.count() // CELL)
    cell = F.pmod(F.xxhash64("hub", block("a"), block("b")), F.lit(cells)).alias("cell")
    dealt = cut(placed.join(large, "hub", "left").select(cell, "a", "b"))
    needed = dealt.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().join(own, "id").select(F.col("cell").alias("place"), "id", "text")
    return dealt.groupBy("cell").cogroup(needed.groupBy("place")).applyInArrow(measured, "a long, b long, jaccard double")


def greedy_kept(pairs: DataFrame) -> DataFrame:
    """(id): rows of (a, b) pairs that a pass in the order of ids drops, each for a neighbour kept before it.

    Rounds: a row whose earlier neighbours are all dropped is kept; a row with a kept earlier neighbour is dropped. The least
    undecided id of every chain is settled in each round, and rounds end when none is undecided.
    """
    pairs = cut(pairs.select("a", "b").distinct())
    open_ = pairs
    dropped = None
    while True:
        waiting = open_.select(F.col("b").alias("a")).distinct()
        kept = cut(open_.select("a").distinct().join(waiting, "a", "left_anti"))
        gone = cut(open_.join(kept, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        if not gone.limit(1).count():
            return dropped
        # decided rows constrain no one further: kept ones have dropped their neighbours, dropped ones don't count
        out_a, out_b = gone.select(F.col("id").alias("a")), gone.select(F.col("id").alias("b"))
        open_ = cut(open_.join(kept, "a", "left_anti").join(out_a, "a", "left_anti").join(out_b, "b", "left_anti"))


def greedy_dropped(own: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id): texts of ``banded`` that a pass in the order of ids drops. A family of m near copies costs its m * 84 places, not its m * m pairs.

    Rounds, while bands hold many pairs for their places: a text that is the first of all its bands has no earlier one to fear and is kept; the
    texts that it shares two bands with are measured on it and dropped if near. Both leave the bands, which settles no one else. All pairs of the
    texts that are left are listed once they are few for their places, or when a round settles hardly any text.
    """
    places, dropped, last = shared(own.select("id", "size", F.explode("bands").alias("band"))), [], None
    while True:
        state = places.agg(F.count(F.lit(1)).alias("places"), F.sum(F.col("c") - 1).alias("pairs"), F.count_distinct("id").alias("texts")).first()
        if not state["places"]:
            break
        slow = last is not None and state["texts"] > (1 - SETTLED) * last
        if slow or state["pairs"] / 2 <= DENSE * state["places"]:
            dropped.append(greedy_kept(_near(own, _met(places, threshold), n, threshold)))
            break
        last = state["texts"]
        kept = cut(places.groupBy("id").agg(F.min("head").alias("head")).filter("head = id").select("id"))
        close = F.least("size", "head_size") >= (threshold - 1e-9) * F.greatest("size", "head_size")
        led = places.filter((F.col("head") < F.col("id")) & close).groupBy(F.col("head").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("c"))
        met = led.filter("c > 1").join(kept.withColumnRenamed("id", "a"), "a", "left_semi").select("a", "b")
        gone = cut(_near(own, met, n, threshold).select(F.col("b").alias("id")).distinct())
        dropped.append(gone)
        places = shared(places.select("id", "size", "band").join(kept.unionByName(gone), "id", "left_anti"))
    found = own.select("id").limit(0)
    for one in dropped:
        found = found.unionByName(one)
    return found


def greedy_near_dedup(df: DataFrame, text: str = "text", seq: str = "seq", n: int = K.NGRAM, threshold: float = K.SIMILAR, most: int | None = None) -> DataFrame:
    """The rows that a pass in order keeps: those not above the threshold with a kept earlier one.

    Of rows with one text only the first can stay, as a later one is as near to whatever drops the first, or to the first itself. Rows without a seq have no place in
    the order and are left out. ``most``: with more rows than that nothing is removed; None, the default: duplicates always go.
    """
    if most is not None and df.count() > most:
        return df
    own = banded(df, text, seq, n, threshold)
    dropped = cut(greedy_dropped(own, n, threshold).distinct())
    kept = cut(own.select("id").join(dropped, "id", "left_anti").withColumnRenamed("id", seq))
    discard(own, dropped)
    return df.join(kept, seq, "left_semi")


def answers_text(turns: Column) -> Column:
    """What near-duplicates are judged by: the model's turns, joined by a space."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["from"] == "gpt"), lambda t: F.coalesce(t["value"], F.lit(""))), " ")


def dedup_conversations(df: DataFrame, turns: str = "conversations", seq: str = "seq", most: int | None = None) -> DataFrame:
    """Exact, then near-duplicates; both keep the first in order."""
    once = cut(first_of_key(df.withColumn("_key", turns_key(F.col(turns))), "_key", seq).drop("_key"))
    return greedy_near_dedup(once.withColumn("_text", strip(answers_text(F.col(turns)))), "_text", seq, most=most).drop("_text")
