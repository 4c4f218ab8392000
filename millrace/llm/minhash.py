"""Near-duplicates of texts: fast similarity sketches, banding, exact verification, components.

The sketch is that of ``millrace.functions.sketch``.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text of fewer than
``k`` words has one shingle, its whole word sequence; repeated rows and texts with equal sets are one
class and differ in doc_id only; ids are taken to be unique; other columns of the input are not read, so their
names may be anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.sketch import band_keys, sketch
from millrace.llm.components import components
from millrace.llm.shared import Scratch
from millrace.llm.textbatch import U, mix, shingle_sets, slices, tidy

#: Coordinates, and how many make a band: at J = 0.85, 24 bands of 5 all miss with probability 8e-7.
BANDS, ROWS = 24, 5
#: A class with more rows than one part in HOT_SHARE * partitions of all is joined by broadcast: there are at most so many.
HOT_SHARE = 4
#: Members of a hub's component that its other members are held against before pairs among them are looked at.
PIVOTS = 4


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, data, off in slices(texts):
                sizes, keys, own = [], [], []
                for s in shingle_sets(data, off, k):
                    sizes.append(len(s))
                    if len(s):
                        x, y = int(s.sum(dtype=U)), int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U))
                        keys.append(x.to_bytes(8, "little") + y.to_bytes(8, "little") + len(s).to_bytes(4, "little"))
                        own.append(band_keys(sketch(s, bands * rows), bands, rows))
                    else:
                        keys.append(None)
                        own.append(None)
                yield pa.record_batch(
                    [ids.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(own, pa.list_(pa.int64()))],
                    ["id", "n", "set_key", "bands"],
                )

    return run


def _measure(k: int, part: int, whole: int, deltas: bool):
    """Rows (a, b, text of a, text of b), those of one ``a`` together.

    With ``deltas``: for each pair the sizes na, nb and common, whether it links, and of b's shingles that a lacks the
    least ones by hash, as many as the prefix filter needs (``complete``: that is all of them). Else only the pairs that link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        last, base = None, np.zeros(0, U)
        for batch in batches:
            ids, one = batch.column(0).to_pylist(), batch.column(2)
            for lo, hi, data, off in slices(batch.column(3)):
                rows, added = [], []
                for i, other in zip(range(lo, hi), shingle_sets(data, off, k)):
                    if ids[i] != last:
                        last = ids[i]
                        _, _, d, o = next(slices(one.slice(i, 1)))
                        base = shingle_sets(d, o, k)[0]
                    new = np.setdiff1d(other, base, assume_unique=True)
                    common = len(other) - len(new)
                    linked = common > 0 and whole * common >= part * (len(base) + len(new))
                    need = len(other) - -(-part * len(other) // whole) + 1
                    rows.append((len(base), len(other), common, linked, len(new) <= need))
                    added.append(np.sort(new)[:need].view(np.int64))
                na, nb, common, linked, complete = zip(*rows, strict=True)
                pair = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)]
                if deltas:
                    yield pa.record_batch(
                        [*pair, pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array(common, pa.int64()), pa.array(linked), pa.array(complete), pa.array(added, pa.list_(pa.int64()))],
                        ["a", "b", "na", "nb", "common", "linked", "complete", "added"],
                    )
                else:
                    mask = pa.array(linked)
                    yield pa.record_batch([x.filter(mask) for x in pair], ["a", "b"])

    return run


def _rivals(measured: DataFrame, part: int, whole: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of members of one hub that are in different components so far and may still link: no candidate is lost. ``linked``: in the
    hub's component; ``c``: the member's own.

    For members x and y of hub H let R be how many of H's shingles a member lacks, and A which it adds. Then
    |x & y| = |H| - |R_x or R_y| + |A_x & A_y| <= |H| - max(|R_x|, |R_y|) + |A_x & A_y|. So either they share an added
    shingle, found by joining the least |A| - (least needed overlap in A) + 1 ones, or the bound with none shared
    must hold, which depends on sizes only and is tried on the few distinct sizes instead of on pairs.

    The bound holds under every hub that both have, so one of these is enough: a member's home is its hub with most members, and two
    of one home are tried there only.
    """
    crowded = measured.groupBy("a").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("size")).filter("low <> high").select("a", "size")
    placed = measured.join(crowded, "a")
    homes = placed.groupBy("b").agg(F.max(F.struct("size", "a"))["a"].alias("home"))
    members = scratch.cut(
        placed.join(homes, "b").select(
            F.col("a").alias("hub"), "na", F.col("b").alias("id"), F.col("nb").alias("n"),
            (F.col("na") - F.col("common")).alias("lacks"), (F.col("nb") - F.col("common")).alias("adds"), "linked", "c", "complete", "added", "home",
        )
    )
    reach = lambda shared: (F.col("na") - F.greatest("x_lacks", "y_lacks") + shared)
    may = lambda common: F.lit(whole) * common >= F.lit(part) * (F.col("x_n") + F.col("y_n") - common)
    side = lambda df, p, cols: df.select("hub", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    here = "(x_home <> y_home or x_home = hub)"

    facts = F.struct("id", "n", "lacks", "adds", "c", "complete", "home").alias("m")
    by_shingle = members.select("hub", "na", F.explode("added").alias("shingle"), facts)
    left = by_shingle.select("hub", "na", "shingle", F.col("m").alias("x"))
    right = by_shingle.select("hub", "shingle", F.col("m").alias("y"))
    flat = [F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "xy" for c in ("id", "n", "lacks", "adds", "complete", "home")]
    sharing = (
        left.join(right, ["hub", "shingle"]).filter("x.id < y.id and x.c <> y.c")
        .select("hub", "na", "x", "y", *flat).filter(here).filter(may(reach(F.least("x_adds", "y_adds"))))
        .groupBy("hub", "na", "x", "y").agg(F.count(F.lit(1)).alias("shared"))
        .select("na", *flat, "shared")
        .filter(may(reach(F.when(F.col("x_complete") & F.col("y_complete"), F.col("shared")).otherwise(F.least("x_adds", "y_adds")))))
        .select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))
    )
    kind = ["n", "lacks", "adds", "linked"]
    kinds = members.groupBy("hub", "na", *kind).agg(F.count(F.lit(1)).alias("size"))
    tried = (
        side(kinds, "x", kind).join(kinds.select("hub", "na", *[F.col(c).alias(f"y_{c}") for c in kind]), "hub")
        .filter(~(F.col("x_linked") & F.col("y_linked")) & may(reach(F.lit(0))) & (reach(F.lit(0)) > 0))
        .filter("struct(x_n, x_lacks, x_adds, x_linked) <= struct(y_n, y_lacks, y_adds, y_linked)")
    )
    unshared = (
        tried.join(side(members, "x", [*kind, "id", "c", "home"]), ["hub", *[f"x_{c}" for c in kind]])
        .join(side(members, "y", [*kind, "id", "c", "home"]), ["hub", *[f"y_{c}" for c in kind]])
        .filter("x_id <> y_id and x_c <> y_c").filter(here).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))
    )
    return sharing.unionByName(unshared).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, part: int = 85, whole: int = 100,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row for each document: id_col, n_shingles, component_id, kept.

    Documents link when whole * |A & B| >= part * |A | B| for their shingle sets; component_id is the least
    id that links reach, and kept marks it.

    Plan: sketches in one Arrow pass; equal sets become one class; bands of two classes or more give
    candidates. A band compares its members with one hub, the member with most company in all its bands, so a
    group of copies costs one pair for each member. Pairs of members that this leaves open are settled from how each
    differs from the hub (``_rivals``), not by trying all pairs. Texts are shuffled once, and again only for the
    pairs that are compared.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = scratch.cut(own.mapInArrow(_signatures(k, bands, rows), "id long, n long, set_key binary, bands array<long>"))
    classes = sig.filter("n > 0").groupBy("set_key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    placed = classes.select("id", F.explode("bands").alias("band"))
    company = placed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = scratch.cut(placed.join(company, "band").select("band", "id", "size"))

    score = members.groupBy("id").agg(F.sum("size").alias("score"))
    ranked = members.join(score, "id").select("band", F.struct("score", (-F.col("id")).alias("back")).alias("rank"))
    hubs = ranked.groupBy("band").agg(F.max("rank").alias("hub"))
    first = scratch.cut(
        members.join(hubs, "band").select((-F.col("hub.back")).alias("a"), F.col("id").alias("b")).filter("a <> b").distinct()
    )
    texts = scratch.cut(own.hint("merge").join(members.select("id").distinct(), "id", "left_semi"))

    def measured(pairs: DataFrame, deltas: bool) -> DataFrame:
        one = texts.select(F.col("id").alias("a"), F.col("text").alias("one"))
        other = texts.select(F.col("id").alias("b"), F.col("text").alias("other"))
        rows_ = pairs.join(other, "b").join(one, "a").select("a", "b", "one", "other")
        more = ", na long, nb long, common long, linked boolean, complete boolean, added array<long>" if deltas else ""
        return scratch.cut(rows_.mapInArrow(_measure(k, part, whole, deltas), f"a long, b long{more}"))

    stars = measured(first, True)
    links = stars.filter("linked").select("a", "b")
    label = components(links, scratch)

    def known(pairs: DataFrame) -> DataFrame:
        """The pairs with both components so far, ca and c."""
        at_a, at_b = (label.select(F.col("node").alias(x), F.col("component").alias(n)) for x, n in (("a", "_ca"), ("b", "_c")))
        both = pairs.join(at_a, "a", "left").join(at_b, "b", "left")
        return both.withColumns({"ca": F.coalesce("_ca", "a"), "c": F.coalesce("_c", "b")}).drop("_ca", "_c")

    # members that don't link to their hub are held against a few that do, before pairs are made: a family of copies then is one component
    seen = scratch.cut(known(stars.select("a", "b")))
    draw = lambda k: F.min_by("b", F.xxhash64(F.lit(k), "b"))
    pivots = seen.filter("ca = c").groupBy("a").agg(F.array_distinct(F.array(*[draw(k) for k in range(PIVOTS)])).alias("p")).select("a", F.explode("p").alias("pivot"))
    again = seen.filter("ca <> c").join(pivots, "a").select(F.col("pivot").alias("a"), "b").distinct()
    links = links.unionByName(measured(scratch.cut(again), False))
    label = components(links, scratch)
    rivals = _rivals(known(stars.drop("linked")).withColumn("linked", F.col("ca") == F.col("c")), part, whole, scratch)
    at_a, at_b = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    open_ = rivals.join(at_a, "a", "left").join(at_b, "b", "left").filter("not (ca <=> cb) or ca is null").select("a", "b")
    label = components(links.unionByName(measured(scratch.cut(open_), False)), scratch)
    scratch.keep(sig, label)

    of_class = classes.select("set_key", "rows", F.col("id").alias("node")).join(label, "node", "left").select(
        "set_key", "rows", F.coalesce("component", "node").alias("component")
    )
    # classes of more than a share of the rows that a task should have are few, whatever the input: their rows meet nobody in a shuffle
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = max(1, sig.count() // (HOT_SHARE * parts))
    hot = F.broadcast(scratch.cut(of_class.filter(F.col("rows") > many)).drop("rows"))
    cold = of_class.filter(F.col("rows") <= many).drop("rows")
    filled = sig.filter("n > 0").select("id", "n", "set_key")
    parts_of = [
        sig.filter("n = 0").select("id", "n", F.col("id").alias("component")),
        filled.join(hot, "set_key").select("id", "n", "component"), filled.join(hot, "set_key", "left_anti").join(cold, "set_key").select("id", "n", "component"),
    ]
    return parts_of[0].unionByName(parts_of[1]).unionByName(parts_of[2]).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("component", "id") == F.col("id")).alias("kept"),
    )
