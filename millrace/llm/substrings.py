"""Suffix-array dedup: removal of byte strings that an earlier document holds too, by run-length indexes of shared text.

A byte goes when a window of ``window`` bytes covers it that also starts in a document with a smaller id; windows are
judged on the input. One index of the whole corpus would have to sit in one place, so the text is first cut by content:

1. Equal texts are one class; only its least id is looked at further, the others lose every byte (if they hold a window).
   Each window has a minimizer, the least hash among its ``ANCHOR``-byte strings; equal windows have equal ones. Every map task
   sends each minimizer once for each block of text; those found in one class only are done with.
2. Classes get back which of their minimizers are shared. Runs of windows with one shared minimizer (with the
   bytes they cover) are the candidate strings.
3. Equal strings are combined before they are shuffled, with the least id that has them. Strings with one minimizer meet in one shard.
   A run-length index of the shard's strings (``runindex``) streams their matching statistics and labels every window with the least
   id in the interval of its ``window`` letters. Minimizers with more than ``CROWD`` distinct strings are first cut into single
   windows, dealt by the window's own hash.
4. Labels go back to the strings' places; windows with a label below their document's id are spans.

Only steps 1 and 2 see all text; their hashes decide what is compared, never what matches: a text is left out as a copy only if
its bytes are those of the first one. (Classes are told apart by 64 bits where a minimizer's classes are counted.)

Defined results: one row for each input row. Null and empty texts have no bytes; texts shorter than the window keep all; copies with ids of their own
lose all they share with the first; rows with one id don't take from each other, whether their texts are equal or not; rows without an id, which
come neither before nor after others, keep all and take from none; a removed span may cut a character in two, so kept bytes are bytes
(``text_without`` drops the broken characters); only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.runindex import NONE, RunIndex
from millrace.llm.shared import Scratch
from millrace.llm.textbatch import U, buffers, mix, power_tables, slices, tidy

ANCHOR, CROWD, LONGEST = 20, 20_000, 48
#: Documents, and bytes, of a group whose texts are in memory together; bytes of the strings of one index; bytes of text for a bucket of questions.
GROUP, GROUP_BYTES, SHARD, BUCKET = 512, 1 << 23, 1 << 18, 1 << 25
LOW = U(0xFFFFFFFF)
#: Instead of a class in a question: the block has several with the minimizer, and they know.
TOLD = 0xFFFFFFFF
#: Minimizers with crowds that are broadcast at most; beyond, the join is a shuffled one.
SENT = 1_000_000


def minimizers(data: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: hash, text, first window (byte in the slice), number of windows."""
    n = len(data) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, z
    up, down = power_tables(len(data))
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=prefix[1:])
    low = mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * down[: len(data) - ANCHOR + 1])
    width, s = window - ANCHOR + 1, 1
    while s * 2 <= width:
        low = np.minimum(low[:-s], low[s:])
        s *= 2
    if width > s:
        low = np.minimum(low[: -(width - s)], low[width - s :])
    whole = np.ones(n, bool)  # windows that lie in one text
    ends = off[1:-1]
    for e in ends.tolist():
        whole[max(0, e - window + 1) : e] = False
    new = whole.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~whole[:-1]
    last = whole.copy()
    last[:-1] &= new[1:] | ~whole[1:]
    first, stop = np.flatnonzero(new), np.flatnonzero(last) + 1
    return low[first], np.searchsorted(off, first, "right") - 1, first, stop - first


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """pmod(xxhash64(id), groups), as Spark computes it."""
    p = [U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    turn = lambda x, r: x << U(r) | x >> U(64 - r)
    h = np.full(len(ids), U(42) + p[4] + U(8)) ^ turn(ids.astype(np.int64).view(U) * p[1], 31) * p[0]
    h = turn(h, 27) * p[0] + p[3]
    h = (h ^ h >> U(33)) * p[1]
    h = (h ^ h >> U(29)) * p[2]
    return np.mod((h ^ h >> U(32)).view(np.int64), groups)


def _answers(ids: np.ndarray, keys: np.ndarray, groups: int) -> pa.RecordBatch | None:
    """Rows (part, kind 1, group, ids and keys): which minimizers of which documents are shared."""
    if not len(ids):
        return None
    group = group_of(ids, groups)
    order = np.argsort(group, kind="stable")
    group, ids, keys = group[order], ids[order], keys[order]
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    blobs = [ids[a:b].tobytes() + keys[a:b].tobytes() for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)])]
    own = group[edge]
    return pa.record_batch([pa.array(own.astype(np.int64)), pa.array(np.ones(len(own), np.int32)), pa.array(own.astype(np.int64)), pa.array(blobs, pa.binary())], ["part", "kind", "group", "blob"])


def _ask(window: int, buckets: int, groups: int):
    """(class, text) -> questions (bucket, kind 0, null, minimizers and classes), and answers that a block gives itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            classes = batch.column(0).to_numpy(zero_copy_only=False)
            once = np.zeros(len(classes), bool)
            once[np.unique(classes, return_index=True)[1]] = True  # equal texts of a batch ask once
            classes, texts = classes[once], batch.column(1).filter(pa.array(once))
            for a, b, data, off in slices(texts):
                key, doc, _, _ = minimizers(data, off, window)
                if not len(key):
                    continue
                bucket = ((key >> U(32)) * U(buckets)) >> U(32)
                key = bucket << U(32) | key & LOW
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                one = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
                key, own = key[one], classes[a:b][doc[one]]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                many = np.diff(np.append(first, len(key)))
                known = np.repeat(many > 1, many)
                answers = _answers(own[known], key[known], groups)
                if answers is not None:
                    yield answers
                key, own = key[first], own[first]
                part = (key >> U(32)).astype(np.int64)
                edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                blobs = []
                for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(key)]):
                    single = many[x:y] == 1
                    named, place = np.unique(own[x:y][single], return_inverse=True)
                    places = np.full(y - x, TOLD, "<u4")
                    places[single] = place
                    blobs.append(np.array([y - x, len(named)], np.int64).tobytes() + named.tobytes() + (key[x:y] & LOW).astype("<u4").tobytes() + places.tobytes())
                k = len(edge)
                yield pa.record_batch([pa.array(part[edge]), pa.array(np.zeros(k, np.int32)), pa.array([None] * k, pa.int64()), pa.array(blobs, pa.binary())], ["part", "kind", "group", "blob"])

    return run


def _answer(groups: int):
    """Questions in the order of buckets -> answers for minimizers that two classes or more have; a bucket is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        keys, owns, knows, last = [], [], [], None
        for batch in batches:
            own = batch.filter(pa.array(np.asarray(batch["kind"]) == 1))
            if own.num_rows:
                yield own.select(["group", "blob"])
            for part, kind, blob in zip(batch["part"].to_pylist(), batch["kind"].to_pylist(), batch["blob"]):
                if kind == 0:
                    if part != last and keys:
                        yield from answered(keys, owns, knows)
                        keys, owns, knows = [], [], []
                    last = part
                    raw = blob.as_buffer()
                    n, size = np.frombuffer(raw, np.int64, 2)
                    named = np.append(np.frombuffer(raw, np.int64, size, 16), 0)
                    place = np.frombuffer(raw, "<u4", n, 16 + 8 * size + 4 * n)
                    keys.append(U(part << 32) | np.frombuffer(raw, "<u4", n, 16 + 8 * size).astype(U))
                    knows.append(place == TOLD)
                    owns.append(named[np.where(knows[-1], size, place)])
        if keys:
            yield from answered(keys, owns, knows)

    def answered(keys: list, owns: list, knows: list) -> Iterator[pa.RecordBatch]:
        key, own, told = np.concatenate(keys), np.concatenate(owns), np.concatenate(knows)
        # a bucket's minimizers differ in their low halves; a question's place rides below, for a sort of plain integers
        row = np.sort((key & LOW) << U(32) | np.arange(len(key), dtype=U))
        head = np.concatenate([[True], row[1:] >> U(32) != row[:-1] >> U(32)])
        row = (row & LOW).astype(np.int64)
        row = row[told[row] | ~(head & np.append(head[1:], True))]  # asked once, by a block that knows of one class: not shared
        if not len(row):
            return
        key, own, told = key[row], own[row], told[row]
        order = np.lexsort((own, key))
        key, own, told = key[order], own[order], told[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        fresh = head | np.concatenate([[True], own[1:] != own[:-1]]) | told  # a class may ask from several blocks
        first = np.flatnonzero(head)
        classes = np.add.reduceat(fresh.astype(np.int64) + told, first)  # a block that knows has two at least
        shared = (np.repeat(classes, np.diff(np.append(first, len(key)))) > 1) & fresh & ~told
        out = _answers(own[shared], key[shared], groups)
        if out is not None:
            yield out.select(["group", "blob"])

    return run


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The spans of bytes as a binary column."""
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    at = np.arange(total) - np.repeat(stop - size - start, size)
    offsets = np.concatenate([[0], stop]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())])


CANDIDATES = "id long, class long, whole string, text binary, key long, start long, string binary"


def _classes():
    """(group, class, other hash, id, text) -> the same, equal texts of a batch once with their least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            a, b, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            order = np.lexsort((ids, b, a))
            new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[: len(order)]
            first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            for k in np.flatnonzero(~new).tolist():  # a copy has the same bytes, not just the same hashes
                new[k] = not batch.column(4)[int(order[k])].equals(batch.column(4)[int(order[first[k]])])
            yield batch.take(pa.array(np.sort(order[new])))

    return run


def _candidates(window: int, buckets: int):
    """A group's classes and answers -> a row for each class (its least id), and one for each candidate string."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tidy()
        names = [f.split()[0] for f in CANDIDATES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds)))
        shared_own, shared_key = [np.zeros(0, np.int64)], [np.zeros(0, U)]
        for blob in answers["blob"].to_pylist():
            n = len(blob) // 16
            shared_own.append(np.frombuffer(blob, np.int64, n))
            shared_key.append(np.frombuffer(blob, U, n, 8 * n))
        pair = lambda i, k: mix(k ^ mix(i.astype(np.int64).view(U) + U(99)))  # noqa: E731  a clash only makes a further candidate
        shared = np.append(np.sort(pair(np.concatenate(shared_own), np.concatenate(shared_key))), U(2**64 - 1))
        out = []
        for batch in _classes()(docs.combine_chunks().to_batches()):
            own, ids = batch["class"].to_numpy(), batch["id"].to_numpy()
            for a, b, data, off in slices(batch["text"]):
                key, doc, first, count = minimizers(data, off, window)
                want = pair(own[a:b][doc], ((key >> U(32)) * U(buckets)) >> U(32) << U(32) | key & LOW)
                at = np.searchsorted(shared, want)
                hit = (shared[at] == want) & (at < len(shared) - 1)
                key, doc, first, count = key[hit], doc[hit], first[hit], count[hit]
                pieces = -(-count // LONGEST)
                row = np.repeat(np.arange(len(count)), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = first[row] + nth * LONGEST
                size = np.minimum(count[row] - nth * LONGEST, LONGEST) + window - 1
                some = np.zeros(b - a, bool)
                some[doc] = True
                texts = [data[off[i] : off[i + 1]].tobytes() for i in range(b - a)]
                n, m = b - a, len(row)
                out.append(pa.record_batch([
                    pa.array(ids[a:b]), pa.array(own[a:b]), pa.array([None if s else hashlib.sha256(t).hexdigest() for s, t in zip(some, texts)], pa.string()),
                    pa.array([t if s else None for s, t in zip(some, texts)], pa.binary()), *(pa.nulls(n, k) for k in kinds[4:]),
                ], schema=schema))
                if m:
                    out.append(pa.record_batch([
                        pa.array(ids[a:b][doc[row]]), pa.array(own[a:b][doc[row]]), pa.nulls(m, pa.string()), pa.nulls(m, pa.binary()),
                        pa.array(key[row].view(np.int64)), pa.array(begin - off[doc[row]]), _gather(data, begin, size),
                    ], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return run


def _labelled(window: int, data: np.ndarray, off: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """string, first window, end, label: runs of windows with one label."""
    labels = RunIndex(data, off, window).stream(least)
    size = np.diff(off)
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(labels)) - off[owner]
    head = np.ones(len(labels), bool)
    head[1:] = (labels[1:] != labels[:-1]) | (place[1:] == 0)
    first = np.flatnonzero(head)
    stop = np.append(first[1:], len(labels))
    fine = labels[first] != NONE
    first, stop = first[fine], stop[fine]
    who = owner[first]
    return who, first - off[who], stop - off[who], labels[first]


def _by_shard(work):
    """Batches sorted by their column shard -> ``work`` on tables of whole shards with SHARD bytes of strings or somewhat more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shards = batch["shard"].to_numpy()
            bytes_ = np.concatenate([[0], np.cumsum(np.diff(buffers(batch["string"])[1]))])
            new = np.flatnonzero(shards[1:] != shards[:-1]) + 1
            if held and held[-1]["shard"][-1].as_py() != shards[0]:
                new = np.concatenate([[0], new])
            done = 0
            while True:  # only between shards
                at = np.searchsorted(bytes_[new], bytes_[done] + SHARD - size) if len(new) else 0
                if at >= len(new):
                    break
                cut = int(new[at])
                yield work(pa.Table.from_batches([*held, batch.slice(done, cut - done)]).combine_chunks())
                held, size, done, new = [], 0, cut, new[at + 1 :]
            held.append(batch.slice(done))
            size += int(bytes_[-1] - bytes_[done])
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def _label(window: int):
    """Rows (shard, key, code, at, string, least) -> (key, code, first, stop, label): runs of windows with one label."""

    def work(table: pa.Table) -> pa.RecordBatch:
        key, code, at, least, shards = (table[c].to_numpy() for c in ("key", "code", "at", "least", "shard"))
        data, off = buffers(table["string"].chunk(0))
        size = np.diff(off)
        # a string that alone has its minimizer has nothing but itself to match
        edge = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
        lone = np.repeat(np.diff(np.append(edge, len(shards))) == 1, np.diff(np.append(edge, len(shards))))
        kept, own = np.flatnonzero(~lone), np.flatnonzero(lone)
        parts = [(own, np.zeros(len(own), np.int64), size[own] - window + 1, least[own])]
        if len(kept):
            stop = np.cumsum(size[kept])
            taken = data[np.arange(stop[-1]) - np.repeat(stop - size[kept] - off[kept], size[kept])]
            who, first, end, label = _labelled(window, taken, np.concatenate([[0], stop]), least[kept])
            parts.append((kept[who], first, end, label))
        who, first, end, label = (np.concatenate(c) for c in zip(*parts))
        return pa.record_batch([pa.array(x) for x in (key[who], code[who], first + at[who], end + at[who], label)], ["key", "code", "first", "stop", "label"])

    return _by_shard(work)


def _merged(window: int):
    """(id, class, first, stop) in the order of id and class -> (id, class, found): a text's spans of bytes, merged, as pairs of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held = [np.zeros(0, np.int64)] * 4  # what is found so far of the last text: a batch may end within it
        for batch in batches:
            if not batch.num_rows:
                continue
            id_, own, first, stop = (batch.column(i).to_numpy() for i in range(4))
            id_, own, first, stop = (np.concatenate(x) for x in zip(held, (id_, own, first, stop + (window - 1))))
            text = np.cumsum(np.concatenate([[False], (id_[1:] != id_[:-1]) | (own[1:] != own[:-1])]))
            base = text << 32  # a text has fewer bytes
            order = np.argsort(base | first, kind="stable")
            first, reach = first[order], np.maximum.accumulate((base | stop)[order])
            new = np.flatnonzero(np.concatenate([[True], (base | first)[1:] > reach[:-1]]))
            id_, own, text, first = id_[new], own[new], text[new], first[new]
            stop = reach[np.append(new[1:], len(reach)) - 1] & 0xFFFFFFFF
            last = int(np.searchsorted(text, text[-1]))
            held = [id_[last:], own[last:], first[last:], stop[last:]]
            if last:
                yield packed(id_[:last], own[:last], first[:last], stop[:last], text[:last])
        if len(held[0]):
            yield packed(*held, np.zeros(len(held[0]), np.int64))

    def packed(id_: np.ndarray, own: np.ndarray, first: np.ndarray, stop: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
        head = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        pairs = np.stack([first, stop], 1)
        blobs = [pairs[a:b].tobytes() for a, b in zip(head.tolist(), [*head[1:].tolist(), len(text)])]
        return pa.record_batch([pa.array(id_[head]), pa.array(own[head]), pa.array(blobs, pa.binary())], ["id", "class", "found"])

    return run


def _spans(want_kept: bool):
    """(id, n_bytes, short, whole, text, found) -> the result's row. No whole and no text: a copy of an earlier text."""
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            rows = []
            for doc, n, short, whole, text, found in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if short is not None or whole is not None:
                    rows.append((doc, n, 0, 0, short or whole, [], None))
                elif text is None:
                    rows.append((doc, n, n, 1, nothing, [[0, n]], b"" if want_kept else None))
                else:
                    spans = np.frombuffer(found or b"", np.int64).reshape(-1, 2).tolist()
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(text[at:a])
                        at = b
                    rest = b"".join([*kept, text[at:]])
                    rows.append((doc, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(rest).hexdigest(), spans, rest if want_kept and spans else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.record_batch(
                [*(pa.array(c, k) for c, k in zip(columns, kinds)), batch.column(6)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "text_hash"]
            )

    return run


def remove_shared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, want_kept: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256, spans (array of [start, end) in bytes), kept (with ``want_kept``: the bytes of
    documents that lose some, else null), text_hash (xxhash64 of the text's bytes, by which rows with one id are told apart) of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    rows, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    groups, buckets = 1 + max(rows // GROUP, size // GROUP_BYTES), max(8 * parts, size // BUCKET)
    long = own.filter((F.length("text") >= window) & F.col("id").isNotNull()).withColumn("class", F.xxhash64("text"))
    asked = long.select("class", "text").mapInArrow(_ask(window, buckets, groups), "part long, kind int, group long, blob binary")
    answers = scratch.cut(asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_answer(groups), "group long, blob binary"))
    held = long.select(F.pmod(F.xxhash64("class"), F.lit(groups)).alias("group"), "class", F.xxhash64("text", F.lit(1)).alias("other"), "id", "text")
    held = held.mapInArrow(_classes(), "group long, class long, other long, id long, text binary")
    found = scratch.cut(held.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(_candidates(window, buckets), CANDIDATES))

    hashes = F.xxhash64("string"), F.xxhash64("string", F.lit(1))
    places = found.filter("key is not null").select("id", "class", "key", hashes[0].alias("code"), "start")
    strings = found.filter("key is not null").groupBy("key", "string").agg(F.min("id").alias("least"))
    strings = scratch.cut(strings.withColumn("code", hashes[0]))
    crowded = scratch.cut(strings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("key", F.lit(True).alias("crowd")))
    if crowded.count() <= SENT:
        crowded = F.broadcast(crowded)
    dealt = strings.join(crowded, "key", "left")
    whole = dealt.filter("crowd is null").select(F.col("key").alias("shard"), "key", "code", F.lit(0).cast("long").alias("at"), "string", "least")
    cut = F.expr(f"transform(sequence(1, length(string) - {window - 1}), i -> struct(cast(i - 1 as bigint) as at, substring(string, i, {window}) as string))")
    single = dealt.filter("crowd").select("key", "code", "least", F.explode(cut).alias("w")).select("key", "code", "least", "w.*")
    windows = single.groupBy("string").agg(F.min("least").alias("least")).select(
        hashes[0].alias("shard"), hashes[0].alias("key"), hashes[1].alias("code"), F.lit(0).cast("long").alias("at"), "string", "least"
    )
    labels = scratch.cut(
        whole.unionByName(windows).repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_label(window), "key long, code long, first long, stop long, label long"),
    )
    of_single = single.select("key", "code", "at", hashes[0].alias("k"), hashes[1].alias("c")).join(
        labels.select(F.col("key").alias("k"), F.col("code").alias("c"), "label"), ["k", "c"]
    ).select("key", "code", F.col("at").alias("first"), (F.col("at") + 1).alias("stop"), "label")
    matched = places.join(labels.unionByName(of_single), ["key", "code"]).filter("label < id")
    spans = matched.select("id", "class", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("stop")).alias("stop"))
    gone = scratch.cut(spans.repartition("id").sortWithinPartitions("id", "class").mapInArrow(_merged(window), "id long, class long, found binary"))
    scratch.keep(found, gone)
    # one head and one list of spans for each id and text: neither copies nor rows that share an id multiply
    heads = found.filter("key is null").select("id", "class", "whole", "text")
    short = F.when((F.length("text") < window) | F.col("id").isNull(), F.sha2("text", 256))
    all_ = own.select("id", F.xxhash64("text").alias("class"), F.length("text").cast("long").alias("n_bytes"), short.alias("short"))
    out = all_.join(heads, ["id", "class"], "left").join(gone, ["id", "class"], "left").select("id", "n_bytes", "short", "whole", "text", "found", "class").mapInArrow(
        _spans(want_kept), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept binary, text_hash long"
    )
    return out.withColumnRenamed("id", id_col)


def text_without(kept: bytes) -> str:
    """Kept bytes as text: what is left of characters that a span has cut goes too."""
    return kept.decode("utf-8", "ignore")
