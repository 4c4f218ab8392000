"""Word-level BPE: a tokenizer file is read on the driver, words are split once and each distinct word of a batch is merged once.

``PairIndex`` merges by a pair occurrence index: each pair of symbols has the list of all its positions among
the batch's distinct words; ranks that are active are applied in ascending order to all their positions, and
the lists of the pairs that a merge makes are extended. Positions whose pair is gone are passed over.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from collections import defaultdict
from itertools import count, islice

import numpy as np
import regex
from tokenizers import Tokenizer

from millrace.llm.textbatch import U, mix

#: Code points for which the splitting below is known to agree with the library's; other texts are split by the library.
KNOWN = regex.compile(r"[^\x00-ԯ -⁯₠-₿　-ヿ一-龥가-힣]")
#: Texts within this are split in numpy, all texts of a batch at once, if the file has PATTERN.
LATIN = re.compile(r"[^\x00-\x1b\x20-\u052f]")
EDGE = 0x530
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, NUMBER, SIGN = range(4)
#: Code points of texts that are split together.
TOGETHER = 1 << 18
#: Stands between texts that are split together; texts that hold it or its neighbours are split one by one.
MARK = "\x1e"
#: Distinct words that a worker remembers from batch to batch; beyond that it begins anew.
REMEMBERED = 300_000
#: Slots in which short words are found without a look at each one.
SLOT_BITS = 19
NO_RANK = np.iinfo(np.int32).max
#: The lowest k bytes of a word.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def character_kinds() -> np.ndarray:
    """SPACE, LETTER, NUMBER or SIGN for code points below EDGE, as the pattern has them."""
    kinds = np.full(EDGE, SIGN, np.uint8)
    for kind, p in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        kinds[[c for c in range(EDGE) if regex.match(p, chr(c))]] = kind
    kinds[0x1C:0x20] = SPACE  # only as marks
    return kinds


KINDS = character_kinds()


def split_latin(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pattern's matches: runs of letters, single numbers, runs of signs, and the contractions first of all."""
    n = len(points)
    kind = KINDS[points]
    start = kind != SPACE
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    at = np.flatnonzero((points == 39) & start)
    if len(at):
        ahead = np.concatenate([points, np.zeros(4, points.dtype)])
        one, two = ahead[at + 1], ahead[at + 2]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        rest = at + size
        rest = rest[rest < n]
        start[rest[kind[rest] == LETTER]] = True
    marks = np.flatnonzero(start | (kind == SPACE))
    own = np.flatnonzero(start[marks])
    return marks[own], np.append(marks, n)[own + 1]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = count(0x100)
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Words:
    """Splits texts as the file's normaliser and pre-tokeniser do, and holds ids and decoded text of distinct words."""

    def __init__(self, spec: str, merged: str = "index"):
        data = json.loads(spec)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        pattern = next(x["pattern"]["Regex"] for x in data["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.fast = pattern == PATTERN
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        vocabulary = data["model"]["vocab"]
        self.end = data["model"]["end_of_word_suffix"]
        self.text_of = {v: k for k, v in vocabulary.items()} | {v: k for k, v in self.special.items()}
        letters = byte_letters()
        self.inner = np.array([vocabulary[x] for x in letters], np.int64)
        self.last = np.array([vocabulary[x + self.end] for x in letters], np.int64)
        self.to_letters = {i: x for i, x in enumerate(letters)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.merge = {vocabulary[a] << 20 | vocabulary[b]: r for r, (a, b) in reversed([*enumerate(pairs)])}
        self.parts = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        if merged == "index":
            self.encode_words = self.by_index
        else:
            self.made = np.array([x for _, _, x in self.parts], np.int64)
            codes = np.fromiter(self.merge, np.int64, len(self.merge))
            order = np.argsort(codes)
            self.codes, self.ranks = codes[order], np.fromiter(self.merge.values(), np.int32, len(codes))[order]
            self.merge, self.parts = {}, []
            self.encode_words = self.by_rounds
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes | tuple[str, str], int] = defaultdict(count().__next__)
        self.done = len(self.special)
        self.ids = np.array(list(self.special.values()), np.uint32)
        self.offsets = np.arange(self.done + 1)
        self.decoded: list[str] = []
        # where short words were last seen: their bytes, size and number, in the slot of their hash
        self.slots = np.zeros((4, 1 << SLOT_BITS), U)
        for name in self.special:
            self.number[("special", name)]  # noqa: B018  takes the next number

    def split(self, text: str) -> list:
        """The text's words in UTF-8; a special token is ("special", its content)."""
        if not self.special or "<|" not in text and not self.at_special.search(text):
            return self.plain(text)
        out: list = []
        for i, part in enumerate(self.at_special.split(text)):
            out += [("special", part)] if i % 2 else self.plain(part)
        return out

    def plain(self, text: str) -> list[bytes]:
        if not KNOWN.search(text):
            return [w.encode() for w in self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())]
        low = self.library.normalizer.normalize_str(text)
        return [low[a:b].encode() for a, b in self.library_spans(low)]

    def library_spans(self, text: str) -> list[tuple[int, int]]:
        return [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' words as numbers, and where each text's begin (one more entry than texts); afterwards ids, offsets and
        decoded hold every word seen."""
        if len(self.number) > REMEMBERED:
            self.forget()
        out: list = [None] * len(texts)
        held: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if self.fast and text and "<|" not in text and (text.isascii() or not LATIN.search(text)):
                held.append(i)
                size += len(text)
                if size >= TOGETHER:
                    self.number_latin(held, texts, out)
                    held, size = [], 0
            else:
                out[i] = self.number_words(self.split(text) if text else [])
        if held:
            self.number_latin(held, texts, out)
        if len(self.number) > self.done:
            self.learn(list(islice(reversed(self.number), len(self.number) - self.done))[::-1])
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in out], out=first[1:])
        return np.concatenate([np.zeros(0, np.int64), *out]), first

    def number_words(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def number_latin(self, rows: list[int], texts: list, out: list) -> None:
        """Numbers of the words of several texts at once. A word of up to 16 bytes is its own key, so those seen before are found in numpy
        and compared as a whole; others are looked up one by one."""
        joined = MARK.join([texts[i] for i in rows])
        if joined.isascii():
            raw = joined.lower().encode()
            points = np.frombuffer(raw, np.uint8)
        else:
            low = unicodedata.normalize("NFC", joined).replace("Σ", "σ").lower()
            raw = low.encode()
            points = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        marks = np.flatnonzero(points - 0x1C < 4)
        if len(marks) != len(rows) - 1 or points.max() >= EDGE:  # a mark of the text's own, or a lower-case form outside
            for i in rows:
                out[i] = self.number_words(self.split(texts[i]))
            return
        starts, ends = split_latin(points)
        cut = np.searchsorted(starts, marks)
        if len(raw) > len(points):
            at = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points >= 0x80), out=at[1:])
            starts, ends = at[starts], at[ends]
        for i, x in zip(rows, np.split(self.number_spans(raw, starts, ends), cut)):
            out[i] = x

    def number_spans(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        eights = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw + bytes(16), np.uint8), 8)
        size = ends - starts
        key = eights[starts].view("<u8").ravel() & LOW_BYTES[np.minimum(size, 8)]
        rest = np.zeros(len(key), U)
        longer = np.flatnonzero(size > 8)
        rest[longer] = eights[starts[longer] + 8].view("<u8").ravel() & LOW_BYTES[np.minimum(size[longer] - 8, 8)]
        length = size.astype(U)
        hashes = mix(key + rest * U(0x9E3779B97F4A7C15) + (length << U(57)))
        slot = (hashes >> U(64 - SLOT_BITS)).astype(np.int64)
        keys, rests, lengths, known = self.slots
        hit = (keys[slot] == key) & (rests[slot] == rest) & (lengths[slot] == length)
        numbers = known[slot].astype(np.int64)
        for at in np.flatnonzero(~hit & (size > 16)).tolist():
            numbers[at] = self.number[raw[starts[at] : ends[at]]]
        miss = np.flatnonzero(~hit & (size <= 16))
        if len(miss):
            _, first, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            chosen = miss[first]
            same = chosen[inverse]
            numbers[chosen] = self.number_words([raw[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist())])
            numbers[miss] = numbers[same]
            for at in miss[(key[miss] != key[same]) | (rest[miss] != rest[same]) | (size[miss] != size[same])].tolist():  # equal hashes of unequal words
                numbers[at] = self.number[raw[starts[at] : ends[at]]]
            slot = slot[chosen]
            for table, of in zip(self.slots, (key, rest, length, numbers.astype(U))):
                table[slot] = of[chosen]
        return numbers

    def learn(self, fresh: list[bytes]) -> None:
        flat, sizes = self.encode_words(fresh)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])
        self.done += len(fresh)

    def ids_of(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``numbers`` gives -> all texts' ids as unsigned 32 bits, and where each text's begin."""
        begin = self.offsets[numbers]
        size = self.offsets[numbers + 1] - begin
        stop = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(size, out=stop[1:])
        at = np.repeat(begin - stop[:-1], size)
        at += np.arange(len(at))
        return self.ids[at], stop[first]

    def text_from(self, numbers: np.ndarray) -> str:
        """What decoding gives: the file has no decoder, so the library puts a space between the tokens."""
        names, offsets = self.text_of, self.offsets
        for i in range(len(self.decoded), self.done):
            self.decoded.append(" ".join([names[x] for x in self.ids[offsets[i] : offsets[i + 1]].tolist()]))
        return " ".join(map(self.decoded.__getitem__, numbers.tolist()))

    def rank_of(self, code: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NO_RANK for those that don't merge."""
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.ranks[at], NO_RANK)

    def by_rounds(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by rounds over all of them at once: each round merges every word's pair of least rank."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        stop = np.cumsum(size)
        symbol[stop - 1] = self.last[data[stop - 1]]
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        rank = np.full(len(symbol), NO_RANK, np.int32)  # of a symbol and the next one of its word
        at = np.flatnonzero(word[1:] == word[:-1])
        rank[at] = self.rank_of(symbol[at] << 20 | symbol[at + 1])
        done_symbols, done_words = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        while len(symbol):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, head)
            count_ = np.diff(np.append(head, len(word)))
            least = np.repeat(least, count_)
            settled = least == NO_RANK
            done_symbols.append(symbol[settled])
            done_words.append(word[settled])
            symbol, word, rank, least = symbol[~settled], word[~settled], rank[~settled], least[~settled]
            at = np.flatnonzero(rank == least)
            if not len(at):
                break
            beside = np.concatenate([[False], np.diff(at) == 1])  # a run of one symbol merges two by two from the left
            if beside.any():
                begins = np.maximum.accumulate(np.where(beside, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begins) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            kept = np.ones(len(symbol), bool)
            kept[at + 1] = False
            at = at - np.arange(len(at))  # places after the compaction
            symbol, word, rank = symbol[kept], word[kept], rank[kept]
            changed = np.concatenate([at, at[at > 0] - 1])
            follows = changed + 1 < len(word)
            follows[follows] = word[changed[follows] + 1] == word[changed[follows]]
            rank[changed[~follows]] = NO_RANK
            changed = changed[follows]
            rank[changed] = self.rank_of(symbol[changed] << 20 | symbol[changed + 1])
        symbols, words = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        return symbols[order], np.bincount(words, minlength=len(raw))

    def by_index(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the pair occurrence index over all these words at once."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        stop = np.cumsum(size)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        symbol[stop - 1] = self.last[data[stop - 1]]
        n = len(symbol)
        after = np.arange(1, n + 1)
        after[stop - 1] = -1
        before = np.arange(-1, n - 1)
        before[stop - size] = -1
        merge, parts = self.merge, self.parts
        # positions of each pair, in ascending order
        at = np.flatnonzero(after >= 0)
        code = symbol[at] << 20 | symbol[after[at]]
        order = np.argsort(code, kind="stable")
        code, at = code[order], at[order]
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        active: dict[int, list[int]] = {}
        for a, b, c in zip(edge.tolist(), [*edge[1:].tolist(), len(code)], code[edge].tolist()):
            rank = merge.get(c)
            if rank is not None:
                active[rank] = at[a:b].tolist()
        heap = list(active)
        heapq.heapify(heap)
        symbols, nexts, prevs = symbol.tolist(), after.tolist(), before.tolist()
        rank_of, push = merge.get, heapq.heappush
        while heap:
            rank = heapq.heappop(heap)
            left, right, new = parts[rank]
            places = active.pop(rank)
            places.sort()  # overlapping pairs of equal symbols merge from the left
            high = new << 20
            for p in places:
                if symbols[p] != left:
                    continue
                q = nexts[p]
                if q < 0 or symbols[q] != right:
                    continue
                symbols[p] = new
                symbols[q] = -1
                r = nexts[p] = nexts[q]
                if r >= 0:
                    prevs[r] = p
                    made = rank_of(high | symbols[r])
                    if made is not None:
                        if made in active:
                            active[made].append(p)
                        else:
                            active[made] = [p]
                            push(heap, made)
                o = prevs[p]
                if o >= 0:
                    made = rank_of(symbols[o] << 20 | new)
                    if made is not None:
                        if made in active:
                            active[made].append(o)
                        else:
                            active[made] = [o]
                            push(heap, made)
        symbol = np.array(symbols, np.int64)
        alive = symbol >= 0
        return symbol[alive], np.add.reduceat(alive.astype(np.int64), stop - size)
