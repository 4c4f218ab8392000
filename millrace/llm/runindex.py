"""A run-length index over a set of byte strings: run-compressed Burrows-Wheeler transform with sampled run ends.

``RunIndex`` is built in numpy over strings that each end in a separator of their own. It holds the transform's runs (letter,
first row, length), the text positions of each run's first and last row, and for the fixed length ``depth`` the first rows of the intervals
that agree in their first depth - 1 and depth letters. The suffix order that they come from is dropped. ``stream`` takes all strings letter by letter from their ends and
keeps the interval of the longest match of at most ``depth`` letters (bounded matching statistics): an interval is first
widened to depth - 1 letters and then extended by backward search on the runs. Which strings an interval lies in is read from the
samples: ``locate`` walks back from its last row to a sampled run end, and ``occurrences`` goes up row by row from there, as within a run the
row above has moved by as much as the run's first row has.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max


class RunIndex:
    def __init__(self, data: np.ndarray, off: np.ndarray, depth: int):
        """data, off: the strings' bytes and offsets. Strings should be short: sorting takes log2(longest) rounds."""
        if depth < 8:
            raise ValueError("depth is at least 8")
        self.depth = depth
        n_strings = len(off) - 1
        size = np.diff(off)
        n = len(data) + n_strings
        begin = off[:-1] + np.arange(n_strings)
        text = np.zeros(n, np.int64)  # 0: separator; letters are bytes + 1
        letters = np.ones(n, bool)
        letters[begin + size] = False
        text[letters] = data.astype(np.int64) + 1
        self.text, self.begin, self.size, self.n = text, begin, size, n
        suffixes, same_less, same = self._sorted(depth)
        # the transform, in runs; a string's first letter has a run of its own, as separators don't map back in order
        before = text[suffixes - 1]
        before[suffixes == 0] = 0
        head = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)]))
        letter, length = before[head], np.diff(np.append(head, n))
        self.head, self.length, self.letter = head, length, letter
        self.first_sample, self.last_sample = suffixes[head], suffixes[head + length - 1]  # text positions of the runs' first and last rows
        order = np.argsort(letter, kind="stable")
        self.run_letter, self.run_row, self.run_length = letter[order], head[order], length[order]
        self.run_key = self.run_letter * (n + 1) + self.run_row
        total = np.cumsum(self.run_length) - self.run_length
        first = np.searchsorted(self.run_letter, np.arange(258))
        base = np.append(total, self.run_length.sum())[first]
        self.run_before = total - base[self.run_letter]  # of the same letter, in earlier runs
        self.first_run = first
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=258))])  # rows that begin with a smaller letter
        before_head = np.empty(len(head), np.int64)
        before_head[order] = self.run_before
        self.back = self.smaller[letter] + before_head  # where a run's first row goes in a step back through the text
        self.wide_heads, self.heads = np.flatnonzero(~same_less), np.flatnonzero(~same)

    def _sorted(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text positions in suffix order; whether a row agrees with the one above in depth - 1, and in depth letters."""
        text, n = self.text, self.n
        used = np.bincount(text, minlength=257) > 0
        used[0] = True  # dense letters: 0 stays the separator
        dense = (np.cumsum(used) - 1)[text]
        wide = int(used.sum()).bit_length()
        places = max(1, int(n).bit_length())
        step = max(1, min((63 - places) // wide, depth // 2))
        code, ended = np.zeros(n, np.int64), np.zeros(n, bool)
        padded = np.concatenate([dense, np.zeros(step, np.int64)])
        for j in range(step):  # letters after the separator don't count
            x = padded[j : j + n]
            ended |= x == 0
            code = code << wide | np.where(ended, 0, x)
        # positions ride in the low bits: a sort of plain integers, with ties in the order of the text
        low = (1 << places) - 1
        order = np.sort(code << places | np.arange(n)) & low
        new = np.ones(n, bool)
        new[1:] = (code[order][1:] != code[order][:-1]) | ended[order][1:]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = start
        half = None
        while True:
            if half is None and 2 * step >= depth:
                half = (rank.astype(np.int32), step)
            alone = new & np.append(new[1:], True)
            at = np.flatnonzero(~alone)
            if not len(at):
                break
            rows = order[at]
            head = np.cumsum(new[at])  # which group of equal ranks
            second = np.where(rows + step < n, rank[np.minimum(rows + step, n - 1)] + 1, 0)
            bits = int(len(at)).bit_length()
            if 2 * bits + places + 1 < 64:
                key = np.sort((head << (places + 1) | second) << bits | np.arange(len(at)))
                by = key & ((1 << bits) - 1)
                key >>= bits
            else:
                key = head * (n + 2) + second
                by = np.argsort(key, kind="stable")
                key = key[by]
            rows = rows[by]
            order[at] = rows
            new[at[1:]] |= key[1:] != key[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank[rows] = start[at]
            step *= 2
        ranks, step = half if half is not None else (rank, step)
        above, here = order[:-1], order[1:]

        def agree(length: int) -> np.ndarray:
            rest = length - step
            near = ranks[above] == ranks[here]
            far = ranks[np.minimum(above + rest, n - 1)] == ranks[np.minimum(here + rest, n - 1)]
            return np.concatenate([[False], near & far])

        return order, agree(depth - 1), agree(depth)

    def rank(self, letter: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many rows above ``row`` have the letter in the transform."""
        run = np.searchsorted(self.run_key, letter * (self.n + 1) + row) - 1
        known = run >= self.first_run[letter]
        run = np.maximum(run, 0)
        return np.where(known, self.run_before[run] + np.minimum(row - self.run_row[run], self.run_length[run]), 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking backwards to sampled run ends; no walk is longer than a string."""
        out = np.empty(len(rows), np.int64)
        at, row, steps = np.arange(len(rows)), np.array(rows, np.int64), 0
        while len(at):
            run = np.searchsorted(self.head, row, "right") - 1
            ended = row == self.head[run] + self.length[run] - 1
            out[at[ended]] = self.last_sample[run[ended]] + steps
            at, row, run = at[~ended], row[~ended], run[~ended]
            row = self.back[run] + row - self.head[run]
            steps += 1
        return out

    def above(self) -> np.ndarray:
        """For each text position, that of the row above the position's row, from the samples: for a run's first row it is the end of the
        run before, and positions that follow a sampled one up to the next move along with it."""
        order = np.argsort(self.first_sample)
        sampled, ends = self.first_sample[order], np.concatenate([[-1], self.last_sample[:-1]])[order]
        reach = np.diff(np.append(sampled, self.n))
        out = np.repeat(ends - sampled, reach) + np.arange(sampled[0], self.n)
        return np.concatenate([np.zeros(sampled[0], np.int64), out])

    def least_label(self, labels: np.ndarray, intervals: np.ndarray) -> np.ndarray:
        """For each of these intervals of depth letters, the least label of the strings it lies in, over all its occurrences."""
        of = np.repeat(labels, self.size + 1)
        size = np.diff(np.append(self.heads, self.n))[intervals]
        place = self.locate(self.heads[intervals] + size - 1)
        least = of[place]
        left = np.flatnonzero(size > 1)
        if not len(left):
            return least
        above = self.above()
        place, k = place[left], 1
        while len(left):
            place = above[place]
            least[left] = np.minimum(least[left], of[place])
            k += 1
            more = size[left] > k
            left, place = left[more], place[more]
        return least

    def stream(self, labels: np.ndarray) -> np.ndarray:
        """For each byte of the strings, the least label of a string that holds the ``depth`` bytes from there on; NONE where fewer follow.
        Occurrences are looked up once for each interval that a string has ended in; in one of a single row only the asking string lies."""
        # row by row while the shard is streamed: what is kept are the intervals' first rows
        widest = np.repeat(self.wide_heads, np.diff(np.append(self.wide_heads, self.n)))
        rows = np.full(self.n, -1, np.int64)
        order = np.argsort(-self.size, kind="stable")
        size, stop = self.size[order], (self.begin + self.size)[order]
        row = np.zeros(len(order), np.int64)
        for j in range(1, int(size[0]) + 1 if len(size) else 1):
            active = int(np.searchsorted(-size, -j, "right"))
            row = row[:active]
            at = stop[:active] - j
            letter = self.text[at]
            if j > self.depth:
                row = widest[row]
            row = self.smaller[letter] + self.rank(letter, row)
            if j >= self.depth:
                rows[at] = row
        out = np.full(self.n, NONE, np.int64)
        at = np.flatnonzero(rows >= 0)
        spread = np.diff(np.append(self.heads, self.n))
        interval = np.repeat(np.arange(len(self.heads)), spread)[rows[at]]
        out[at] = np.repeat(labels, self.size + 1)[at]
        many = spread[interval] > 1
        at, interval = at[many], interval[many]
        asked = np.zeros(len(self.heads), bool)
        asked[interval] = True
        least = self.least_label(labels, np.flatnonzero(asked))
        out[at] = least[(np.cumsum(asked) - 1)[interval]]
        return out[self.text > 0]
