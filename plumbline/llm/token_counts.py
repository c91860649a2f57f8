"""Token counts by a compiled finite-state transducer.

The tokenizer of a ``.json`` file (byte-level BPE) is compiled, as transitions come up, to a deterministic
transducer over bytes. Reading one byte, it emits by how much the count of tokens changes. Greedy merging has a
local property that makes the states finite: a sequence of tokens is the tokenizer's result exactly if it is so
for every two neighbours. The last token of a prefix is therefore the one suffix of it that is a token and fits
the last token of what stands before. A future token can reach back over the longest suffix that starts some
longer token, and no further, so a state is that suffix with the last tokens inside it and the counts relative
to now, as far as a token can still begin there.

A text is split into pieces first (words with their leading blank, runs of digits, signs, blanks), which
depends on the classes of a code point and its neighbours only and needs no state. Each piece starts the
transducer anew. Texts are laid end to end and cut into chunks of fixed length that run side by side, one
byte a step for all. A chunk maps the state that enters it to the state that leaves it and a count. From its
first piece on that map is constant, so it is computed at once for all chunks. A chunk inside a long piece has a true
map. It is computed for the states that can enter: the start state as a guess and all that leave the chunk before,
until no new one comes up, side by side for all chunks; walks soon fall in step, so that these are few. The maps
are then composed by a parallel prefix scan (jumps of doubling length), which gives the state that enters each chunk.

Defined results: a null or empty text has no bytes and no tokens; special strings inside a text count as one
token, as is the library's default; repeated rows are counted each; an empty table gives an empty table; only the
id and the text are read.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
import tokenizers
from pyspark.sql import DataFrame

from plumbline.llm.common import narrow, per_batch, texts, type_of

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CHUNK = 256  # bytes of a chunk
BATCH_CHARS = 2_000_000  # code points that are laid end to end at once
MAPPED = 16_384  # pairs of a chunk and an entering state that are run at once
MAX_STATES = 300_000  # compiled states that a worker keeps from one batch to the next
EMIT_BITS = 9
EMIT = 1 << EMIT_BITS  # a packed transition is next state * EMIT + emitted count + EMIT_ZERO
EMIT_ZERO = 500

BLANK, LETTER, DIGIT, SIGN, GAP, UNKNOWN = range(6)
# What an apostrophe may be followed by to form a piece of its own.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


class Classes:
    """The class of code points, asked of the library's own splitter when a code point first comes up."""

    def __init__(self, path: str) -> None:
        self.split = tokenizers.Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.table = np.full(0x110000, UNKNOWN, np.uint8)

    def __getitem__(self, points: np.ndarray) -> np.ndarray:
        kind = self.table[points]
        if (kind == UNKNOWN).any():
            for point in np.unique(points[kind == UNKNOWN]).tolist():
                joins = [len(self.split(beside + chr(point))) == 1 for beside in "a1!"]
                self.table[point] = (LETTER, DIGIT, SIGN)[joins.index(True)] if any(joins) else BLANK
            kind = self.table[points]
        return kind


def piece_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pieces start. ``kind`` has a GAP at both ends and between texts, which belongs to no piece."""
    before, after = np.roll(kind, 1), np.roll(kind, -1)
    point_before = np.roll(points, 1)
    blank = kind == BLANK
    first = blank & (before != BLANK)
    # The last blank of a run before something else stands alone, or leads the next piece if it is a space.
    last = blank & (before == BLANK) & (after != BLANK) & (after != GAP)
    other = ~blank & (kind != before) & ~((before == BLANK) & (point_before == 32))
    starts = (first | last | other) & (kind != GAP)

    quote = np.flatnonzero((points == 39) & starts & (kind != GAP))
    if len(quote):
        one = np.isin(points[quote + 1], [ord(c) for c in ONE_LETTER]) & (kind[quote + 1] == LETTER)
        second = points[np.minimum(quote + 2, len(points) - 1)]
        two = np.zeros(len(quote), bool)
        for a, b in TWO_LETTERS:
            two |= (points[quote + 1] == ord(a)) & (second == ord(b))
        for found, length in ((quote[one], 2), (quote[two & ~one], 3)):
            starts[found + 1] = False
            starts[found + length] = kind[found + length] != GAP
    return starts


class Transducer:
    """The compiled part of a tokenizer's transducer; it grows as bytes come up that no state has seen."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        if model["model"]["type"] != "BPE" or model["normalizer"] or model["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("only byte-level BPE without a normalizer can be compiled")
        letters = {c: b for b, c in byte_letters().items()}
        self.special = [t["content"] for t in model["added_tokens"]]
        ids = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.ids = ids
        self.bytes = {i: token for token, i in ids.items()}
        # Merged tokens are numbered in the order of their merges, so ids serve as ranks.
        self.merge = tiktoken.Encoding("merges", pat_str=r"(?s).+", mergeable_ranks=ids, special_tokens={})._core_bpe.encode_single_piece
        self.prefixes = {token[:n] for token in ids for n in range(len(token))}
        self.classes = Classes(path)
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[bytes, tuple[int, ...], tuple[int, ...]]] = [(b"", (-1,), (0,))]
        self.numbers = {self.states[0]: 0}
        self.columns = np.full(257, -1, np.int64)
        self.bytes_of_column: list[int] = []
        self.table = np.full((4096, 32), -1, np.int32)

    def add_bytes(self, values: np.ndarray) -> None:
        """Give every byte value a column. Value 256 stands for no byte and changes nothing."""
        new = [int(v) for v in values if self.columns[v] < 0]
        for v in new:
            self.columns[v] = len(self.bytes_of_column)
            self.bytes_of_column.append(v)
        width = -(-len(self.bytes_of_column) // 32) * 32
        if width > self.table.shape[1]:
            wide = np.full((len(self.table), width), -1, np.int32)
            wide[:, : self.table.shape[1]] = self.table
            self.table = wide

    def fit(self, left: int, right: int) -> bool:
        """Whether the tokenizer keeps the two tokens when they stand side by side."""
        if left < 0:
            return True
        key = (left, right)
        if key not in self.fits:
            self.fits[key] = self.merge(self.bytes[left] + self.bytes[right]) == [left, right]
        return self.fits[key]

    def follow(self, state: int, value: int) -> tuple[tuple, int]:
        """The state after one more byte, and the change of the count."""
        suffix, last, counts = self.states[state]
        suffix += bytes([value])
        for start in range(len(suffix)):
            token = self.ids.get(suffix[start:])
            # It begins after position start of the old suffix.
            if token is not None and self.fit(last[start], token):
                break
        change = counts[start] + 1
        last, counts = (*last, token), (*(c - change for c in counts), 0)
        drop = 0
        while suffix[drop:] not in self.prefixes:
            drop += 1
        suffix = suffix[drop:]
        # Positions from which no longer token can come don't matter any more.
        alive = [suffix[p:] in self.prefixes for p in range(len(suffix) + 1)]
        state = suffix, tuple(t if a else -2 for t, a in zip(last[drop:], alive)), tuple(c if a else 0 for c, a in zip(counts[drop:], alive))
        return state, change

    def fill(self, cells: np.ndarray) -> None:
        """Compile the transitions behind these cells of the table."""
        width = self.table.shape[1]
        for cell in cells.tolist():
            state, column = divmod(cell, width)
            value = self.bytes_of_column[column]
            if value == 256:
                self.table[state, column] = state * EMIT + EMIT_ZERO
                continue
            target, change = self.follow(state, value)
            number = self.numbers.get(target)
            if number is None:
                number = self.numbers[target] = len(self.states)
                self.states.append(target)
                if number == len(self.table):
                    self.table = np.concatenate([self.table, np.full((min(number, 65536), self.table.shape[1]), -1, np.int32)])
            self.table[state, column] = number * EMIT + change + EMIT_ZERO

    def run(self, columns: np.ndarray, resets: np.ndarray, states: np.ndarray, emitted: np.ndarray) -> np.ndarray:
        """Read ``columns`` (steps x chunks) from ``states``; counts go to ``emitted``. Returns the states at the end."""
        states = states.astype(np.int64)
        for step in range(len(columns)):
            states *= ~resets[step]
            cells = states * self.table.shape[1] + columns[step]
            packed = self.table.ravel()[cells]
            if packed.min(initial=0) < 0:
                self.fill(np.unique(cells[packed < 0]))
                packed = self.table.ravel()[cells]
            states = (packed >> EMIT_BITS).astype(np.int64)
            emitted[step] += ((packed & (EMIT - 1)) - EMIT_ZERO).astype(np.int16)
        return states

    def emissions(self, raw: np.ndarray, reset: np.ndarray) -> np.ndarray:
        """The change of the count at every byte. ``raw`` has byte values, 256 for none; ``reset`` where pieces start."""
        chunks = -(-len(raw) // CHUNK)
        padded = np.full(chunks * CHUNK, 256, np.int64)
        padded[: len(raw)] = raw
        self.add_bytes(np.unique(padded))
        resets = np.zeros(chunks * CHUNK, bool)
        resets[: len(raw)] = reset
        resets = np.ascontiguousarray(resets.reshape(chunks, CHUNK).T)
        columns = np.ascontiguousarray(self.columns[padded].reshape(chunks, CHUNK).T)
        emitted = np.zeros((CHUNK, chunks), np.int16)

        # Every chunk from its first piece on, whatever state enters it.
        head = np.where(resets.any(axis=0), resets.argmax(axis=0), CHUNK)
        body = np.where(np.arange(CHUNK)[:, None] >= head, columns, self.columns[256])
        leaving = self.run(body, resets, np.zeros(chunks, np.int64), emitted)

        # Chunks without a piece start get their leaving states and counts from the scan over their maps. No text ends in
        # a head, so its count may stand at its first byte.
        inner = np.flatnonzero(head == CHUNK)
        if len(inner):
            states, counts = self.scan(columns, inner, leaving)
            leaving[inner] = states
            emitted[0, inner] += counts.astype(np.int16)
        heads = np.flatnonzero((head > 0) & (head < CHUNK))
        for low in range(0, len(heads), MAPPED):
            some = heads[low : low + MAPPED]
            steps = int(head[some].max())
            part = np.where(np.arange(steps)[:, None] < head[some], columns[:steps, some], self.columns[256])
            own = np.zeros((steps, len(some)), np.int16)
            self.run(part, np.zeros_like(part, bool), np.where(some == 0, 0, leaving[some - 1]), own)
            emitted[0, some] += own.sum(axis=0, dtype=np.int16)
        return emitted.T.reshape(-1)[: len(raw)]

    def scan(self, columns: np.ndarray, inner: np.ndarray, leaving: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaving state and count of the chunks ``inner``, which have no piece start. ``leaving`` is right for all others."""
        starts = np.diff(inner, prepend=-2) != 1  # the first chunk of each run of such chunks
        before = np.where(inner == 0, 0, leaving[inner - 1])
        goes_on = np.append(~starts[1:], False)
        # Pairs of a chunk (by its number in inner) and an entering state, as one number each.
        limit = 1 << 32
        seeds = np.arange(len(inner)) * limit + np.where(starts, before, 0)
        known, left, counts = (np.empty(0, np.int64) for _ in range(3))
        fresh = seeds
        while len(fresh):
            ends, sums = [], []
            for low in range(0, len(fresh), MAPPED):
                chunk, state = np.divmod(fresh[low : low + MAPPED], limit)
                part = columns[:, inner[chunk]]
                own = np.zeros(part.shape, np.int16)
                ends.append(self.run(part, np.zeros_like(part, bool), state, own))
                sums.append(own.sum(axis=0, dtype=np.int64))
            known, left, counts = np.concatenate([known, fresh]), np.concatenate([left, *ends]), np.concatenate([counts, *sums])
            follow = fresh // limit
            fresh = np.unique(((follow + 1) * limit + np.concatenate(ends))[goes_on[follow]])
            fresh = fresh[~np.isin(fresh, known)]
        order = np.argsort(known)
        known, next_state, counts = known[order], left[order], counts[order]
        # The pair that follows each pair; the last chunk of a run leads to itself.
        chunk = known // limit
        jump = np.where(goes_on[chunk], np.searchsorted(known, (chunk + 1) * limit + next_state), np.arange(len(known)))
        # The scan: after k rounds the pairs of the first 2**k chunks of each run are known.
        nth = np.arange(len(inner)) - np.maximum.accumulate(np.where(starts, np.arange(len(inner)), 0))
        true = np.searchsorted(known, seeds)
        reach = 1
        while reach <= nth.max():
            new = np.flatnonzero((nth >= reach) & (nth < 2 * reach))
            true[new] = jump[true[new - reach]]
            jump, reach = jump[jump], 2 * reach
        return next_state[true], counts[true]

    def count(self, values: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        segments, owners = [], []
        totals = np.zeros(len(values), np.int64)
        for i, text in enumerate(values):
            parts = self.split(text)
            totals[i] += len(parts) - 1
            segments += parts
            owners += [i] * len(parts)
        if len(self.states) > MAX_STATES:
            self.clear()
        np.add.at(totals, owners, self.count_segments(segments))
        return totals

    def split(self, text: str) -> list[str]:
        """What stands between special strings, the first of them taken first as the library does."""
        if not any(s in text for s in self.special):
            return [text]
        return regex.split("|".join(map(regex.escape, self.special)), text)

    def count_segments(self, segments: list[str]) -> np.ndarray:
        """The number of tokens of each segment; the segments are laid end to end with gaps between."""
        line = "\0" + "\0".join(segments) + "\0"
        points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(s) + 1 for s in segments])
        kind = self.classes[points]
        kind[0] = GAP
        kind[ends] = GAP  # a NUL of a text itself stays a sign
        starts = piece_starts(points, kind)
        offset = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=offset[1:])
        raw = np.frombuffer(line.encode(), np.uint8).astype(np.int16)
        raw[offset[:-1][kind == GAP]] = 256
        reset = raw == 256
        reset[offset[:-1][starts]] = True
        running = np.cumsum(self.emissions(raw, reset), dtype=np.int64)
        return np.diff(running[offset[ends]], prepend=0)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_all(machine: Transducer, values: list[str]) -> list[int]:
    """Counts of many texts, laid end to end in portions of bounded size."""
    out: list[int] = []
    portion: list[str] = []
    size = 0
    for text in values:
        if portion and size + len(text) > BATCH_CHARS:
            out += machine.count(portion).tolist()
            portion, size = [], 0
        portion.append(text)
        size += len(text)
    return out + (machine.count(portion).tolist() if portion else [])


def token_counts(
    docs: DataFrame, limit: int = 1024, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every text."""

    def work(batch: pa.RecordBatch) -> dict:
        values = list(texts(batch, 1))
        counts = count_all(transducer(tokenizer), values)
        return {
            key: batch.column(0),
            "n_bytes": [len(v.encode()) for v in values],
            "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
        }

    schema = f"`{key}` {type_of(docs, key)}, n_bytes long, n_tokens long, over_limit boolean"
    return per_batch(narrow(docs, key, text), schema, work)
