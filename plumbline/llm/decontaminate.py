"""Benchmark decontamination: CGK walks with bit-sampled keys over windows, exact seeds for the rest, exact edit verification.

Texts are compared in lower case with every run of blanks and punctuation (Unicode's; ASCII's signs too) as one space. An item of n bytes may
have e = ``MAX_SHARE`` * n edits. Four steps find it:

1. Windows. e edits spoil at most 10 * e of an item's substrings of 10 bytes, so the item can only begin where a window
   of its size holds the rest of them. A table of fixed size has the size classes whose items have a substring.
2. Walks. A CGK walk reads a string with one pointer: at each step it puts out the byte under it and moves on or not, as a random
   bit for (step, byte) says. Two strings a few edits apart fall in step again, so their walks differ in few places: edit distance
   becomes Hamming distance. Items are embedded in overlapping parts of bounded length that begin at words (three quarters of the shortest item of
   the class, ``PART`` bytes at most), so recall does not fall with the length. Windows of that size at the words of step 1 are embedded as well.
3. Keys. Each of ``WALKS`` independent walks gives ``KEYS`` keys of ``SAMPLED`` sampled places. Any equal key makes a candidate.
4. Verification. The edit distance between the item and the best matching stretch of the document is computed exactly and
   must be at most ``MAX_SHARE`` of the item's length.

Keys reach a high recall, not all of it, so with ``exact`` (the default) seeds add what they miss: an item cut into e + 1 pieces has
one that no edit touches, so the first ``SEED`` bytes of some piece (``SHORT_SEED`` where pieces are shorter) stand in the
document unaltered. They are looked up at every place and verified alike; with them no pair within the distance is missed.

Items so short that the share allows no edit (up to 16 bytes) must stand between word borders. Scripts that put no
blanks between words have a border at each of their characters.

Items are taken in blocks of at most ``BLOCK_ITEMS`` different texts and about ``BLOCK_BYTES``, each against all
documents, so what a task holds is bounded however large the benchmark is.

Defined results: a null or empty text holds nothing; an item that is null or has nothing but blanks and
punctuation matches nothing; one of a single word matches every document with that word; items of equal text are
reported each; of stretches that overlap the closest is reported; repeated documents get their rows each; an empty
table of either kind gives an empty table. Only ids and texts are read.
"""

from __future__ import annotations

import bisect
import re
import string
import sys
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep_rows, narrow, per_batch, texts
from plumbline.session import materialise

MAX_SHARE = 0.06
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 4_000_000
GRAM = 10
TABLE_BITS = 22
CLASS_RATIO = 1.15
SEED = 12  # the shortest piece of any item from 36 bytes on
SHORT_SEED = 8  # the shortest piece of any item that may have an edit
PART = 64  # bytes of a part that is embedded, at most
STRIDE = 24  # parts of one item begin at least so many bytes apart
WALKS, KEYS, SAMPLED = 8, 4, 6
STEPS = PART * 3 // 2
PLACES = 4_096  # windows that are embedded at once
PAIRS = 200_000  # places of pieces that are judged at once
CHAINED = 4  # blocks that one scan of the documents meets one after another in ``unleaked``
_TO_SPACE = bytes.maketrans((string.punctuation + string.whitespace).encode(), b" " * len(string.punctuation + string.whitespace))
_BLANKS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isspace() or c in "\u200b\u2060\ufeff" or unicodedata.category(c)[0] in "PZ")
# Scripts without blanks between words: Thai to Tibetan, Myanmar, Khmer, Tai, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u3005-\u3007\u3021-\u318f\u31a0-\u9fff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str) -> bytes:
    lower = text.lower()
    if not lower.isascii():
        for c in _BLANKS.intersection(lower):
            lower = lower.replace(c, " ")
    return b" ".join(lower.encode().translate(_TO_SPACE).split())


def border(data: bytes, at: int) -> bool:
    """Whether a word of the normalised text may begin or end at ``at``, which is between two characters."""
    if at in (0, len(data)) or data[at] == 32 or data[at - 1] == 32:
        return True
    if data[at] < 128 and data[at - 1] < 128:
        return False
    before, after = data[max(0, at - 4) : at].decode(errors="ignore"), data[at : at + 4].decode(errors="ignore")
    return bool(_UNSPACED.match(before[-1:]) or _UNSPACED.match(after[:1]))


def heads(data: bytes, size: int) -> np.ndarray:
    """The first ``size`` bytes, up to 8, at each place as a number; zeros stand after the end."""
    long = data + bytes(8)
    out = np.empty(len(data), np.uint64)
    for k in range(min(8, len(data))):
        out[k::8] = np.frombuffer(long, "<u8", (len(long) - k) // 8, k)[: len(out[k::8])]
    return out & np.uint64((1 << 8 * size) - 1)


def hashes(data: bytes, size: int) -> np.ndarray:
    """A hash of each stretch of ``size`` bytes, from 8 to 16."""
    n = len(data) - 7
    if n <= size - 8:
        return np.empty(0, np.uint64)
    eight = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        eight[k::8] = np.frombuffer(data, np.uint64, (len(data) - k) // 8, k)[: len(eight[k::8])]
    return eight[: n - size + 8] * _MULTIPLY + eight[size - 8 :] * _MULTIPLY_2


def slots(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def grams(data: bytes) -> np.ndarray:
    """The place in the bit table of each stretch of ten bytes."""
    return slots(hashes(data, GRAM))


def edits(length: int) -> int:
    return int(MAX_SHARE * length)


def piece_starts(length: int) -> np.ndarray:
    pieces = edits(length) + 1
    return np.arange(pieces) * length // pieces


def least_grams(length: int) -> int:
    """Stretches of ten bytes of an item that its allowed edits leave at least."""
    return length - GRAM + 1 - GRAM * edits(length)


def size_class(length: int) -> int:
    return int(np.log(length * MAX_SHARE) / np.log(CLASS_RATIO))


@dataclass(frozen=True)
class Bounds:
    """Of a size class: its shortest item, how far a window may reach, and the substrings of an item it has at least."""

    shortest: int
    reach: int
    least: int

    @staticmethod
    def of(lengths: list[int]) -> Bounds:
        return Bounds(min(lengths), max(n + edits(n) for n in lengths) + 1, max(0, min(map(least_grams, lengths))))


def distance(item: bytes, text: bytes) -> tuple[int, int]:
    """Edit distance between ``item`` and the stretch of ``text`` closest to it, and where that stretch ends.

    Bit-parallel: the differences down a column of the dynamic-programming table are the bits of two integers.
    """
    m = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (~(x | up) & full), up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (~((eq | down) | plus) & full), plus & (eq | down)
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Lookup:
    """Hashes in order, with the item that each is of and where in the item it begins."""

    hashes: np.ndarray
    owners: np.ndarray
    places: np.ndarray

    @staticmethod
    def of(found: list[np.ndarray], owners: list[np.ndarray], places: list[np.ndarray]) -> Lookup:
        hashed = np.concatenate([np.empty(0, np.uint64), *found])
        order = np.argsort(hashed, kind="stable")
        owner, place = (np.concatenate([np.empty(0, np.int32), *x]).astype(np.int32) for x in (owners, places))
        return Lookup(hashed[order], owner[order], place[order])

    def begins(self, here: np.ndarray, at: np.ndarray, out: dict[int, list[np.ndarray]]) -> None:
        """Add to ``out``, for each item with one of the hashes ``here``, which stand ``at`` places, where the item would begin."""
        left, right = np.searchsorted(self.hashes, here, "left"), np.searchsorted(self.hashes, here, "right")
        at, left, right = at[right > left], left[right > left], right[right > left]
        if not len(at):
            return
        ends = np.cumsum(right - left)
        for low in range(0, int(ends[-1]), PAIRS):
            pair = np.arange(low, min(low + PAIRS, int(ends[-1])))
            row = np.searchsorted(ends, pair, "right")
            entry = right[row] - (ends[row] - pair)
            owner, begin = self.owners[entry], at[row] - self.places[entry]
            order = np.argsort(owner, kind="stable")
            owner, begin = owner[order], begin[order]
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for who, part in zip(owner[np.concatenate([[0], cuts])].tolist(), np.split(begin, cuts)):
                out.setdefault(who, []).append(np.unique(part))


@dataclass
class Seeds:
    """The first ``size`` bytes of pieces, and a table of what stands among them."""

    size: int
    lookup: Lookup
    seeded: np.ndarray

    @staticmethod
    def of(size: int, items: list[tuple[int, bytes]]) -> Seeds:
        begins = [piece_starts(len(item)) for _, item in items]
        found = [hashes(item, size)[at] for (_, item), at in zip(items, begins)]
        lookup = Lookup.of(found, [np.full(len(at), owner) for (owner, _), at in zip(items, begins)], begins)
        seeded = np.zeros(1 << TABLE_BITS, bool)
        seeded[slots(lookup.hashes)] = True
        return Seeds(size, lookup, seeded)

    def begins(self, data: bytes, out: dict[int, list[np.ndarray]]) -> None:
        here = hashes(data, self.size)
        at = np.flatnonzero(self.seeded[slots(here)])
        self.lookup.begins(here[at], at, out)


def anchors(data: bytes) -> np.ndarray:
    """Where a character begins at the start, after a blank or beside a byte that isn't ASCII."""
    raw = np.frombuffer(data, np.uint8)
    begins = np.ones(len(data), bool)
    begins[1:] = ((raw[:-1] == 32) | (raw[:-1] >= 128) | (raw[1:] >= 128)) & ((raw[1:] & 0xC0) != 0x80)
    return np.flatnonzero(begins)


def _random_walks() -> tuple[np.ndarray, np.ndarray]:
    """Whether a walk moves on, by step, walk and byte; and random numbers to draw the sampled steps from."""
    r = np.random.default_rng(20)
    return r.integers(0, 2, (STEPS, WALKS * 256), np.int64), r.random((WALKS, KEYS, SAMPLED))


_MOVES, _DRAWN = _random_walks()


def walk_keys(data: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Keys of the windows of ``size`` bytes at ``places``, a row each. ``data`` has ``STEPS`` zeros behind its bytes."""
    steps = size * 3 // 2
    walk = np.arange(WALKS) * 256
    pointer = np.repeat(places[:, None], WALKS, axis=1)
    put_out = np.empty((steps, len(places), WALKS), np.uint8)
    for step in range(steps):
        value = data[pointer]
        put_out[step] = value
        pointer += _MOVES[step][value + walk]
    sampled = (_DRAWN * steps).astype(np.int64)
    keys = np.broadcast_to(np.arange(1, WALKS * KEYS + 1, dtype=np.uint64).reshape(WALKS, KEYS), (len(places), WALKS, KEYS)) * _MULTIPLY_2
    for k in range(SAMPLED):
        # Of every walk and key, the byte put out at its k-th sampled step.
        taken = put_out[sampled[:, :, k], :, np.arange(WALKS)[:, None]]
        keys = (keys ^ np.moveaxis(taken, 2, 0).astype(np.uint64)) * _MULTIPLY
        keys ^= keys >> np.uint64(29)
    return keys.reshape(len(places), WALKS * KEYS)


def padded(data: bytes) -> np.ndarray:
    return np.concatenate([np.frombuffer(data, np.uint8), np.zeros(STEPS + 1, np.uint8)]).astype(np.int16)


@dataclass
class Embedding:
    """Keys of the items of a size class, from parts of ``size`` bytes."""

    size: int
    lookup: Lookup

    @staticmethod
    def of(shortest: int, items: list[tuple[int, bytes]]) -> Embedding:
        size = min(PART, shortest * 3 // 4)
        found, owners, places = [], [], []
        for owner, item in items:
            starts: list[int] = []
            for at in anchors(item).tolist():
                if at <= len(item) - size and (not starts or at >= starts[-1] + min(STRIDE, size // 3)):
                    starts.append(at)
            at = np.array(starts)
            found.append(walk_keys(padded(item), at, size).ravel())
            places.append(np.repeat(at, WALKS * KEYS))
            owners.append(np.full(len(places[-1]), owner))
        return Embedding(size, Lookup.of(found, owners, places))

    def begins(self, data: np.ndarray, at: np.ndarray, out: dict[int, list[np.ndarray]]) -> None:
        for low in range(0, len(at), PLACES):
            some = at[low : low + PLACES]
            self.lookup.begins(walk_keys(data, some, self.size).ravel(), np.repeat(some, WALKS * KEYS), out)


@dataclass
class Block:
    """Items of one block with the keys of their parts, their pieces and the bit table of their substrings."""

    items: dict[int, bytes]
    ids: dict[int, list[int]]
    seeded: bool = True
    classes: list[int] = field(default_factory=list)
    bounds: dict[int, Bounds] = field(default_factory=dict)
    table: np.ndarray | None = None
    seeds: list[Seeds] = field(default_factory=list)
    embeddings: dict[int, Embedding] = field(default_factory=dict)
    exact: dict[bytes, int] = field(default_factory=dict)
    heads: dict[int, np.ndarray] = field(default_factory=dict)
    sizes: dict[int, dict[int, list[int]]] = field(default_factory=dict)

    def prepare(self) -> "Block":
        self.table = np.zeros(1 << TABLE_BITS, np.uint32)
        by_class: dict[int, list[int]] = {}
        for number, item in self.items.items():
            if not edits(len(item)):
                self.exact[item] = number
                continue
            by_class.setdefault(size_class(len(item)), []).append(number)
        self.classes = sorted(by_class)
        self.bounds = {number: Bounds.of([len(self.items[m]) for m in members]) for number, members in by_class.items()}
        pieces: dict[int, list[tuple[int, bytes]]] = {}
        for k, number in enumerate(self.classes):
            for member in by_class[number]:
                item = self.items[member]
                self.table[grams(item)] |= np.uint32(1 << k % 32)
                size = SEED if len(item) // (edits(len(item)) + 1) >= SEED else SHORT_SEED
                pieces.setdefault(size, []).append((member, item))
            self.embeddings[number] = Embedding.of(self.bounds[number].shortest, [(member, self.items[member]) for member in by_class[number]])
        # Items of 17 to 19 bytes may keep no substring, so that any place is a window; seeds alone find them.
        unfiltered = {m for number in self.classes if not self.bounds[number].least for m in by_class[number]}
        wanted = {size: [(m, item) for m, item in found if self.seeded or m in unfiltered] for size, found in pieces.items()}
        self.seeds = [Seeds.of(size, found) for size, found in sorted(wanted.items()) if found]
        # Of short items: by the number of bytes of a head (8 or all) the lengths of the items with each head.
        self.sizes = {}
        for item in self.exact:
            size = min(8, len(item))
            lengths = self.sizes.setdefault(size, {}).setdefault(int.from_bytes(item[:size], "little"), [])
            if len(item) not in lengths:
                lengths.append(len(item))
        self.heads = {size: np.array(sorted(found), np.uint64) for size, found in self.sizes.items()}
        return self

    def matches(self, values: list[str]) -> list[tuple[int, int, int, int, int]]:
        """Number of the text, item, edit distance, and start and end of the stretch in the normalised text."""
        return [(number, *match) for number, value in enumerate(values) for match in self.found(normal(value))]

    def found(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """Item, edit distance, start and end of all matches in one normalised text."""
        return self.short(data) + self.close(data)

    def holds(self, value: str) -> bool:
        """Whether a text has a match."""
        data = normal(value)
        return bool(self.short(data) or self.close(data))

    def short(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """Items too short for an edit, between word borders."""
        if not self.exact or not data:
            return []
        starts = anchors(data)
        whole = heads(data, 8)[starts]
        out: list[tuple[int, int, int, int]] = []
        for size, known in self.heads.items():
            here = whole & np.uint64((1 << 8 * size) - 1)
            for k in np.flatnonzero(np.isin(here, known)).tolist():
                start = int(starts[k])
                for length in self.sizes[size][int(here[k])]:
                    owner, end = self.exact.get(data[start : start + length]), start + length
                    if owner is not None and end <= len(data) and border(data, start) and border(data, end):
                        out += [(number, 0, start, end) for number in self.ids[owner]]
        return out

    def close(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """Items that may have edits."""
        looked_at = dict(self.windows(data))
        begins: dict[int, list[np.ndarray]] = {}
        filtered = {number: places for number, places in looked_at.items() if self.bounds[number].least}
        if filtered:
            words, values = anchors(data), padded(data)
            for number, places in filtered.items():
                before = np.searchsorted(places, words, "right") - 1
                inside = (before >= 0) & (words - places[before] < self.bounds[number].reach)
                self.embeddings[number].begins(values, words[inside], begins)
        if looked_at:
            for seeds in self.seeds:
                seeds.begins(data, begins)
        out = []
        for who in sorted(begins):
            places = looked_at.get(size_class(len(self.items[who])))
            if places is not None:
                # An item begins within its edits of the place that a piece says.
                told, allowed = np.unique(np.concatenate(begins[who])), edits(len(self.items[who]))
                near = np.searchsorted(places, told + allowed, "right") > np.searchsorted(places, told - allowed, "left")
                out += self.verified(data, who, told[near].tolist())
        return out

    def windows(self, data: bytes) -> list[tuple[int, np.ndarray]]:
        """For each size class, the places at which a window holds enough of the items' substrings."""
        if len(data) < GRAM:
            return []
        masks = self.table[grams(data)]
        known = np.flatnonzero(masks)
        masks = masks[known]
        out = []
        for k, number in enumerate(self.classes):
            least, reach = self.bounds[number].least, self.bounds[number].reach
            if not least:
                out.append((number, np.arange(len(data))))
                continue
            hits = known[(masks >> np.uint32(k % 32)) & np.uint32(1) == 1]
            if len(hits) < least:
                continue
            # ``least`` hits in a row lie in the windows that begin from ``reach`` before the last of them to the first.
            first, last = hits[: len(hits) - least + 1], hits[least - 1 :]
            fits = last - reach < first
            if fits.any():
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, np.maximum(last[fits] - reach + 1, 0), 1)
                np.add.at(change, first[fits] + 1, -1)
                out.append((number, np.flatnonzero(np.cumsum(change[:-1]) > 0)))
        return out

    def verified(self, data: bytes, owner: int, places: list[int]) -> list[tuple[int, int, int, int]]:
        """Matches of an item that begins about one of ``places`` (in order), apart from each other.

        Places within twice the edits are verified as one: two stretches that fit there overlap.
        """
        item = self.items[owner]
        allowed = edits(len(item))
        own = grams(item)
        close: list[tuple[int, int, int]] = []
        at = 0
        while at < len(places):
            first = last = places[at]
            while at < len(places) and places[at] <= first + 2 * allowed:
                last = places[at]
                at += 1
            low, high = max(0, first - allowed), last + len(item) + allowed
            region = data[low:high]
            if np.isin(own, grams(region)).sum() < least_grams(len(item)):
                continue
            best, end = distance(item, region)
            if best <= allowed:
                _, back = distance(item[::-1], region[:end][::-1])
                close.append((best, low + end - back, low + end))
        taken: list[tuple[int, int, int]] = []
        for best, start, end in sorted(set(close)):
            k = bisect.bisect(taken, start, key=lambda x: x[0])
            if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
                taken.insert(k, (start, end, best))
        return [(number, best, start, end) for start, end, best in taken for number in self.ids[owner]]


def blocks(benchmark: DataFrame, key: str, text: str, exact: bool = True) -> list[Block]:
    """The items in blocks of bounded size, ordered by id. Items of equal normal text are looked for once."""
    out: list[Block] = []
    owners: dict[bytes, int] = {}
    size = 0
    rows = narrow(benchmark, F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    for row in rows.orderBy("id").toLocalIterator():
        item = normal(row.t)
        if not item:
            continue
        if not out or len(out[-1].items) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            out.append(Block({}, {}, exact))
            owners, size = {}, 0
        size += len(item) * (item not in owners)
        owner = owners.setdefault(item, len(owners))
        out[-1].items[owner] = item
        out[-1].ids.setdefault(owner, []).append(row.id)
    return out


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    exact: bool = True,
) -> DataFrame:
    """One row for each stretch of a document that is a benchmark item but for a few edits.

    ``key``, ``item_id``, ``distance`` (edits), ``start`` and ``end`` (bytes in the normalised text). Without ``exact``
    candidates come from the walks' keys alone.
    """
    schema = f"`{key}` long, item_id long, distance long, start long, end long"
    found = None
    for block in blocks(benchmark, item_key, item_text, exact):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(batch: pa.RecordBatch, shared=shared) -> dict:
            here = prepared(shared.value)
            rows = [(batch.column(0)[i].as_py(), *match) for i, *match in here.matches(list(texts(batch, 1)))]
            names = [key, "item_id", "distance", "start", "end"]
            return {n: [row[k] for row in rows] for k, n in enumerate(names)}

        part = per_batch(narrow(docs, F.col(key).cast("long").alias(key), F.col(text)), schema, work)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def unleaked(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", exact: bool = True
) -> DataFrame:
    """The rows of ``docs``, with their columns, in which ``leaks`` finds no item.

    Each row is judged by its own text: ids may repeat or be null. A text rejected by one block isn't looked at by the next; what
    ``CHAINED`` blocks have left is stored.
    """
    place, left = docs.columns.index(text), docs
    for number, block in enumerate(blocks(benchmark, item_key, item_text, exact)):
        if number and number % CHAINED == 0:
            left = materialise(left, "unleaked")
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def wanted(batch: pa.RecordBatch, shared=shared) -> list[bool]:
            here = prepared(shared.value)
            return [not here.holds(value) for value in texts(batch, place)]

        left = keep_rows(left, wanted)
    return left


_prepared: dict[int, Block] = {}


def prepared(block: Block) -> Block:
    """The block with its tables, made once in each Python worker; only the last one used is kept."""
    if _prepared.get("block") is not block:
        _prepared.clear()
        _prepared["block"] = block
        block.prepare()
    return block
