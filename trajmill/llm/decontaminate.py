"""Finding benchmark items in documents, also when they were edited.

* **Seeds.**  An item is cut into pieces, so many that a stretch within the limit holds one with one
  edit at most.  Two or three pieces are a part, and two or three parts a group; that piece can be
  chosen so that its part and its group have fewer edits than two a piece.  All strings within one
  edit of a piece are in a table of hashes; each text is looked up in it at every character, and
  the part and then the group are aligned around what is found.  No pair within the limit is
  without a seed.
* **Windows.**  Windows of the item's length are laid at the seeds.
* **CGK embedding.**  Windows and items become strings of bytes by a random walk: at each step the
  current character is written, and random bits of the step and character decide whether to go on
  to the next one.  The walks of similar strings meet again soon after an edit, so a small edit
  distance becomes a small Hamming distance.
* **Bit sampling.**  Each repetition reads ``SAMPLED`` random positions of the embedded strings and
  hashes them; a window is a candidate for the items whose hash it shares.  The number of
  repetitions follows from the target recall and the share of equal positions that items edited
  up to the limit have, which is measured on the items themselves; it has no upper limit.
* **Verification.**  Candidates are aligned exactly (bit-parallel edit distance of the item against
  the document's part; parts that overlap are one), and reported if the distance is at most
  ``EDITS`` of the item's length.  The seeds of pairs that bit sampling has not found are aligned
  afterwards, so its recall decides on no pair.

Items are read in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from trajmill import scratch
from trajmill.llm.arrow import map_rows
from trajmill.operators.spread import broadcast_if_small

#: Characters of a piece at most; six of them, a group, fit into a machine word, and three, a part, into half of one.
PIECE = 10
#: Seeds whose diagonals differ by less are one.
DIAGONALS = 4
#: Characters between texts that are searched together, more than a seed's place can be wrong by.
GAP = 16
EDITS = 0.2
SAMPLED = 2
RECALL = 0.99
LEAST_ITEM_WORDS = 5
#: Characters of items that are sent to the tasks at once; a task holds about 600 bytes for each.
BLOCK_CHARS = 128 << 10
_WORD = re.compile(r"[^\W_]+")
_MODEL_EDITS = 200
_BIT = np.uint8(1) << np.arange(8, dtype=np.uint8)
#: Characters of texts that are searched together, and windows that are embedded together.
TOGETHER = 1 << 18
EMBEDDED = 1024
#: Hashes that are put into a table together.
KEYS = 1 << 16
#: Groups that are aligned together.
ALIGNED = 1 << 14
#: Fewer alignments than this are done one by one.
FEW = 48


def normalise(text: str | None) -> str:
    """Words in lower case with single spaces between them."""
    return " ".join(_WORD.findall((text or "").lower()))


class Embedding:
    """CGK walks of strings up to a length, and the positions that each repetition reads."""

    def __init__(self, length: int, repetitions: int) -> None:
        random = np.random.default_rng(42)
        self.steps = 2 * length  # a walk takes two steps a character; no later position is read
        self.bits = random.integers(0, 2, size=(self.steps, 256), dtype=np.int64)
        self.positions = random.integers(0, 1 << 30, size=(repetitions, SAMPLED))
        self.mix = random.integers(1, 1 << 62, size=(repetitions, SAMPLED)) | 1

    def walks(self, strings: list[bytes]) -> np.ndarray:
        """A row of ``2 * length`` bytes for each string; 0 after its end."""
        width = max(map(len, strings)) + 1
        text = np.zeros((len(strings), width), dtype=np.int64)
        for row, string in enumerate(strings):
            text[row, : len(string)] = np.frombuffer(string, dtype=np.uint8)
        at, row = np.zeros(len(strings), dtype=np.int64), np.arange(len(strings))
        out = np.zeros((len(strings), self.steps), dtype=np.uint8)
        for step in range(min(self.steps, 2 * width)):
            char = text[row, at]
            out[:, step] = char
            at = np.minimum(at + self.bits[step, char], width - 1)
        return out

    def keys(self, strings: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Per string and repetition a hash of the sampled positions, which lie within the walk of an item of that length."""
        walked = self.walks(strings)
        out = np.zeros((len(strings), len(self.positions)), dtype=np.int64)
        for sample in range(SAMPLED):
            place = self.positions[None, :, sample] % (2 * lengths[:, None])
            out += (walked[np.arange(len(strings))[:, None], place].astype(np.int64) + 1) * self.mix[None, :, sample]
        return out


def _edited(item: bytes, share: float, random: np.random.Generator) -> bytes:
    """The item with so many random character edits."""
    out = bytearray(item)
    for _ in range(int(share * len(item))):
        at, kind = int(random.integers(0, max(1, len(out)))), random.integers(0, 3)
        if kind == 0 and out:
            out[at] = int(random.integers(97, 123))
        elif kind == 1:
            out.insert(at, int(random.integers(97, 123)))
        elif out:
            del out[at]
    return bytes(out)


def repetitions(items: list[bytes], edits: float, recall: float) -> int:
    """How many repetitions find an item with that share of edits as often as wanted.

    Measured on random edits of characters of the items, at most ``_MODEL_EDITS`` of them.
    """
    random = np.random.default_rng(7)
    chosen = [items[int(i)] for i in random.integers(0, len(items), size=_MODEL_EDITS)]
    embedding = Embedding(max(map(len, chosen)), 256)
    lengths = np.array([len(i) for i in chosen])
    same = embedding.keys(chosen, lengths) == embedding.keys([_edited(i, edits, random) for i in chosen], lengths)
    hit = np.clip(same.mean(axis=1), 1e-3, 0.999)  # per item
    return next(n for n in count(8, 8) if 1 - np.mean((1 - hit) ** n) >= recall)


def edit_distance_within(item: str, part: str, limit: int | None = None) -> tuple[int, int]:
    """The least edit distance of the item to any stretch of ``part``, and where the first such stretch ends.

    With a limit, the search ends as soon as no distance up to it can follow; a larger one is
    then returned.  The distance changes by one a column at most.
    """
    where: dict[str, int] = defaultdict(int)
    for bit, char in enumerate(item):
        where[char] |= 1 << bit
    full, last = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, distance, left = full, 0, len(item), len(part)
    best, end = distance, 0
    for at, char in enumerate(part, 1):  # bit-parallel columns; a stretch may begin anywhere
        equal = where.get(char, 0)
        vertical = equal | minus
        horizontal = ((((equal & plus) + plus) ^ plus) | equal) & full
        up, down = (minus | ~(horizontal | plus)) & full, plus & horizontal
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(vertical | up)) & full, up & vertical
        if distance < best:
            best, end = distance, at
        elif limit is not None and distance - left + at > limit and (best > limit or best <= distance - left + at):
            break
    return best, end


def edit_distances_within(pairs: list[tuple[str, str, int]]) -> list[tuple[int, int]]:
    """``edit_distance_within`` of many triples: those of about one length share their columns as arrays."""
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    groups: dict[int, list[int]] = defaultdict(list)
    for at, (item, part, _) in enumerate(pairs):
        groups[-(-len(item) // 64) if len(part) <= 4 * len(item) else 0].append(at)
    for blocks, members in groups.items():
        letters = np.unique(_points("".join({pairs[at][0] for at in members}))) if blocks else []
        size = min(2048, (4 << 20) // (blocks * (len(letters) + 1))) if blocks else 0
        members.sort(key=lambda at: len(pairs[at][1]))
        for first in range(0, len(members), size or len(members)):
            chosen = members[first : first + (size or len(members))]
            if not blocks or len(chosen) < FEW:  # arrays would be too short to pay
                found = [edit_distance_within(*pairs[at]) for at in chosen]
            else:
                found = _columns([pairs[at][:2] for at in chosen], blocks, letters)
            for at, result in zip(chosen, found, strict=True):
                out[at] = result
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _columns(pairs: list[tuple[str, str]], blocks: int, letters: np.ndarray) -> list[tuple[int, int]]:
    """Bit-parallel columns in blocks of 64 rows, for items of one number of blocks at once."""
    n, one, top = len(pairs), np.uint64(1), np.uint64(63)
    items = {item: at for at, item in enumerate(dict.fromkeys(item for item, _ in pairs))}
    equal = np.zeros((blocks, len(letters) + 1, len(items)), dtype=np.uint64)  # the last letter is in no item
    for item, at in items.items():
        row = np.arange(len(item))
        np.bitwise_or.at(equal[:, :, at], (row >> 6, np.searchsorted(letters, _points(item))), one << (row & 63).astype(np.uint64))
    lengths = np.array([len(item) for item, _ in pairs])
    widths = np.array([len(part) for _, part in pairs])
    width = int(widths.max())
    points = _points("".join(part for _, part in pairs))
    place = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
    classes = np.full((n, width), len(letters), dtype=np.int32)
    classes[np.arange(width) < widths[:, None]] = np.where(letters[place] == points, place, len(letters))
    classes = np.ascontiguousarray(classes.T)
    tables, own = [table.ravel() for table in equal], np.array([items[item] for item, _ in pairs])
    last = ((lengths - 1) & 63).astype(np.uint64)
    plus, minus = np.full((blocks, n), ~np.uint64(0)), np.zeros((blocks, n), dtype=np.uint64)
    distance, best, end = lengths.copy(), lengths.copy(), np.zeros(n, dtype=np.int64)
    none = np.zeros(n, dtype=np.uint64)
    for column in range(width):
        cell = classes[column] * len(items) + own
        up = down = none  # a stretch may begin anywhere
        for block in range(blocks):
            p, m, eq = plus[block], minus[block], tables[block].take(cell)
            vertical = eq | m
            eq |= down
            horizontal = (((eq & p) + p) ^ p) | eq
            ups, downs = m | ~(horizontal | p), p & horizontal
            if block == blocks - 1:
                distance += ((ups >> last) & one).astype(np.int64) - ((downs >> last) & one).astype(np.int64)
            ups_in, downs_in, up, down = up, down, ups >> top, downs >> top
            ups, downs = (ups << one) | ups_in, (downs << one) | downs_in
            plus[block] = downs | ~(vertical | ups)
            minus[block] = ups & vertical
        better = np.flatnonzero((distance < best) & (column < widths))
        best[better], end[better] = distance[better], column + 1
    return list(zip(best.tolist(), end.tolist(), strict=True))


class Seeds:
    """Where parts of items occur in texts with few edits."""

    _BASE = 0x9E3779B97F4A7C15
    _LOW = np.uint64((1 << 20) - 1)  # of a key: the piece; above it: the hash

    def __init__(self, items: list[str], edits: float) -> None:
        points = [_points(item) for item in items]
        letters = np.unique(np.concatenate(points))
        self.classes = np.zeros(int(letters[-1]) + 2, dtype=np.uint16)  # 0 is in no item
        self.classes[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        pieces, parts, groups = [], [], []  # item, begin, length, edits and the number one level up
        for index, item in enumerate(items):
            number = min(max(int(edits * len(item)) // 2 + 1, -(-len(item) // PIECE)), len(item))
            bounds = [len(item) * at // number for at in range(number + 1)]
            # Edits and one, summed up over all pieces, parts or groups, are more than the edits of the item.
            row = lambda a, b, above: (index, bounds[a], bounds[b] - bounds[a], 2 * (b - a) - 1, above)  # noqa: B023, E731
            for first, last in _cut(0, number, -(-number // 6)):
                for begin, end in _cut(first, last, max(1, (last - first) // 2)):
                    pieces += [row(at, at + 1, len(parts)) for at in range(begin, end)]
                    parts.append(row(begin, end, len(groups)))
                groups.append(row(first, last, 0))
        self.pieces = _Level(pieces)
        self.levels = [_Level(parts, points, self.classes, self.width, np.uint32), _Level(groups, points, self.classes, self.width, np.uint64)]
        coded = [self.classes[p].astype(np.uint64) + np.uint64(1) for p in points]
        self.powers, self.inverses = self._powers(PIECE + 2)
        texts = {}
        for length in np.unique(self.pieces.lengths).tolist():
            numbers = np.flatnonzero(self.pieces.lengths == length)
            texts[length] = numbers, np.stack([coded[pieces[i][0]][pieces[i][1] : pieces[i][1] + length] for i in numbers.tolist()])
        self.tables = {}
        for size in range(int(self.pieces.lengths.min()) - 1, int(self.pieces.lengths.max()) + 2):
            keys = self._keys(size, texts)
            if len(keys):
                self.tables[size] = _Table(keys, self._LOW)

    def _keys(self, size: int, texts: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Hashes with numbers of pieces of all strings of that length; written into one array, as there are hundreds a character of the items."""
        sources = [(*texts[size - change], change) for change in (1, 0, -1) if size - change in texts]
        rows = {-1: lambda n: n, 0: lambda n: n * self.width, 1: lambda n: (n - 1) * self.width}
        keys, at = np.empty(sum(len(text) * rows[change](text.shape[1]) for _, text, change in sources), dtype=np.uint64), 0
        for numbers, text, change in sources:
            for hashes in self._near(text, change):
                part = keys[at : at + hashes.size].reshape(hashes.shape)
                np.bitwise_and(hashes, ~self._LOW, out=part)
                part |= numbers.astype(np.uint64)[:, None]
                at += hashes.size
        return keys

    def _powers(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse, modulo 2^64."""
        powers, inverses = np.full(number, self._BASE, dtype=np.uint64), np.full(number, pow(self._BASE, -1, 1 << 64), dtype=np.uint64)
        powers[0] = inverses[0] = 1
        return np.cumprod(powers, dtype=np.uint64), np.cumprod(inverses, dtype=np.uint64)

    def _near(self, text: np.ndarray, change: int) -> Iterator[np.ndarray]:
        """Hashes of all strings within one edit of each row, with that change of length; a letter before the first or after the last is left away."""
        n, length = text.shape
        base, back, power = np.uint64(self._BASE), self.inverses[1], self.powers
        before = np.zeros((n, length + 1), dtype=np.uint64)
        np.cumsum(text * power[:length], axis=1, out=before[:, 1:])
        whole = before[:, -1:]
        if change < 0:
            yield before[:, :-1] + (whole - before[:, 1:]) * back  # a letter less
            return
        for at in range(change, length):
            letters = np.arange(1, self.width + 1, dtype=np.uint64) * power[at]
            if change:
                yield before[:, at : at + 1] + (whole - before[:, at : at + 1]) * base + letters  # a letter more
            else:
                yield (whole - text[:, at : at + 1] * power[at]) + letters  # another letter

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, about where it would begin (at most ``DIAGONALS`` later) and about a place inside, of each seed."""
        n = len(points)
        classes = self.classes[np.minimum(points, len(self.classes) - 1)]
        if n > len(self.powers):
            self.powers, self.inverses = self._powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((classes + np.uint64(1)) * self.powers[:n], out=sums[1:])
        keys = []
        for size, table in self.tables.items():
            if size <= n:
                last = n - size + 1
                place, piece = table.find((sums[size:] - sums[:last]) * self.inverses[:last] if last > 1 else sums[-1:] - sums[:1])
                keys.append(self.pieces.above[piece] << 40 | (place - self.pieces.begins[piece] + (1 << 36)) // DIAGONALS)
        margin = max(level.reach for level in self.levels)
        padded = np.pad(classes, margin)
        key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        for level in self.levels:
            key.sort()
            key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
            number, begin = key >> 40, (key & ((1 << 40) - 1)) * DIAGONALS - (1 << 36)
            near = level.near(padded, number, begin + margin)
            number, begin = number[near], begin[near]
            key = level.above[number] << 40 | (begin + (1 << 36)) // DIAGONALS
        return level.items[number], begin, begin + level.begins[number] + level.lengths[number] // 2


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct values of a sorted array, moved to its beginning."""
    end, last = 0, None
    for at in range(0, len(keys), KEYS):
        part = keys[at : at + KEYS]
        new = part[np.append(last is None or part[0] != last, part[1:] != part[:-1])]
        last = part[-1].copy()
        keys[end : end + len(new)] = new
        end += len(new)
    return keys[:end]


class _Table:
    """Hashes and, in their low bits, the numbers of the pieces that they are made of."""

    def __init__(self, keys: np.ndarray, low: np.uint64) -> None:
        """``keys`` is sorted in its place, and all else is made a part at a time: many workers build the table at once."""
        keys.sort()
        self.low, self.keys = low, _distinct(keys)
        self.shift = np.uint64(64 - max(16, (16 * len(self.keys)).bit_length()))
        self.coarse = self.shift + np.uint64(4)  # about one key in each range of hashes
        self.sieve = np.zeros(1 << (61 - int(self.shift)), dtype=np.uint8)
        self.firsts = np.zeros((1 << (64 - int(self.coarse))) + 1, dtype=np.int32)
        for at in range(0, len(self.keys), KEYS):
            part = self.keys[at : at + KEYS]
            place = part >> self.shift
            byte, bit = place >> np.uint64(3), _BIT[place & np.uint64(7)]
            first = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
            self.sieve[byte[first]] |= np.bitwise_or.reduceat(bit, first)
            slot = (part >> self.coarse).astype(np.int64)
            counts = np.bincount(slot - slot[0])
            self.firsts[slot[0] + 1 : slot[0] + 1 + len(counts)] += counts.astype(np.int32)
        np.cumsum(self.firsts, dtype=np.int32, out=self.firsts)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` and the pieces with that hash."""
        slot = (hashes >> self.shift).view(np.int64)
        place = np.flatnonzero(self.sieve.take(slot >> 3, mode="clip") & _BIT.take(slot & 7, mode="clip"))
        value = hashes.take(place) & ~self.low
        slot = (value >> self.coarse).view(np.int64)
        low = self.firsts.take(slot)
        sizes = self.firsts.take(slot + 1) - low
        of = np.repeat(np.arange(len(place)), sizes)
        keys = self.keys.take(np.arange(len(of)) + np.repeat(low - np.cumsum(sizes) + sizes, sizes))
        hit = np.flatnonzero((keys ^ value.take(of)) <= self.low)
        return place[of[hit]], (keys[hit] & self.low).astype(np.int64)


class _Level:
    """Stretches of items of a machine word of characters, with the edits that each may have."""

    def __init__(self, rows: list[tuple], points: list[np.ndarray] | None = None, classes: np.ndarray | None = None, width: int = 0, word: type = np.uint64) -> None:
        self.items, self.begins, self.lengths, self.edits, self.above = np.array(rows).T
        self.spans = self.lengths + 2 * self.edits + DIAGONALS
        self.reach = int((self.begins + self.spans).max())
        self.width, self.word = width, word
        self.equal = np.zeros((len(rows), width), dtype=word)
        for row, (item, begin, length, _, _) in enumerate(rows if width else ()):
            np.bitwise_or.at(self.equal[row], classes[points[item][begin : begin + length]], word(1) << np.arange(length, dtype=word))
        self.equal = self.equal.ravel()

    def near(self, padded: np.ndarray, numbers: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Which stretches occur within their edits in a text, if their item would begin there or up to ``DIAGONALS`` later."""
        one, out, word = self.word(1), [], self.word
        for at in range(0, len(numbers), ALIGNED):
            own = numbers[at : at + ALIGNED]
            spans = self.spans[own]
            place = np.clip(begins[at : at + ALIGNED] + self.begins[own] - self.edits[own], 0, len(padded) - int(spans.max()))
            row, last = own * self.width, (self.lengths[own] - 1).astype(word)
            plus, minus = np.full(len(own), ~word(0)), np.zeros(len(own), dtype=word)
            distance = self.lengths[own].astype(np.int32)
            best = distance.copy()
            for column in range(int(spans.max())):
                eq = self.equal.take(row + padded.take(place + column, mode="clip"), mode="clip")
                horizontal = (((eq & plus) + plus) ^ plus) | eq
                ups, downs = minus | ~(horizontal | plus), plus & horizontal
                distance += ((ups >> last) & one).astype(np.int32)
                distance -= ((downs >> last) & one).astype(np.int32)
                np.minimum(best, distance, out=best)
                ups, downs, vertical = ups << one, downs << one, eq | minus
                plus, minus = downs | ~(vertical | ups), ups & vertical
            out.append(at + np.flatnonzero(best <= self.edits[own]))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _cut(begin: int, end: int, number: int) -> Iterator[tuple[int, int]]:
    """So many parts of about one length."""
    bounds = [begin + (end - begin) * at // number for at in range(number + 1)]
    return zip(bounds, bounds[1:], strict=False)


class Finder:
    """Looks for a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], edits: float, recall: float) -> None:
        self.items = [(number, text, text.encode()) for number, text in items]
        self.edits = edits
        encoded = [b for _, _, b in self.items]
        self.count = repetitions(encoded, edits, recall)
        self.embedding = Embedding(max(map(len, encoded)), self.count)
        self.seeds = Seeds([text for _, text in items], edits)
        self.lengths = np.array([len(b) for b in encoded])
        values = self._buckets(encoded, self.lengths).ravel()
        order = np.argsort(values, kind="stable")
        self.buckets, self.members = values[order], order // self.count
        self.bucket_sieve = _sieve(self.buckets)
        self.waiting: list[tuple] = []
        self.chars = 0

    def __call__(self, row: tuple) -> Iterator[tuple]:
        """Id, item number, distance, item length, start and end in the normalised text; the best place of each item.

        Results of several texts come together, when there is enough text to search.
        """
        self.waiting.append((row[0], normalise(row[1])))
        self.chars += len(self.waiting[-1][1]) + GAP
        if self.chars >= TOGETHER:
            yield from self.rest()

    def rest(self) -> Iterator[tuple]:
        texts, self.waiting, self.chars = self.waiting, [], 0
        if not texts:
            return
        starts = np.cumsum([0] + [len(text) + GAP for _, text in texts])
        found, begin, place = self.seeds(_points(("\n" * GAP).join(text for _, text in texts)))
        own = np.maximum(np.searchsorted(starts - GAP // 2, place, side="right") - 1, 0)
        seeds = sorted(zip(own.tolist(), found.tolist(), (begin - starts[own]).tolist(), strict=True))
        proposed = self._proposed(texts, seeds)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for chosen in ([s for s in seeds if s[:2] in proposed], [s for s in seeds if s[:2] not in proposed]):
            begins: dict[tuple[int, int], list[int]] = defaultdict(list)
            for n, index, at in chosen:
                begins[n, index] += at, at + DIAGONALS
            places = [(n, index, *part) for (n, index), each in begins.items() for part in self._parts(index, each)]
            limits = [int(self.edits * len(self.items[index][1])) for _, index, _, _ in places]
            pairs = [(self.items[index][1], texts[n][1][first:end], limit) for (n, index, first, end), limit in zip(places, limits, strict=True)]
            for (n, index, first, _), limit, (distance, end) in zip(places, limits, edit_distances_within(pairs), strict=True):
                if distance <= limit and distance < best.get((n, index), (limit + 1,))[0]:
                    best[n, index] = distance, max(first, first + end - len(self.items[index][1])), first + end
        for (n, index), (distance, start, end) in sorted(best.items()):
            yield texts[n][0], self.items[index][0], distance, len(self.items[index][1]), start, end

    def _proposed(self, texts: list[tuple], seeds: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
        """Pairs of a text and an item that bit sampling finds in windows at the seeds."""
        windows = set()
        for n, index, at in seeds:
            text, at = texts[n][1], max(0, at)
            before, after = text.rfind(" ", 0, at) + 1, text.find(" ", at) + 1
            start = after if after and after - at < at - before else before  # the next word's start: edits shift it by a few characters
            windows.add((int(self.lengths[index]), n, start))
        out, ordered = set(), sorted(windows)
        for at in range(0, len(ordered), EMBEDDED):  # of similar length
            part = ordered[at : at + EMBEDDED]
            strings = [texts[n][1][start : start + length].encode()[:length] for length, n, start in part]
            out.update((part[window][1], index) for window, index in self._candidates(strings, np.array([w[0] for w in part])))
        return out

    def _buckets(self, strings: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Per string and repetition the bucket, which also says the length and the repetition."""
        keys = self.embedding.keys(strings, lengths)
        return keys ^ (lengths[:, None] * 0x9E3779B97F4A7 + np.arange(self.count)[None, :] * 0x2545F4914F6CD)

    def _candidates(self, strings: list[bytes], lengths: np.ndarray) -> list[list[int]]:
        """Pairs of a window and an item that share a bucket."""
        hits, found = _equal(self.buckets, self.bucket_sieve, self._buckets(strings, lengths).ravel())
        pairs = np.unique(hits // self.count * len(self.items) + self.members[found])
        return np.stack(np.divmod(pairs, len(self.items)), axis=1).tolist()

    def _parts(self, index: int, begins: list[int]) -> Iterator[tuple[int, int]]:
        """Stretches of a text around windows that begin there; those that overlap are one."""
        length = len(self.items[index][1])
        limit, at = int(self.edits * length), 0
        while at < len(begins):
            first = last = begins[at]
            while at < len(begins) and begins[at] - limit <= last + length + limit:
                last, at = begins[at], at + 1
            yield max(0, first - limit), last + length + limit


def _sieve(known: np.ndarray) -> np.ndarray:
    """Which low bits occur among the values, about one place in eight."""
    out = np.zeros(1 << max(16, int(8 * len(known)).bit_length()), dtype=bool)
    out[known & (len(out) - 1)] = True
    return out


def _equal(known: np.ndarray, sieve: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``values`` and in ``known``, which is sorted, with the same value."""
    maybe = np.flatnonzero(sieve[values & (len(sieve) - 1)])  # most values end here
    values = values[maybe]
    low = np.searchsorted(known, values)
    hits = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == values) if len(known) else low[:0]
    low = low[hits]
    sizes = np.searchsorted(known, values[hits], side="right") - low
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(maybe[hits], sizes), np.repeat(low, sizes) + inside


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``BLOCK_CHARS`` characters and one item, read one after another.

    Items of fewer than ``LEAST_ITEM_WORDS`` words and items without an id cannot leak.  Equal
    ids are read as one item each.
    """
    block, size = [], 0
    for row in benchmark.filter(F.col(item_id).isNotNull()).select(item_id, text).toLocalIterator():
        item = normalise(row[1])
        if item.count(" ") + 1 < LEAST_ITEM_WORDS:
            continue
        block.append((row[0], item))
        size += len(item)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, distance, item_chars, start, end, similarity`` of each item in each row of ``docs``.

    Places are those in the text's words in lower case with single spaces.  Null and empty texts
    have no leaks; rows that repeat give repeated results; null ids stay null.  Without items or
    documents the result is empty.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("item_id", benchmark.schema[item_id].dataType),
            T.StructField("distance", T.IntegerType()),
            T.StructField("item_chars", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
    spark = docs.sparkSession
    # Of null columns: an empty list would be turned into rows by Python workers of another kind, which stay beside the others.
    found = spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    for block in item_blocks(benchmark, item_id, item_text):
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK_CHARS characters

        leaks = map_rows(docs.select(F.col(doc_id), F.col(text)), lambda sent=sent: Finder(sent.value, edits, recall), schema, "rest")
        found = found.unionByName(leaks)
    return found.withColumn("similarity", 1 - F.col("distance") / F.col("item_chars"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no benchmark item.

    Rows are known by their text, so copies go together and null ids do not matter.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("h"), F.hash(text, F.lit(1)).alias("h2"))
    texts = docs.select(F.struct(F.xxhash64(text).alias("h"), F.hash(text, F.lit(1)).alias("h2")).alias("key"), F.col(text).alias("text"))
    leaks = find_leaks(texts, benchmark, doc_id="key", text="text", **options)
    leaks = scratch.materialize(leaks.select("doc_id.h", "doc_id.h2").distinct(), "leaks")
    return keyed.join(broadcast_if_small(leaks), ["h", "h2"], "left_anti").select("row.*")
