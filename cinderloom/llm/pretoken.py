"""Byte-level BPE words, cut and encoded for whole batches at once.

The word rule is that of byte-level BPE tokenizers: contractions, letters, digits, other signs (each with
one blank before it at most) and white space.  A batch is cut with array operations, equal words are found
by hash and then compared code point by code point, and only distinct words reach an encoder.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np

from .common import CHARS, prefix, ranges, stretch

NEVER, SPREAD, MASK64 = 0x7FFFFFFF, 0x9E3779B97F4A7C15, (1 << 64) - 1
LETTER, DIGIT, SIGN, BLANK = 0, 1, 2, 3
#: Code points with the Unicode property White_Space.
WHITE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: What may follow an apostrophe in a contraction.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


class Classes:
    """The class of each code point, settled by the tokenizers library when it is first met."""

    UNKNOWN = 255

    def __init__(self):
        from tokenizers import pre_tokenizers

        self.rule = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.known = np.full(0x110000, self.UNKNOWN, np.uint8)
        self.known[WHITE] = BLANK

    def _joins(self, points: list[int]) -> list[tuple[bool, bool]]:
        """Whether each code point stays with a letter, and with a digit, before it."""
        return [tuple(len(self.rule.pre_tokenize_str(x + chr(p))) == 1 for x in "a1") for p in points]

    def of(self, points: np.ndarray) -> np.ndarray:
        kind = self.known[points]
        if (new := kind == self.UNKNOWN).any():
            fresh = np.unique(points[new]).tolist()
            self.known[fresh] = [LETTER if a else DIGIT if b else SIGN for a, b in self._joins(fresh)]
            kind = self.known[points]
        return kind


@lru_cache(1)
def classes() -> Classes:
    return Classes()


def cut(points: np.ndarray, offsets: np.ndarray, kinds: Classes | None = None) -> np.ndarray:
    """Starts of the words of texts that stand one after the other; a word ends where the next starts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = (kinds or classes()).of(points)
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    start = opens[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start & (kind != BLANK) & ~opens[:n])
    after = after[kind[after - 1] == BLANK]
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    quote = np.flatnonzero(start & (points == 39))
    quote = quote[quote + 1 < n]
    quote = quote[~opens[quote + 1] & (kind[quote + 1] == LETTER)]
    one = points[quote + 1]
    far = np.minimum(quote + 2, n - 1)
    two = np.where((quote + 2 < n) & ~opens[np.minimum(quote + 2, n)], points[far], 0)
    size = np.zeros(len(quote), np.int64)
    for tail in CONTRACTIONS:
        hit = one == ord(tail[0])
        if len(tail) == 2:
            hit &= two == ord(tail[1])
        size[hit & (size == 0)] = 1 + len(tail)
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    tails = quote + size
    start[tails[tails < n]] = True
    return np.flatnonzero(start)


@lru_cache(1)
def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file: ids, merge ranks, bytes of each id, and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        signs, model = byte_signs(), whole["model"]
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        spell = {s: bytes(signs[c] for c in s) for s in model["vocab"] if s not in self.added}
        self.ids = {spell[s]: i for s, i in model["vocab"].items() if s in spell}
        size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.bytes = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.added.items():
            self.bytes[i] = s.encode()
        self.single = [self.ids[bytes([b])] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate((spell[x], spell[y]) for x, y in pairs)}

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the pair of lowest rank is merged first, from the left."""
        ids = [self.single[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.merges.get
        ranks = [get(p) for p in zip(ids, ids[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]))
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]))

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The merges as an open-addressing table for whole arrays of pairs: pair, rank, new id."""
        size = 1 << (4 * len(self.merges)).bit_length()
        pair, rank, new = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32), np.zeros(size, np.int32)
        for (a, b), (r, i) in self.merges.items():
            k = (a << 32) | b
            h = (k * SPREAD & MASK64) >> 40 & (size - 1)
            while pair[h] >= 0:
                h = (h + 1) & (size - 1)
            pair[h], rank[h], new[h] = k, r, i
        return pair, rank, new

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NEVER if it doesn't merge) and the id it merges to."""
        pair, rank, new = self.slots
        key = (left.astype(np.int64) << 32) | right
        at = ((key.astype(np.uint64) * np.uint64(SPREAD)) >> np.uint64(40)).astype(np.int64) & (len(pair) - 1)
        out_rank, out_new = np.full(len(key), NEVER, np.int32), np.zeros(len(key), np.int32)
        todo = np.arange(len(key))
        while len(todo):
            found = pair[at]
            hit = found == key[todo]
            out_rank[todo[hit]], out_new[todo[hit]] = rank[at[hit]], new[at[hit]]
            more = ~hit & (found >= 0)
            todo, at = todo[more], (at[more] + 1) & (len(pair) - 1)
        return out_rank, out_new

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many words at once: their ids, one word after the other, and the number of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [None] * len(words)
        for low, high in ((0, 8), (8, 12), (12, 16), (16, 24), (24, 40)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(rows, max(1, len(rows) // 20_000)):
                if len(part):
                    for i, x in zip(part.tolist(), self._merge_rows([words[i] for i in part.tolist()], sizes[part], high), strict=True):
                        out[i] = x
        out = [self.merge(w) if x is None else x for w, x in zip(words, out, strict=True)]
        count = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.uint32, int(count.sum())), count

    def _merge_rows(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[list[int]]:
        n = len(words)
        ids = np.full((n, width + 1), -1, np.int32)
        inside = np.arange(width + 1) < sizes[:, None]
        ids[inside] = np.asarray(self.single, np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        rank, new = np.full((n, width), NEVER, np.int32), np.zeros((n, width), np.int32)
        pairs = inside[:, 1:]
        rank[pairs], new[pairs] = self.ranks(ids[:, :-1][pairs], ids[:, 1:][pairs])
        done, rows, columns = ids.copy(), np.arange(n), np.arange(width + 1)
        while True:
            at = rank.argmin(1)
            line = np.arange(len(at))
            go = rank[line, at] != NEVER
            if not go.all():
                done[rows[~go]] = ids[~go]
                rows, ids, rank, new, at = rows[go], ids[go], rank[go], new[go], at[go]
                line = line[: len(at)]
            if not len(rows):
                return [x[x >= 0].tolist() for x in done]
            ids[line, at] = new[line, at]
            shift = columns[:-1] + (columns[:-1] > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = -1
            shift = np.minimum(columns[:-1] + (columns[:-1] >= at[:, None]), width - 1)
            rank, new = np.take_along_axis(rank, shift, 1), np.take_along_axis(new, shift, 1)
            rank[:, -1] = NEVER
            for side in (at - 1, at):
                ok = (side >= 0) & (side < width)
                l, c = line[ok], side[ok]
                right = ids[l, c + 1]
                r, i = self.ranks(ids[l, c], np.maximum(right, 0))
                rank[l, c], new[l, c] = np.where(right >= 0, r, NEVER), i

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for long words: a heap of pairs over a linked list."""
        import heapq

        n, get = len(ids), self.merges.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, r[1], new, ids[k]))
            if (h := before[i]) >= 0 and (r := get((ids[h], new))):
                heapq.heappush(heap, (r[0], h, r[1], ids[h], new))
        return [x for x in ids if x >= 0]


#: Words that the library gets in one text.
JOINED = 256
#: Code points of words that an encoder remembers (four bytes each), and of the longest of them that it keeps for long.
ROOM, KEPT = 1 << 24, 1 << 12


class BatchEncoder:
    """Encodes batches of texts; ``encode_words`` gets the distinct words that are not remembered.

    Remembered words are found by hash in an open-addressing table and then compared code point by code point.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], added: dict[str, int], remember: int = 400_000, kinds: Classes | None = None):
        if len(added) > 1:
            raise ValueError("one added token is supported")
        self.encode_words, self.added, self.remember, self.kinds = encode_words, added, remember, kinds
        self.forget()

    def forget(self) -> None:
        self.table, self.hashes = np.full(1 << 12, -1, np.int32), np.zeros(0, np.uint64)
        # For each word: its ids' place and number, its code points' place and number, and the batches that had it.
        self.first, self.count, self.at, self.size, self.met = (np.zeros(0, np.int64) for _ in range(5))
        self.flat, self.points, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32), [0, 0]

    def _shrink(self) -> None:
        """Keep the words that more than one batch had, half of the room at most, and none that is very long."""
        kept = np.flatnonzero((self.met > 1) & (self.size <= KEPT))
        kept = kept[np.argsort(-self.met[kept], kind="stable")[: self.remember // 2]]
        kept = np.sort(kept[np.cumsum(self.size[kept]) <= ROOM // 2])
        hashes, count, size = self.hashes[kept], self.count[kept], self.size[kept]
        ids, points = self.flat[ranges(self.first[kept], count)], self.points[ranges(self.at[kept], size)]
        self.forget()
        self._add(hashes, ids, count, points, size)

    def _append(self, name: str, which: int, values: np.ndarray) -> int:
        """The place of ``values`` in a growing array."""
        begin, end = self.used[which], self.used[which] + len(values)
        if end > len(getattr(self, name)):
            setattr(self, name, np.resize(getattr(self, name), 2 * end))
        getattr(self, name)[begin:end], self.used[which] = values, end
        return begin

    def _add(self, hashes: np.ndarray, ids: np.ndarray, count: np.ndarray, points: np.ndarray, size: np.ndarray) -> None:
        """Remember words with hashes that are new and distinct."""
        n, first, at = len(self.met), self._append("flat", 0, ids), self._append("points", 1, points)
        self.first = np.append(self.first, first + np.cumsum(count) - count)
        self.at = np.append(self.at, at + np.cumsum(size) - size)
        self.count, self.size, self.met = np.append(self.count, count), np.append(self.size, size), np.append(self.met, np.zeros(len(count), np.int64))
        self.hashes = np.append(self.hashes, hashes)
        if 4 * len(self.hashes) > len(self.table):
            self.table, n = np.full(1 << (8 * len(self.hashes)).bit_length(), -1, np.int32), 0
        todo = np.arange(n, len(self.hashes))
        at = self._places(self.hashes[todo])
        while len(todo):
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            left = self.table[at] != todo
            todo, at = todo[left], (at[left] + 1) & (len(self.table) - 1)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the word with each hash, or -1."""
        at = self._places(hashes)
        slot = self.table[at]
        todo = np.flatnonzero(slot >= 0)
        while len(todo := todo[self.hashes[slot[todo]] != hashes[todo]]):
            at[todo] = (at[todo] + 1) & (len(self.table) - 1)
            slot[todo] = self.table[at[todo]]
            todo = todo[slot[todo] >= 0]
        return slot

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each."""
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        return self._whole("".join(texts), offsets)

    def encode_utf8(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that stand one after the other in UTF-8."""
        before = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
        return self._whole(raw.tobytes().decode(), before[offsets])

    def _whole(self, whole: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Added tokens are found first, text by text; what lies between them is encoded by itself."""
        if not any(mark in whole for mark in self.added):
            return self._plain(whole, offsets)
        ((mark, number),) = self.added.items()
        parts = [whole[a:b].split(mark) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        flat = [p for ps in parts for p in ps]
        ends = np.zeros(len(flat) + 1, np.int64)
        np.cumsum([len(p) for p in flat], out=ends[1:])
        ids, at = self._plain("".join(flat), ends)
        last = np.cumsum([len(ps) for ps in parts])
        inner = np.setdiff1d(np.arange(1, len(flat)), last)  # parts that follow a mark in their text
        out = np.insert(ids, at[inner], number)
        return out.astype(np.uint32), np.append(0, at[last] + np.searchsorted(inner, last))

    def _plain(self, whole: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        start = cut(points, offsets, self.kinds)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(points))
        size, hashes = end - start, stretch(prefix(points, CHARS), start, end, CHARS)
        if len(self.met) > self.remember or self.used[1] > ROOM:
            self._shrink()
        slot = self._find(hashes)
        if len(new := np.flatnonzero(slot < 0)):
            kind, first = np.unique(hashes[new], return_index=True)
            first = new[first]
            ids, count = self.encode_words([whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            self._add(kind, ids, count, points[ranges(start[first], size[first])], size[first])
            slot[new] = self._find(hashes[new])
        there = np.zeros(len(self.met), bool)
        there[slot] = True
        self.met += there
        count, at, flat = self.count[slot], self.first[slot], self.flat
        if (other := self._others(points, size, slot)).any():  # another word has this word's hash
            odd = np.flatnonzero(other)
            ids, many = self.encode_words([whole[a:b] for a, b in zip(start[odd].tolist(), end[odd].tolist(), strict=True)])
            flat, count[odd], at[odd] = np.concatenate([flat, ids]), many, len(flat) + np.cumsum(many) - many
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        return flat[ranges(at, count)], total[np.searchsorted(start, offsets)]

    def _others(self, points: np.ndarray, size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which words differ from the remembered ones of their slots; words cover all of ``points``."""
        out = self.size[slot] != size
        if not out.any():
            wrong = points != self.points[ranges(self.at[slot], size)]
            if not wrong.any():
                return out
            ends = np.cumsum(size)
            return np.add.reduceat(wrong, ends - size, dtype=np.int64) > 0
        same = np.flatnonzero(~out)
        begin = (np.cumsum(size) - size)[same]
        wrong = points[ranges(begin, size[same])] != self.points[ranges(self.at[slot[same]], size[same])]
        begin = np.cumsum(size[same]) - size[same]
        if len(same):
            out[same] = np.add.reduceat(wrong, begin, dtype=np.int64) > 0
        return out


@lru_cache(4)
def library_encoder(path: str) -> BatchEncoder:
    """The tokenizers library behind the batch cutter: it encodes each distinct word once."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    added = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}

    size = np.zeros(tok.get_vocab_size(), np.int64)
    signs = byte_signs()
    for piece, i in tok.get_vocab().items():
        size[i] = len(piece) if all(c in signs for c in piece) else 0

    def flat(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tok.encode_batch_fast(parts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum())), count

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that open with a blank stay apart when joined, so the library gets many in one text."""
        own, joint = [], []
        for i, w in enumerate(words):
            (joint if w[0] == " " and not w[1:2].isspace() and len(w) > 1 else own).append(i)
        count = np.zeros(len(words), np.int64)
        spelled = [words[i] for i in joint]
        got, _ = flat(["".join(spelled[i : i + JOINED]) for i in range(0, len(spelled), JOINED)])
        length = np.fromiter(map(len, map(str.encode, spelled)), np.int64, len(spelled))
        ends = np.searchsorted(np.cumsum(size[got]), np.cumsum(length)) + 1 if len(got) else np.zeros(0, np.int64)
        count[joint] = np.diff(ends, prepend=0)
        rest, count[own] = flat([words[i] for i in own])
        start = np.zeros(len(words), np.int64)
        start[joint] = np.cumsum(count[joint]) - count[joint]
        start[own] = len(got) + np.cumsum(count[own]) - count[own]
        return np.concatenate([got, rest])[ranges(start, count)], count

    return BatchEncoder(encode, added)
