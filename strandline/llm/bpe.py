"""Byte-level BPE by a lexicon automaton, with exact merging of what it lacks.

A text falls into units: a run of bytes other than white space with the one space
before it, or a piece of white space as the tokenizer's pattern cuts it.  No
token crosses a unit, so a unit's ids are a function of its bytes.

The frequent units of the corpus, counted over all texts, are compiled into a
minimal acyclic automaton: equal suffixes are one state, and each arc carries the
number of words that sort before it, so a walk adds up to the word's place in a
table of id outputs.  The arrays lie in one file that the executors memory-map.
A unit that the automaton does not accept is cut by the pattern and merged pair
by pair, which is exact for any text; units met before are kept in a bounded memo.
Units are told apart by their bytes, here and in the memo, and a text is decoded
from its ids alone.

Defined cases: a null or empty text has no tokens; the special token's string in
a text is its id; texts with white space beyond ASCII or bytes that are not UTF-8
take the pattern over the whole text instead of units.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import mmap
import os
import shutil
import tempfile
import uuid
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, tokens

#: Units in the lexicon; the automaton's size is bounded by it.
LEXICON_UNITS = 1 << 18
#: Longest unit in bytes that the lexicon takes.
LEXICON_UNIT_BYTES = 48
#: Units, and pieces, that a Python worker remembers.
MEMO_UNITS = 50_000

_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pattern that the byte-level pre-tokenizer fixes.
PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
#: UTF-8 of white space beyond ASCII.
_WIDE_SPACE = regex.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return names


_NONE = 1 << 30


class Merger:
    """The vocabulary of one tokenizer file: merges bytes to ids, and ids back to bytes."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        byte = {c: b for b, c in _byte_names().items()}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        vocab = model["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in vocab.items():
            self.bytes_of[i] = bytes(byte[c] for c in text) if text not in self.special else text.encode()
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.of_byte = np.array([vocab.get(c, -1) for _, c in sorted(_byte_names().items())], np.int64)
        self.ranks = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.memo: dict[str, bytes] = {}
        self._table()

    def _table(self) -> None:
        """The merges as an open hash table, to look many pairs up at once."""
        self._bits = max(4, (4 * len(self.ranks)).bit_length())
        size = 1 << self._bits
        self._key, self._rank, self._new = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64), np.zeros(size, np.int64)
        pairs = np.array(list(self.ranks) or np.zeros((0, 2)), np.int64).reshape(-1, 2)
        keys = pairs[:, 0] << 24 | pairs[:, 1]
        self._probes = 1
        for key, slot, (rank, new) in zip(keys.tolist(), self._slot(keys).tolist(), self.ranks.values(), strict=True):
            probe = 1
            while self._key[slot] >= 0:
                slot, probe = (slot + 1) & (size - 1), probe + 1
            self._probes = max(self._probes, probe)
            self._key[slot], self._rank[slot], self._new[slot] = key, rank, new

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE without one) and table slot of each pair; negative ids are padding."""
        key = left << 24 | right
        slot = self._slot(key)
        seen = self._key[slot]
        rank = np.where(seen == key, self._rank[slot], _NONE)
        open_ = (seen != key) & (seen >= 0) & (right >= 0)
        for _ in range(self._probes - 1):
            at = np.nonzero(open_)
            if not len(at[0]):
                break
            slot[at] = (slot[at] + 1) & (len(self._key) - 1)
            seen = self._key[slot[at]]
            hit = seen == key[at]
            rank[at] = np.where(hit, self._rank[slot[at]], _NONE)
            open_[at] = ~hit & (seen >= 0)
        rank[right < 0] = _NONE
        return rank, slot

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers: all pieces of like length go through their merges together."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            n = len(p)
            groups.setdefault(4 if n <= 4 else 8 if n <= 8 else 12 if n <= 12 else 16 if n <= 16 else 32 if n <= 32 else 0, []).append(i)
        for width, members in groups.items():
            if not width:
                for i in members:
                    out[i] = np.array(self._merge_long([int(self.of_byte[b]) for b in pieces[i]]), "<u4").tobytes()
                continue
            raw = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in members]), np.uint8).reshape(-1, width)
            sizes = np.array([len(pieces[i]) for i in members])
            ids = np.where(np.arange(width) < sizes[:, None], self.of_byte[raw], -1)
            done = np.empty_like(ids)
            live = np.arange(len(ids))
            while len(live):
                rank, slot = self._find(ids[:, :-1], ids[:, 1:])
                best = rank.argmin(axis=1)
                row = np.arange(len(ids))
                go = rank[row, best] < _NONE
                done[live[~go]] = ids[~go]
                ids, live, best = ids[go], live[go], best[go]
                if not len(live):
                    break
                # The leftmost pair of the lowest rank becomes one id; what stands behind it moves up.
                ids[np.arange(len(ids)), best] = self._new[slot[go][np.arange(len(ids)), best]]
                step = np.arange(width - 1)
                ids[:, :-1] = np.take_along_axis(ids, step + (step > best[:, None]), axis=1)
                ids[np.arange(len(ids)), -1] = -1
            lengths = (done >= 0).sum(axis=1).tolist()
            flat = done.astype("<u4")
            for j, i in enumerate(members):
                out[i] = flat[j, : lengths[j]].tobytes()
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap and a linked list, for a run of any length."""
        n = len(ids)
        right, left = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*self.ranks[p][:1], i, p) for i, p in enumerate(pairwise(ids)) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.ranks[pair][1], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (ids[a], ids[b]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[ids[a], ids[b]][0], a, (ids[a], ids[b])))
        return [x for x in ids if x >= 0]

    def _know(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of all these pieces, from the memo or merged now."""
        if len(self.memo) > MEMO_UNITS:
            self.memo.clear()
        missing = [p for p in dict.fromkeys(pieces) if p not in self.memo]
        new = dict(zip(missing, self.merge_all([p.encode() for p in missing]), strict=True))
        self.memo |= {p: ids for p, ids in new.items() if len(ids) <= 4 * LEXICON_UNIT_BYTES}
        return new

    def pieces(self, text: str) -> bytes:
        found = PATTERN.findall(text)
        new = self._know(found)
        return b"".join([new[p] if p in new else self.memo[p] for p in found])

    def units(self, units: list[bytes]) -> list[bytes]:
        """Ids of each unit, all cut by one pass of the pattern: a line feed between two units is a piece of its own."""
        found = PATTERN.findall(b"\n".join(units).decode())
        new = self._know(found)
        memo, out, own = self.memo, [], []
        for p in found:
            if p == "\n":
                out.append(b"".join(own))
                own = []
            else:
                own.append(new[p] if p in new else memo[p])
        return [*out, b"".join(own)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, special tokens' strings included."""
        if not self.split_special:
            return self.pieces(text)
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out.append(self.pieces(part))
        return b"".join(out)

def _trie(units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parent, byte and depth of each node but the root (number 0, parent -1), by prefix; and the nodes where units end."""
    n = len(units)
    sizes = np.diff(np.frombuffer(units.buffers()[1], np.int32, n + 1, 4 * units.offset))
    begin = np.frombuffer(units.buffers()[1], np.int32, n + 1, 4 * units.offset)[:-1]
    data = np.frombuffer(units.buffers()[2] or b"", np.uint8)
    width = int(sizes.max(initial=0))
    fits = np.arange(width) < sizes[:, None]
    letters = np.zeros((n, width), np.uint8)
    letters[fits] = data[(begin[:, None] + np.arange(width))[fits]]
    # Letters that a unit shares with the one before it.
    same = np.zeros((n, width), bool)
    same[1:] = (letters[1:] == letters[:-1]) & fits[1:] & fits[:-1]
    shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    fresh = fits & (np.arange(width) >= shared[:, None])
    node = np.cumsum(fresh.ravel()).reshape(n, width)  # numbers in the order of the sorted units, from 1 on
    parent, byte, depth = [np.array([-1])], [np.array([0])], [np.array([0])]
    above = np.zeros(n, np.int64)
    where = [np.array([0])]
    for d in range(width):
        own = np.where(fresh[:, d], node[:, d], 0)
        here = np.maximum.accumulate(own)  # the node of a prefix is that of the last unit that began it
        new = fresh[:, d]
        where.append(own[new])
        parent.append(above[new])
        byte.append(letters[new, d].astype(np.int64))
        depth.append(np.full(int(new.sum()), d + 1))
        above = here
    order = np.argsort(np.concatenate(where))
    return np.concatenate(parent)[order], np.concatenate(byte)[order], np.concatenate(depth)[order], node[np.arange(n), sizes - 1] if width else np.zeros(0, np.int64)


def compile_lexicon(units: list[bytes], outputs: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of sorted, distinct, non-empty units, as flat arrays.

    The trie of the units is minimised from its leaves up: nodes of one height are
    one state if they end units alike and have the same bytes to the same states.
    """
    parent, byte, depth, ends = _trie(pa.array(units, pa.binary()))
    n = len(parent)
    final = np.zeros(n, np.int64)
    final[ends] = 1
    height = np.zeros(n, np.int64)
    for d in range(int(depth.max()), 0, -1):
        at = np.flatnonzero(depth == d)
        np.maximum.at(height, parent[at], height[at] + 1)
    child = np.argsort(parent, kind="stable")[1:]  # by parent, then byte: numbers follow the order of the units
    fan = np.bincount(parent[1:], minlength=n)
    first = np.concatenate(([0], np.cumsum(fan)[:-1]))
    state, used, heads = np.zeros(n, np.int64), 0, []
    for h in range(int(height.max()) + 1):
        nodes = np.flatnonzero(height == h)
        sign = final[nodes].copy()
        fresh = 2
        for k in range(int(fan[nodes].max())):
            on = np.flatnonzero(fan[nodes] > k)
            arc = child[first[nodes[on]] + k]
            _, own = np.unique(sign[on] * (256 * max(used, 1)) + byte[arc] * max(used, 1) + state[arc], return_inverse=True)
            sign[on] = own + fresh
            fresh += int(own.max()) + 1
        _, head, own = np.unique(sign, return_index=True, return_inverse=True)
        state[nodes] = own + used
        heads.append(nodes[head])
        used += len(head)
    heads = np.concatenate(heads)
    heads, state = heads[::-1], used - 1 - state  # the root is state 0
    arcs = np.repeat(first[heads], fan[heads]) + np.arange(fan[heads].sum()) - np.repeat(np.cumsum(fan[heads]) - fan[heads], fan[heads])
    arcs, source = child[arcs], np.repeat(np.arange(used), fan[heads])
    targets = state[arcs]
    # Number of units accepted from a state on, and so what each arc adds to the place of a unit.
    count, cut = final[heads].copy(), np.concatenate(([0], np.cumsum(fan[heads])))
    level = height[heads]
    for h in range(1, int(level.max()) + 1):
        own = np.flatnonzero(level == h)
        among = np.flatnonzero(level[source] == h)
        count[own] += np.bincount(source[among], weights=count[targets[among]], minlength=used)[own].astype(np.int64)
    total = np.concatenate(([0], np.cumsum(count[targets])))
    adds = total[:-1] - total[cut[source]] + final[heads][source]
    # Arcs lie in an open hash table by (state, byte), which a walk over many units probes at once.
    keys = source << 8 | byte[arcs]
    size = 1 << max(4, (3 * len(keys)).bit_length())
    table = {"keys": np.full(size, -1, np.int64), "targets": np.zeros(size, np.int32), "adds": np.zeros(size, np.int32)}
    spot = _arc_slots(keys, size)
    left = np.arange(len(keys))
    while len(left):  # arcs that meet in a slot: one takes it, the others go on
        free = table["keys"][spot[left]] < 0
        _, one = np.unique(spot[left], return_index=True)
        take = np.zeros(len(left), bool)
        take[one] = True
        put = left[take & free]
        for name, values in (("keys", keys), ("targets", targets), ("adds", adds)):
            table[name][spot[put]] = values[put]
        left = left[~(take & free)]
        spot[left] = (spot[left] + 1) & (size - 1)
    ids = np.frombuffer(b"".join(outputs), np.uint8)
    return table | {"final": final[heads].astype(np.uint8), "at": np.cumsum([0, *map(len, outputs)], dtype=np.int64) // 4, "ids": ids}


def _arc_slots(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays as one file."""
    at, head, body = 0, {}, []
    for name, a in arrays.items():
        data = a.tobytes()
        head[name] = [a.dtype.str, len(a), at]
        pad = -len(data) % 8
        body.append(data + bytes(pad))
        at += len(data) + pad
    start = json.dumps(head).encode()
    start += b" " * (-len(start) % 8)
    return len(start).to_bytes(8, "little") + start + b"".join(body)


class Lexicon:
    """A compiled lexicon, memory-mapped from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(self._map[:8], "little")
        for name, (kind, n, at) in json.loads(self._map[8 : 8 + size]).items():
            setattr(self, name, np.frombuffer(self._map, kind, n, 8 + size + at))

    def places(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each unit raw[start:end] among the lexicon's units, -1 where it has none."""
        out = np.full(len(starts), -1, np.int64)
        live = np.flatnonzero(ends - starts <= LEXICON_UNIT_BYTES)
        state, place, at = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), starts[live]
        while len(live):
            done = at == ends[live]
            if done.any():
                ok = done & (self.final[state] == 1)
                out[live[ok]] = place[ok]
                live, state, place, at = live[~done], state[~done], place[~done], at[~done]
                if not len(live):
                    break
            key = state << 8 | raw[at]
            arc = _arc_slots(key, len(self.keys))
            seen = self.keys[arc]
            while len(on := np.flatnonzero((seen != key) & (seen >= 0))):
                arc[on] = (arc[on] + 1) & (len(self.keys) - 1)
                seen[on] = self.keys[arc[on]]
            go = seen == key
            live, arc = live[go], arc[go]
            state, place, at = self.targets[arc].astype(np.int64), place[go] + self.adds[arc], at[go] + 1
        return out


def unit_spans(raw: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the units of joined texts, whose last byte each is a separator."""
    kind = tokens._SPACE[raw].astype(np.uint8)
    kind[text_ends - 1] = 2
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    a, b = np.concatenate(([0], edge)), np.concatenate((edge, [len(raw)]))
    k = kind[a]
    after = np.append(k[1:], 2)
    white, spaced = k == 1, (raw[b - 1] == 32)
    give = white & (after == 0)  # white space before a word gives up its last byte
    lead = np.concatenate(([False], (give & spaced)[:-1])) & (k == 0)
    starts, ends = [a[k == 0] - lead[k == 0]], [b[k == 0]]
    whole = white & ~give
    head = give & (b - a > 1)
    tail = give & ~spaced
    for s, e in ((a[whole], b[whole]), (a[head], b[head] - 1), (b[tail] - 1, b[tail])):
        starts.append(s)
        ends.append(e)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def _count_units(batches):
    common.plain_memory()
    for batch in batches:
        for _, raw, ends in tokens.joined(batch.column(0)):
            starts, stops = unit_spans(raw, ends)
            first, which = tokens.distinct(raw, starts, stops, fold=False)
            counts = np.bincount(which, minlength=len(first))
            data = raw.tobytes()
            short = stops[first] - starts[first] <= LEXICON_UNIT_BYTES
            units = [data[a:b] for a, b in zip(starts[first[short]].tolist(), stops[first[short]].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.binary()), pa.array(counts[short], pa.int64())], names=["unit", "n"])


def frequent_units(docs: DataFrame, scratch: common.Scratch, most: int = LEXICON_UNITS) -> DataFrame:
    """The units of all texts that occur most often: at most `most`, whatever the corpus.

    A histogram of counts with at most some 500 bars tells from which count on
    the units are few enough, so no task sends the driver more than its share.
    """
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_units, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counted = scratch.written(counted.withColumn("bar", F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")), "units")
    total, least = 0, None
    for bar, n in sorted(counted.groupBy("bar").count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = bar
    return counted.where(F.col("bar") >= F.lit(least).cast("int")).select("unit")


def lexicon_file(merger: Merger, words: list[bytes]) -> bytes:
    """Units compiled with their ids as a file; units that whole texts decide on are left out."""
    words = sorted(w for w in words if _is_utf8(w) and not _WIDE_SPACE.search(w) and not any(s.encode() in w for s in merger.special))
    outputs = [merger.pieces(w.decode()) if tokens._SPACE[w[-1]] else b"" for w in words]
    rest = [i for i, w in enumerate(words) if not outputs[i]]
    for at in range(0, len(rest), 1 << 15):
        own = rest[at : at + (1 << 15)]
        for i, ids in zip(own, merger.units([words[i] for i in own]), strict=True):
            outputs[i] = ids
    return packed(compile_lexicon(words, outputs))


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start : start + size] one after the other, and the end of each."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """Encodes columns of texts; one is kept by each Python worker."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, spec: str, lexicon: str):
        self.merger, self.lexicon = Merger(spec), Lexicon(lexicon)
        self.lexicon_ids = self.lexicon.ids.view("<u4")
        self.memo: dict[bytes, bytes] = {}
        self.specials = [x.encode() for x in self.merger.special]
        self.letters = np.frombuffer(b"".join(self.merger.bytes_of), np.uint8)
        self.letter_count = np.array([len(x) for x in self.merger.bytes_of], np.int64)
        self.letter_start = np.cumsum(self.letter_count) - self.letter_count

    @classmethod
    def of(cls, name: str, spec: str) -> Encoder:
        if name not in cls._kept:
            cls._kept.clear()
            cls._kept[name] = cls(spec, SparkFiles.get(name))
        return cls._kept[name]

    def _learn(self, units: list[bytes]) -> None:
        """Puts units that the automaton lacks into the memo."""
        white = [u[-1:].isspace() for u in units]
        rest = [u for u, w in zip(units, white, strict=True) if not w]
        self.memo |= zip(rest, self.merger.units(rest) if rest else [], strict=True)
        self.memo |= {u: self.merger.pieces(u.decode()) for u, w in zip(units, white, strict=True) if w}

    def _decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all these ids, and the end of each id's."""
        return _gather(self.letters, self.letter_start[ids], self.letter_count[ids])

    def _is_odd(self, data: bytes) -> bool:
        """Whether units don't decide on a text: special tokens, wide white space, or bytes that are not UTF-8."""
        return bool(_WIDE_SPACE.search(data)) or any(x in data for x in self.specials) or not _is_utf8(data)

    def encode(self, texts: pa.Array):
        """(ids as 32-bit integers, decoded bytes) of each text, in order."""
        for _, raw, ends in tokens.joined(texts):
            data = raw.tobytes()
            starts, stops = unit_spans(raw, ends)
            first, which = tokens.distinct(raw, starts, stops, fold=False)
            odd = self._is_odd(data)
            a, b = starts[first], stops[first]
            places = self.lexicon.places(raw, a, b)
            lacking = np.flatnonzero(places < 0)
            units = [data[x:y] for x, y in zip(a[lacking].tolist(), b[lacking].tolist(), strict=True)]
            if len(self.memo) > MEMO_UNITS:
                self.memo.clear()
            missing = [u for u in units if u not in self.memo]
            if odd:  # such units are met in texts that take the other path alone
                missing = [u for u in missing if _is_utf8(u) and not _WIDE_SPACE.search(u)]
            if missing:
                self._learn(missing)
            merged = [self.memo.get(u, b"") for u in units]
            # Ids of each different unit: a stretch of the lexicon's ids, or of those merged here.
            at = self.lexicon.at
            known = np.maximum(places, 0)
            begin, size = (at[known], at[known + 1] - at[known]) if len(at) > 1 else (np.zeros(len(first), np.int64), np.zeros(len(first), np.int64))
            size[lacking] = [len(x) // 4 for x in merged]
            begin[lacking] = len(self.lexicon_ids) + np.cumsum(size[lacking]) - size[lacking]
            ids, token_ends = _gather(_Joined(self.lexicon_ids, np.frombuffer(b"".join(merged), "<u4")), begin[which], size[which])
            letters, letter_ends = self._decoded(ids)
            cut = np.concatenate(([0], token_ends))[np.concatenate(([0], np.searchsorted(starts, ends)))].tolist()
            letter_cut = np.concatenate(([0], letter_ends))[cut].tolist()
            done = 0
            for i, end in enumerate(ends.tolist()):
                text = data[done : end - 1] if odd else b""
                done = end
                if odd and self._is_odd(text):
                    out = np.frombuffer(self.merger.encode(text.decode("utf-8", "replace")), "<u4")
                    yield out, self._decoded(out)[0].tobytes()
                else:
                    yield ids[cut[i] : cut[i + 1]], letters[letter_cut[i] : letter_cut[i + 1]].tobytes()

    def forget(self) -> None:
        """Lets go of the memos: an idle worker keeps the lexicon alone."""
        self.memo, self.merger.memo = {}, {}
        common.trim()


class _Joined:
    """Two arrays addressed as one, without copying the first."""

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.one, self.two = one, two

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), self.one.dtype)
        here = at < len(self.one)
        out[here] = self.one[at[here]]
        out[~here] = self.two[at[~here] - len(self.one)]
        return out


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _kept_folder() -> str:
    """A folder of the driver from which Spark's file server hands the lexicon to executors; it goes with the driver."""
    path = tempfile.mkdtemp(prefix="strandline-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def prepare(docs: DataFrame, tokenizer_path: str, units: int = LEXICON_UNITS):
    """Compiles the lexicon of docs and hands it to the executors; (its name there, the tokenizer file's text).

    One task compiles it: its input is bounded by `units`, not by the corpus.
    """
    spark = docs.sparkSession
    common.settings(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def compile_all(batches):
        words = [u for batch in batches for u in batch.column(0).to_pylist()]
        file = lexicon_file(Merger(spec.value), words)
        size, file = len(file), pa.compress(file, "zstd", asbytes=True)
        del words
        common.trim()
        yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([file], pa.binary())], names=["size", "file"])

    with common.Scratch(spark) as scratch:
        made = frequent_units(docs, scratch, units).repartition(1).mapInArrow(compile_all, "size long, file binary").first()
    file = pa.decompress(bytes(made.file), made.size, "zstd", asbytes=True) if made else packed(compile_lexicon([], []))
    name = f"lexicon-{uuid.uuid4().hex[:12]}"
    path = os.path.join(_kept_folder(), name)
    with open(path, "wb") as f:
        f.write(file)
    spark.sparkContext.addFile(path)
    common.tidy(spark)
    return name, spec


def encode(docs: DataFrame, tokenizer_path: str, units: int = LEXICON_UNITS) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every row."""
    name, spec = prepare(docs, tokenizer_path, units)

    def run(batches):
        common.plain_memory()
        encoder = Encoder.of(name, spec.value)
        for batch in batches:
            got = list(encoder.encode(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists([x for x, _ in got]), pa.array([y.decode("utf-8", "replace") for _, y in got], pa.string())], names=["doc_id", "ids", "decoded"]
            )
        encoder.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def _lists(ids: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype("<u4").view(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))


def _digests(docs: DataFrame, tokenizer_path: str, units: int, with_ids: bool) -> DataFrame:
    name, spec = prepare(docs, tokenizer_path, units)

    def run(batches):
        common.plain_memory()
        encoder = Encoder.of(name, spec.value)
        for batch in batches:
            n, a, b, kept = [], [], [], []
            for ids, back in encoder.encode(batch.column(1)):
                n.append(len(ids))
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(back if _is_utf8(back) else back.decode("utf-8", "replace").encode()).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                columns.append(_lists(kept))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
        encoder.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def digests(docs: DataFrame, tokenizer_path: str, units: int = LEXICON_UNITS) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the decoded text: `encode` without its bulk."""
    return _digests(docs, tokenizer_path, units, False)


def encode_with_digests(docs: DataFrame, tokenizer_path: str, units: int = LEXICON_UNITS) -> DataFrame:
    """As `digests`, with the ids themselves (array<int>)."""
    return _digests(docs, tokenizer_path, units, True)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op5(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), default_tokenizer())
