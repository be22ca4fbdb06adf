"""N-gram scoring of whole texts by a weighted backoff automaton of order three.

The model interpolates n-grams with Dirichlet smoothing:

    p1(w)       = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p2(w | v)   = (c(v w) + MU[0] p1(w)) / (c(v) + MU[0])
    p3(w | u v) = (c(u v w) + MU[1] p2(w | v)) / (c(u v) + MU[1])

which sums to one over the V known words and one unknown word.  As an automaton,
every history seen in training (a word, the start of a text, or a pair of these) is a
state.  It has an arc for each word that followed it, weighted with that word's
probability, to the longest history that the arc leads to; and a failure arc,
weighted with MU / (c + MU), to the history without its first word, and from single
words to the root, whose arcs carry p1.  A text is read once from left to right: the
state takes the arc of the next word or falls back until there is one, and log
weights add up.  Long texts are read as segments side by side; a segment's first
state is found by reading the two words before it, which is all a state remembers.

Nothing that grows with the corpus is broadcast or collected.  Each task cuts its
texts into shards by size, in their order, whatever their ids and contents, and
encodes them: distinct words and, for each token, the place of its word.  Only that is
shuffled, once, and read three times.  Each shard sends its distinct words, cut into ranges of hashes (one blob for each shard and
range, so a word in every text weighs no more than one entry a shard), to the ranges'
owners, who tell words apart by their bytes, number them, and answer with numbers
and training counts.  Then the shards ask for counts of pairs and triples of numbers
in the same way.  So every shard holds exactly the part of the automaton that its
texts can reach, compiles it and runs its texts through it.

Defined cases: null or empty texts consist of the end token alone; repeated rows
count each time they occur; an empty table gives no rows; a null doc_id hashes as
the empty text; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, tokens

#: Strength of the back-off distribution against the counts of a word's and a pair's state.
MU = (400.0, 2.0)
#: Text bytes of a shard.  A shard's texts and its part of the automaton are in one task's memory.
SHARD_BYTES = 8 << 20
#: Tokens that a segment reads.
SEGMENT = 64
#: Shards whose words one owner numbers for each shard of n-grams.
WORDS_SHARE = 8

_U = np.uint64
_ASK = "shard long, part int, size long, blob binary, counts binary"
#: A range's answer about words: how many, their numbers and counts, and the totals of all its words.
_KNOWN = "w_size long, w_ids binary, w_counts binary, n_range long, v_range long"


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys, and the place of each key among them."""
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    fresh = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    where = np.empty(len(key), np.int32)
    where[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return key[fresh], where


_SHARD = "shard long, sizes binary, letters binary, tokens binary, counts binary, n_words long, n_letters long, n_tokens long, n_texts long, keys binary"


def _encoded(batches: list[pa.RecordBatch], shard: int) -> pa.RecordBatch:
    """A shard's texts (doc_id, held_out, text) as one row: words, and one end (a word without bytes) after each text."""
    table = pa.Table.from_batches(batches)
    (_, raw, ends), = tokens.joined(table["text"], 1 << 62)
    starts, stops = tokens.word_spans(raw)
    n = len(ends)
    at = np.searchsorted(starts, ends) + np.arange(n)
    word = np.ones(len(starts) + n, bool)
    word[at] = False
    begin, end = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
    begin[word], end[word] = starts, stops
    begin[at] = end[at] = ends - 1
    first, which = tokens.distinct(raw, begin, end)
    # Words in the order of their hashes, and of their bytes should hashes be equal.
    folded, begin, end = tokens._LOWER[raw], begin[first], end[first]
    hashes = tokens.span_hashes(raw, begin, end)
    order = np.argsort(hashes)
    if (hashes[order][1:] == hashes[order][:-1]).any():
        order = np.array(sorted(range(len(first)), key=lambda i: (int(hashes[i]), folded[begin[i] : end[i]].tobytes())))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    begin, sizes = begin[order], (end - begin)[order]
    total = int(sizes.sum())
    letters = folded[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(total)].tobytes()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.drop_columns(["text"]).schema) as out:
        out.write_table(table.drop_columns(["text"]))
    per_text = np.diff(np.concatenate(([0], at + 1)))
    row = [shard, _planes(sizes), pa.compress(letters, "zstd", asbytes=True), _planes(place[which]), _planes(per_text), len(sizes), total, len(which), n, sink.getvalue().to_pybytes()]
    kinds = [pa.int64() if isinstance(x, int) else pa.binary() for x in row]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _SHARD.split(", ")])


def _encode(shard_bytes: int):
    """Cuts a task's texts into shards of some shard_bytes and encodes each."""

    def run(batches):
        common.plain_memory()
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(2).nbytes
            if size >= shard_bytes:
                yield _encoded(held, task << 32 | made)
                made, held, size = made + 1, [], 0
        if held:
            yield _encoded(held, task << 32 | made)

    return run


class Shard:
    """An encoded shard: its words in the order of their hashes, and the place of each token's word there."""

    def __init__(self, row: dict):
        self.name = row["shard"]
        self.sizes = _from_planes(row["sizes"], row["n_words"])[0]
        self.letters = pa.decompress(row["letters"], row["n_letters"], "zstd", asbytes=True) if row["n_letters"] else b""
        self.words = _from_planes(row["tokens"], row["n_tokens"])[0].astype(np.int32)
        per_text = _from_planes(row["counts"], row["n_texts"])[0]
        self.keys = pa.ipc.open_stream(row["keys"]).read_all()
        #: The first token of each text, and the number of tokens.
        self.offsets = np.concatenate(([0], np.cumsum(per_text)))
        held = np.asarray(self.keys["held_out"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        self.trained = np.repeat(~held, per_text)
        self.own_counts = np.bincount(self.words[self.trained], minlength=len(self.sizes))

    def number(self, ids: np.ndarray, counts: np.ndarray, alone: np.ndarray) -> None:
        """Takes the owners' numbers and counts, and which words no other shard has: words are now in the order of their numbers, from 1 on; 0 is the start of a text."""
        order = np.argsort(ids)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(1, len(order) + 1, dtype=np.int32)
        self.ids, self.counts = np.concatenate(([0], ids[order])), np.concatenate(([0], counts[order]))
        end = int(np.flatnonzero(self.sizes == 0)[0])
        # What holds a word of this shard alone has its whole count here.
        self.alone = np.concatenate(([False], alone[order]))
        del self.letters, self.sizes
        self.end_word = int(place[end])
        self.counts[0] = self.counts[self.end_word]  # as many starts as ends
        self.words = place[self.words]
        self.size = len(self.ids)
        key = np.empty(len(self.words), np.int64)
        key[1:] = self.words[:-1]
        key[self.offsets[:-1]] = 0
        key *= self.size
        key += self.words
        self.pairs, self.pair_of = _distinct(key)
        inner = np.ones(len(self.words), bool)
        inner[self.offsets[:-1]] = False
        #: Places that have two tokens or a start and a token before them.
        self.inner = np.flatnonzero(inner).astype(np.int32)
        key = self.pair_of[self.inner - 1].astype(np.int64)
        key *= self.size
        key += self.words[self.inner]
        self.triples, self.triple_of = _distinct(key)
        #: The pair that ends each triple.
        self.triple_tail = np.empty(len(self.triples), np.int32)
        self.triple_tail[self.triple_of] = self.pair_of[self.inner]

        self.pair_counts = np.bincount(self.pair_of[self.trained], minlength=len(self.pairs))
        self.triple_counts = np.bincount(self.triple_of[self.trained[self.inner]], minlength=len(self.triples))

    def asked(self):
        """For pairs, then triples: which ones others may have too, these as columns of the owners' numbers, sorted, and their counts here."""
        head, tail = self.pairs // self.size, self.pairs % self.size
        alone = self.alone[head] | self.alone[tail]
        which = np.flatnonzero(~alone)
        pairs = [self.ids[head], self.ids[tail]]
        yield which, [c[which] for c in pairs], self.pair_counts
        pair = self.triples // self.size
        which = np.flatnonzero(~(alone[pair] | self.alone[self.triples % self.size]))
        pair = pair[which]
        yield which, [pairs[0][pair], pairs[1][pair], self.ids[self.triples[which] % self.size]], self.triple_counts


def _planes(values: np.ndarray) -> bytes:
    """Values from 0 on as compressed byte planes."""
    width = next(w for w in range(1, 9) if w == 8 or not len(values) or int(values.max()) < 1 << (8 * w))
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    blob = pa.compress(planes.tobytes(), "zstd", asbytes=True)
    return bytes([width]) + len(blob).to_bytes(4, "little") + blob


def _from_planes(blob: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    width, size = blob[at], int.from_bytes(blob[at + 1 : at + 5], "little")
    planes = np.frombuffer(pa.decompress(blob[at + 5 : at + 5 + size], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8")[:, 0], at + 5 + size


def pack(columns: list[np.ndarray]) -> bytes:
    """Sorted, distinct rows: each column as differences, from 0 again where a column before it changes."""
    n = len(columns[0])
    fresh, out = np.zeros(n, bool), []
    fresh[:1] = True
    for c in columns:
        step = np.diff(c, prepend=0)
        out.append(_planes(np.where(fresh, c, step)))
        fresh = fresh | (step != 0)
    return b"".join(out)


def unpack(blob: bytes, n: int, columns: int) -> list[np.ndarray]:
    out, at, fresh = [], 0, np.zeros(n, bool)
    fresh[:1] = True
    for _ in range(columns):
        d, at = _from_planes(blob, n, at)
        total = np.cumsum(d)
        head = np.flatnonzero(fresh)
        c = total - np.repeat((total - d)[head], np.diff(np.append(head, n)))
        out.append(c)
        fresh = fresh | (np.diff(c, prepend=-1) != 0)
    return out


def _cuts(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)


_TYPES = {"shard": pa.int64(), "part": pa.int32(), "blob": pa.binary(), "counts": pa.binary(), "w_ids": pa.binary(), "w_counts": pa.binary()}


def _rows(rows: list[dict], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.table({n: pa.array([r.get(n) for r in rows], _TYPES.get(n, pa.int64())) for n in names})


def _ask_words(parts: int):
    """A shard's distinct words with their training counts, a blob for each range of hashes."""

    def run(table: pa.Table) -> pa.Table:
        common.plain_memory()
        common.trim()
        (row,) = table.to_pylist()
        shard = Shard(row)
        ends = np.cumsum(shard.sizes)
        hashes = tokens.span_hashes(np.frombuffer(shard.letters, np.uint8), ends - shard.sizes, ends, fold=False)
        edges = [0, *np.searchsorted(hashes, _cuts(parts)).tolist(), len(ends)]
        at = np.concatenate(([0], ends))[edges].tolist()
        rows = []
        for part in range(parts):
            a, b = edges[part], edges[part + 1]
            letters = pa.compress(shard.letters[at[part] : at[part + 1]], "zstd", asbytes=True)
            rows.append({"shard": shard.name, "part": part, "size": b - a, "blob": _planes(shard.sizes[a:b]) + letters, "counts": _planes(shard.own_counts[a:b])})
        return _rows(rows, _ASK)

    return run


def _number_words(parts: int):
    """An owner's answer to each shard: the numbers and training counts of its words, and the range's totals.

    Frequent words get small numbers; 0 is no word's.
    """

    def run(table: pa.Table) -> pa.Table:
        common.plain_memory()
        table = table.sort_by("shard")  # numbers don't depend on the order in which blobs arrive
        asked = table["size"].to_pylist()
        sizes, letters, counts = [], [], []
        for n, blob, c in zip(asked, table["blob"].to_pylist(), table["counts"].to_pylist(), strict=True):
            size, at = _from_planes(blob, n)
            sizes.append(size)
            letters.append(pa.decompress(blob[at:], int(size.sum()), "zstd", asbytes=True) if n and size.sum() else b"")
            counts.append(_from_planes(c, n)[0])
        raw, ends = np.frombuffer(b"".join(letters), np.uint8), np.cumsum(np.concatenate(sizes))
        first, which = tokens.distinct(raw, ends - np.concatenate(sizes), ends, fold=False)
        total = np.bincount(which, weights=np.concatenate(counts), minlength=len(first)).astype(np.int64)
        alone = np.bincount(which, minlength=len(first)) == 1
        rank = np.empty(len(first), np.int64)
        rank[np.lexsort((first, -total))] = np.arange(len(first))
        ids = 1 + rank * parts + (table["part"][0].as_py() if len(asked) else 0)
        totals = {"n_range": int(total.sum()), "v_range": int((total > 0).sum())}
        rows, at = [], 0
        for shard, part, n in zip(table["shard"].to_pylist(), table["part"].to_pylist(), asked, strict=True):
            own = which[at : at + n]
            rows.append({"shard": shard, "part": part, "w_size": n, "w_ids": _planes(ids[own]), "w_counts": _planes(total[own] << 1 | alone[own])} | totals)
            at += n
        return _rows(rows, f"shard long, part int, {_KNOWN}")

    return run


def _answered(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r["part"])


def _numbered(texts: pa.Table, answers: list[dict]) -> Shard:
    (row,) = texts.to_pylist()
    shard = Shard(row)
    ids, counts = (np.concatenate([_from_planes(r[c], r["w_size"])[0] for r in answers if r["w_size"] is not None]) for c in ("w_ids", "w_counts"))
    shard.number(ids, counts >> 1, (counts & 1).astype(bool))
    return shard


def _owner(columns: list[np.ndarray], parts: int) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = tokens.mix(key + c.astype(np.uint64))
    return (key % _U(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)  # short numbers are sorted by their digits


def _ask_grams(parts: int):
    """A shard's distinct pairs and triples with their training counts, a blob for each owner."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        common.plain_memory()
        common.trim()
        known = _answered(words)
        shard = _numbered(texts, known)
        blobs, counts, sizes = [[] for _ in range(parts)], [[] for _ in range(parts)], [[] for _ in range(parts)]
        for which, columns, count in shard.asked():
            count = count[which]
            owner = _owner(columns, parts)
            order = np.argsort(owner, kind="stable")
            edges = np.searchsorted(owner[order], np.arange(parts + 1))
            for part in range(parts):
                own = order[edges[part] : edges[part + 1]]
                sizes[part].append(len(own))
                blobs[part].append(pack([c[own] for c in columns]))
                counts[part].append(_planes(count[own]))
        rows = []
        for part in range(parts):
            # What is known of words goes along, a range with each of the first blobs, and comes back with the answers.
            own = known[part] if part < len(known) else {"shard": shard.name}
            blob = len(blobs[part][0]).to_bytes(8, "little") + b"".join(blobs[part])
            rows.append(own | {"part": part, "size": sizes[part][0] << 32 | sizes[part][1], "blob": blob, "counts": b"".join(counts[part])})
        return _rows(rows, f"{_ASK}, {_KNOWN}")

    return run


def _count_grams(table: pa.Table) -> pa.Table:
    """An owner's answer to each shard: the training counts of its pairs and triples, in its order."""
    common.plain_memory()
    common.trim()
    asked, grams, counts = [], ([], []), ([], [])
    for size, blob, c in zip(table["size"].to_pylist(), table["blob"].to_pylist(), table["counts"].to_pylist(), strict=True):
        n = size >> 32, size & 0xFFFFFFFF
        cut = 8 + int.from_bytes(blob[:8], "little")
        grams[0].append(unpack(blob[8:cut], n[0], 2))
        grams[1].append(unpack(blob[cut:], n[1], 3))
        one, at = _from_planes(c, n[0])
        counts[0].append(one)
        counts[1].append(_from_planes(c, n[1], at)[0])
        asked.append(n)
    totals = []
    for kind in (0, 1):
        key = None
        for column in range(kind + 2):
            c = np.concatenate([g[column] for g in grams[kind]])
            names, rank = np.unique(c, return_inverse=True)
            # A pair of ranks is one number; it is ranked again before a third is put to it.
            key = rank if key is None else np.unique(key * len(names) + rank, return_inverse=True)[1]
        total = np.bincount(key, weights=np.concatenate(counts[kind])).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        totals.append(total[key])
    answers, at = [], [0, 0]
    for n in asked:
        answers.append(b"".join(_planes(totals[k][at[k] : at[k] + n[k]]) for k in (0, 1)))
        at = [at[0] + n[0], at[1] + n[1]]
    return table.drop_columns(["blob", "counts"]).append_column("counts", pa.array(answers, pa.binary()))


class Automaton:
    """States, arcs and failure arcs of the part of the model that one shard's texts can reach.

    State 0 is the root, 1 + word a history of one word (word 0: the start of a text),
    then come the pairs.  Weights are log10 probabilities.
    """

    def __init__(self, shard: Shard, n_total: int, v_total: int, mu=MU):
        size, c1, pair_counts, triple_counts = shard.size, shard.counts, shard.pair_counts, shard.triple_counts
        p1 = (c1 + 0.1) / (n_total + 0.1 * (v_total + 1))
        head, tail = shard.pairs // size, shard.pairs % size
        p2 = (pair_counts + mu[0] * p1[tail]) / (c1[head] + mu[0])
        pair = shard.triples // size
        p3 = (triple_counts + mu[1] * p2[shard.triple_tail]) / (pair_counts[pair] + mu[1])
        goes_on = np.ones(size, bool)
        goes_on[shard.end_word] = False
        word_state = np.where((c1 > 0) & goes_on, 1 + np.arange(size), 0)
        # A pair that training has not seen is no state: its last word is.
        pair_state = np.where((pair_counts > 0) & goes_on[tail], 1 + size + np.arange(len(tail)), word_state[tail]).astype(np.int32)
        self.size, self.start = size, 1
        self.root_weight, self.root_target = np.log10(p1), word_state
        self.fail = np.concatenate(([0], np.zeros(size, np.int32), word_state[tail])).astype(np.int32)
        self.fail_weight = np.concatenate(([0.0], np.log10(mu[0] / (c1 + mu[0])), np.log10(mu[1] / (pair_counts + mu[1]))))
        two, three = np.flatnonzero(pair_counts > 0), np.flatnonzero(triple_counts > 0)
        key = np.concatenate(((1 + head[two]) * size + tail[two], (1 + size + pair[three]) * size + shard.triples[three] % size))
        weight = np.concatenate((p2[two], p3[three]))
        target = np.concatenate((pair_state[two], pair_state[shard.triple_tail[three]]))
        del head, tail, pair, p2, p3, two, three
        # Arcs lie in buckets of a hash of state and word.
        bits = max(4, int(len(key)).bit_length() - 1)
        self._shift = _U(64 - bits)
        slot = self._slot(key).astype(np.int32)
        self._first = np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=1 << bits)))).astype(np.int32)
        order = np.argsort(slot).astype(np.int32)
        del slot
        self._key, self._weight, self._target = key[order], np.log10(weight[order]), target[order]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def arcs(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The arc of each state for a word, -1 without one."""
        key = state * self.size + word
        slot = self._slot(key)
        at, end = self._first[slot], self._first[slot + 1]
        at, out = at.copy(), np.full(len(key), -1, np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self._key[at[live]] == key[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 weight) of each state for a word."""
        weight, target = np.zeros(len(state)), np.zeros(len(state), np.int64)
        state = state.copy()
        live = np.arange(len(state))
        while len(live):
            rooted = state[live] == 0
            at = live[rooted]
            weight[at] += self.root_weight[word[at]]
            target[at] = self.root_target[word[at]]
            live = live[~rooted]
            arc = self.arcs(state[live], word[live])
            found = arc >= 0
            at = live[found]
            weight[at] += self._weight[arc[found]]
            target[at] = self._target[arc[found]]
            live = live[~found]
            weight[live] += self.fail_weight[state[live]]
            state[live] = self.fail[state[live]]
        return target, weight

    def read(self, words: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """log10 probability of each text, words[offsets[i] : offsets[i + 1]]."""
        sizes = np.diff(offsets)
        per_text = -(-sizes // segment)
        first = np.concatenate(([0], np.cumsum(per_text)))
        text = np.repeat(np.arange(len(sizes)), per_text)
        begin = offsets[text] + (np.arange(first[-1]) - first[text]) * segment
        length = np.minimum(segment, offsets[text + 1] - begin)
        state = np.full(len(begin), self.start)
        later = np.flatnonzero(begin > offsets[text])
        state[later] = 0
        for back in (2, 1):
            state[later] = self.step(state[later], words[begin[later] - back])[0]
        order = np.argsort(-length, kind="stable")  # the longest first: those that go on are in front
        state, begin, total = state[order], begin[order], np.zeros(len(order))
        on = np.searchsorted(-length[order], -np.arange(segment), side="left")
        for i in range(segment):
            n = on[i]
            if not n:
                break
            state[:n], weight = self.step(state[:n], words[begin[:n] + i])
            total[:n] += weight
        out = np.empty(len(order))
        out[order] = total
        return np.add.reduceat(out, first[:-1])


def _score(mu):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        common.plain_memory()
        common.trim()
        grams = _answered(answers)
        shard = _numbered(texts, grams)
        words = [r for r in grams if r["w_size"] is not None]
        n_total, v_total = (sum(r[c] for r in words) for c in ("n_range", "v_range"))
        at = [0] * len(grams)
        for kind, (which, columns, counts) in enumerate(shard.asked()):
            order, parts = np.argsort(_owner(columns, len(grams)), kind="stable"), []
            for part, r in enumerate(grams):
                one, at[part] = _from_planes(r["counts"], r["size"] >> 32 if kind == 0 else r["size"] & 0xFFFFFFFF, at[part])
                parts.append(one)
            counts[which[order]] = np.concatenate(parts)
        for r in grams:
            del r["counts"]
        automaton = Automaton(shard, n_total, v_total, mu)
        score = automaton.read(shard.words, shard.offsets)
        starts = shard.offsets[:-1]
        base = np.add.reduceat(automaton.root_weight[shard.words], starts)
        known = np.add.reduceat((shard.counts[shard.words] > 0).astype(np.int64), starts)
        n = len(starts)
        return pa.Table.from_arrays(
            [shard.keys["doc_id"], shard.keys["held_out"], pa.array(np.diff(shard.offsets)), pa.array(known), pa.array(np.full(n, n_total, np.int64)), pa.array(base), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def backoff_scores(docs: DataFrame, held_out, mu: tuple[float, float] = MU, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    held_out: a boolean column; texts where it is true are scored but not learnt from.
    """
    common.settings(docs.sparkSession)
    shards = common.shards_for(common.text_bytes(docs), shard_bytes)
    word_parts = max(1, shards // WORDS_SHARE)
    whole = docs.select(F.col("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = whole.mapInArrow(_encode(shard_bytes), _SHARD).repartition(shards, "shard")
    words = texts.groupBy("shard").applyInArrow(_ask_words(word_parts), _ASK).groupBy("part").applyInArrow(_number_words(word_parts), f"shard long, part int, {_KNOWN}")
    asked = texts.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(_ask_grams(shards), f"{_ASK}, {_KNOWN}")
    answers = asked.groupBy("part").applyInArrow(_count_grams, f"shard long, part int, size long, {_KNOWN}, counts binary")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
        _score(mu), f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op1(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0
    return backoff_scores(docs, held)
