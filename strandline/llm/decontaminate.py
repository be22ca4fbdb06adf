"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of whole texts, half overlapping, in several sizes.  Their
TF-IDF vectors over the benchmark's words, hashed to a fixed number of features, are
projected to a latent space found by a randomised singular value decomposition of
the benchmark's items and all passages of all documents.  The decomposition is
distributed: with A the passages' matrix and R a random one, each task adds up its
own share of A'(A R), which has the size of features times rank; the sum's
orthonormal basis, made on the driver, spans the latent space.  Every passage is
then held against every item by cosine, in blocks: the items are the query set.

Beside it an exact search takes every run of a text that holds as many of an item's
word pairs as a copy with the words that LCS_ALONE lets go changed or left out, for
a short item of common words among rare ones has a low cosine, copies included.
Candidates are confirmed by the longest common subsequence of words between the
item and the text around the passage, and, for looser matches, by the item's
answer (its last sentence).

Document frequencies are counted over all documents.  What the driver and the
executors hold has a fixed size (a bitmap of the benchmark's words, idf, basis) but
for the items, of which MAX_ITEMS are searched for in a pass; all passes share one
latent space, so a result does not depend on how many there are.

Defined cases: null or empty texts and items match nothing; items under MIN_WORDS
words are matched word for word only; repeated rows give repeated results; an
empty benchmark or table gives no rows; item_ids that repeat count as one each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, tokens

#: Features that words are hashed to, and latent dimensions.
FEATURES, RANK = 1 << 14, 144
#: Entries of each row of the random matrix.
SIGNS = 4
#: A feature that occurs more often than this in a chunk of texts is frequent there.
OFTEN = 16
#: Words of a passage in the decomposition, and the passages' energy in it against the items'.
PASSAGE, PASSAGE_WEIGHT = 48, 0.1
#: Words per block; windows are 2, 4 and 6 blocks, even numbers.
BLOCK = 12
WINDOWS = (2, 4, 6)
COSINE = 0.25
#: Shares of an item's words, in order, that a text must have: alone, or with most of its answer.
LCS_ALONE, LCS_WITH_ANSWER, ANSWER = 0.8, 0.55, 0.75
MIN_WORDS = 8
MAX_ITEMS = 20_000
#: Bytes of texts that a task of the decomposition takes at once.
_SKETCH_BYTES = 1 << 18
#: Pairs of a text's word pair and an item with it that are held at once, and bits of the bitmap of the benchmark's words.
_POSTINGS = 1 << 21
_TABLE_BITS = 24
#: Rows of the basis that travel together, and the step to which partial sums are rounded, so that their order changes nothing.
_ROWS, _STEP = 256, 2.0**-16
_U = np.uint64


def item_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of an item's words, and of those of its last sentence."""
    (_, h, _), = tokens.words(pa.array([text]))
    body = text.rstrip().rstrip(".!?")
    cut = max(body.rfind(c) for c in ".!?\n")
    (_, answer, _), = tokens.words(pa.array([text[cut + 1 :] if cut >= 0 else text]))
    return h, answer


class Terms:
    """A sorted vocabulary of hashes, with a bit table before the search."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.table = np.zeros(1 << 20, bool)
        self.table[(vocabulary >> _U(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, their terms)."""
        at = np.flatnonzero(self.table[(h >> _U(44)).astype(np.int64)])
        if not len(at) or not len(self.vocabulary):
            return at[:0], at[:0]
        term = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        ok = self.vocabulary[term] == h[at]
        return at[ok], term[ok]


class Features:
    """The features of words that some item has, by a bitmap of fixed size: as it fills, other words have theirs too."""

    def __init__(self):
        self.bits = np.zeros(1 << (_TABLE_BITS - 3), np.uint8)

    def add(self, h: np.ndarray) -> None:
        place = h >> _U(64 - _TABLE_BITS)
        np.bitwise_or.at(self.bits, (place >> _U(3)).astype(np.int64), (_U(1) << (place & _U(7))).astype(np.uint8))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h of words that have one, their features)."""
        place = h >> _U(64 - _TABLE_BITS)
        at = np.flatnonzero((self.bits[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1)
        return at, (h[at] & _U(FEATURES - 1)).astype(np.int64)


def _frequencies(shared):
    def run(batches):
        common.plain_memory()
        features, df, n = shared.value, np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for _, h, offsets in tokens.words(batch.column(0)):
                at, feature = features.find(h)
                text = np.searchsorted(offsets, at, side="right") - 1
                df += np.bincount(np.unique(text * FEATURES + feature) % FEATURES, minlength=FEATURES)
                n += len(offsets) - 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], names=["feature", "n"])

    return run


def document_frequencies(docs: DataFrame, shared) -> tuple[np.ndarray, int]:
    """How many texts each feature is in, over all texts, and how many texts there are."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_frequencies(shared), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(FEATURES, np.int64), 0
    for r in rows:
        if r.feature < 0:
            n = r.n
        else:
            df[r.feature] = r.n
    return df, n


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """idf, above zero for every feature, for a passage that many documents share has only words that many documents have."""
    return (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)


def _random(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A random matrix of features by RANK with SIGNS entries of 1 or -1 a row: their columns and signs."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, RANK, (FEATURES, SIGNS)), rng.choice(np.array([-1, 1], np.float32), (FEATURES, SIGNS))


def run_sums(table: np.ndarray, index: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The sum of table[index] over each run of index that begins at cut: the first rows of all runs, then the second ones, and so on."""
    count = np.diff(np.append(cut, len(index)))
    order = np.argsort(-count, kind="stable")
    head, count = cut[order], count[order]
    total = np.take(table, index[head], axis=0)
    for j in range(1, int(count[0])):
        n = int(np.searchsorted(-count, -j, side="left"))
        total[:n] += np.take(table, index[head[:n] + j], axis=0)
    out = np.empty_like(total)
    out[order] = total
    return out


def sketched(passage: np.ndarray, feature: np.ndarray, idf: np.ndarray, other: float, foreign: np.ndarray, test, out: np.ndarray) -> None:
    """Adds A'(A R) to out, for n passages of unit length; passage, sorted, names the one of each feature.

    foreign: words of each passage without a feature, which count in its length alone.
    """
    used, cut = np.unique(passage, return_index=True)
    if not len(used):
        return
    weight = idf[feature]
    row = np.repeat(np.arange(len(used)), np.diff(np.append(cut, len(passage))))
    columns, signs = test
    place = (row[:, None] * RANK + columns[feature]).ravel()
    y = np.bincount(place, weights=(signs[feature] * weight[:, None]).ravel(), minlength=len(used) * RANK).reshape(len(used), RANK).astype(np.float32)
    # Squared lengths: a feature that a passage repeats counts with its square.
    key, times = np.unique(row * FEATURES + feature, return_counts=True)
    square = np.bincount(key // FEATURES, weights=(times * idf[key % FEATURES]) ** 2, minlength=len(used)) + foreign[used] * other
    y /= square[:, None].astype(np.float32)  # once for each of the two factors
    # Sums of the passages of each feature: frequent ones as a product of matrices, the others row by row.
    times = np.bincount(feature, minlength=FEATURES)
    often = np.flatnonzero(times > OFTEN)
    if len(often):
        slot = np.full(FEATURES, -1)
        slot[often] = np.arange(len(often))
        here = slot[feature]
        on = here >= 0
        counts = np.bincount(here[on] * len(used) + row[on], minlength=len(often) * len(used)).reshape(len(often), len(used)).astype(np.float32)
        out[often] += counts @ y * idf[often][:, None]
        feature, row = feature[~on], row[~on]
    if len(feature):
        order = np.argsort(feature.astype(np.uint16), kind="stable")
        feature, row = feature[order], row[order]
        first = np.flatnonzero(np.concatenate(([True], feature[1:] != feature[:-1])))
        names = feature[first]
        out[names] += run_sums(y, row, first) * idf[names][:, None]


def _sketch(shared, other: float):
    """Each task's share of A'(A R) as rows (block, n passages, part of the matrix)."""

    def run(batches):
        common.plain_memory()
        features, idf = shared.value
        out, total, test = np.zeros((FEATURES, RANK), np.float32), 0, None
        for batch in batches:
            for _, h, offsets in tokens.words(batch.column(0), _SKETCH_BYTES):
                test = _random() if test is None else test
                at, feature = features.find(h)
                text = np.searchsorted(offsets, at, side="right") - 1
                per_text = -(-np.diff(offsets) // PASSAGE)
                first = np.concatenate(([0], np.cumsum(per_text)))
                passage = first[text] + (at - offsets[text]) // PASSAGE
                owner = np.repeat(np.arange(len(per_text)), per_text)
                begin = offsets[owner] + (np.arange(first[-1]) - first[owner]) * PASSAGE
                foreign = np.minimum(PASSAGE, offsets[owner + 1] - begin) - np.bincount(passage, minlength=first[-1])
                sketched(passage, feature, idf, other, foreign, test, out)
                total += int(first[-1])
        if total:
            out = np.round(out / _STEP) * np.float32(_STEP)
            for block in range(0, FEATURES, _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([total]), pa.array([out[block : block + _ROWS].tobytes()], pa.binary())], names=["block", "n", "part"])

    return run


def _added(batches):
    """Sums of the parts of each block: exact, for all are multiples of one step."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, n, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = sums.setdefault(block, [0, np.zeros(_ROWS * RANK)])
            own[0] += n
            own[1] += np.frombuffer(part.as_buffer(), np.float32)
    for block, (n, total) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([n]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["block", "n", "part"])


def passages_sketch(docs: DataFrame, shared, other: float) -> tuple[np.ndarray, int]:
    """A'(A R) over all passages of all documents, and their number."""
    schema = "block long, n long, part binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_sketch(shared, other), schema)
    out, n = np.zeros((FEATURES, RANK), np.float32), 0
    for r in parts.repartition(FEATURES // _ROWS, "block").mapInArrow(_added, schema).collect():
        out[r.block : r.block + _ROWS] = np.frombuffer(r.part, np.float32).reshape(-1, RANK)
        n = r.n
    return out, n


def blocks(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts each text's words into blocks of BLOCK: (block of each text's first word, text of each block, first word of each block)."""
    counts = np.diff(offsets)
    per_text = -(-counts // BLOCK)
    first = np.concatenate(([0], np.cumsum(per_text)))
    text = np.repeat(np.arange(len(counts)), per_text)
    start = offsets[text] + (np.arange(first[-1]) - first[text]) * BLOCK
    return first, text, start


def pairs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size (1 or 2) words, by first word."""
    return h if size == 1 else tokens.mix(h[:-1]) + h[1:]


class Copies:
    """The items of each word pair (of each word, for items of one word), for the exact search."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]]):
        size = np.array([len(h) for _, h, _ in items], np.int64)
        changed = np.where(size < MIN_WORDS, 0, np.floor((1 - LCS_ALONE) * size + 1e-9).astype(np.int64))
        #: A changed word breaks two pairs; the others are within twice the item's length.
        self.need, self.span = np.maximum(size - 1 - 2 * changed, 1), 2 * size
        self.tables = []
        for n in (1, 2):
            having = [(i, np.unique(pairs(h, n))) for i, (_, h, _) in enumerate(items) if min(len(h), 2) == n]
            if having:
                keys, item = np.concatenate([k for _, k in having]), np.repeat([i for i, _ in having], [len(k) for _, k in having])
                order = np.argsort(keys, kind="stable")
                vocabulary, cut = np.unique(keys[order], return_index=True)
                self.tables.append((n, Terms(vocabulary), np.append(cut, len(keys)), item[order]))

    def runs(self, h: np.ndarray, offsets: np.ndarray):
        """(text, item, first word, end) of the runs that may hold a copy."""
        for n, terms, cut, items in self.tables:
            at, term = terms.find(pairs(h, n))
            text = np.searchsorted(offsets, at, side="right") - 1
            whole = at + n <= offsets[text + 1]
            at, term = at[whole], term[whole]
            total = np.cumsum(cut[term + 1] - cut[term])
            reach = int(self.span.max())
            lo = 0
            while lo < len(at):
                held = total[lo - 1] if lo else 0
                hi = max(np.searchsorted(total, held + _POSTINGS), np.searchsorted(at, at[lo] + 2 * reach), lo + 1)
                yield from self._runs(at[lo:hi], term[lo:hi], cut, items, offsets)
                if hi >= len(at):
                    break
                lo = max(lo + 1, np.searchsorted(at, at[hi] - reach))  # a run that the cut went through is seen whole in the next

    def _runs(self, at, term, cut, items, offsets):
        n = cut[term + 1] - cut[term]
        posting = np.repeat(cut[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, pos = items[posting], np.repeat(at, n)
        order = np.lexsort((pos, item))
        item, pos = item[order], pos[order]
        text = np.searchsorted(offsets, pos, side="right") - 1
        end = np.arange(len(pos)) + self.need[item] - 1
        last = np.minimum(end, len(pos) - 1)
        ok = np.flatnonzero((end < len(pos)) & (item[last] == item) & (text[last] == text) & (pos[last] - pos <= self.span[item]))
        item, pos, text = item[ok], pos[ok], text[ok]
        # Of the runs that begin within half an item's length one stands for all, as long as any of them.
        step = np.maximum(self.span[item] // 4, 1)
        place = pos // step
        new = np.ones(len(ok), bool)
        new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1])
        item, pos, text, step = item[new], pos[new], text[new], step[new]
        stop = np.minimum(pos + self.span[item] + step + 2, offsets[text + 1])
        yield from zip(text.tolist(), item.tolist(), pos.tolist(), stop.tolist(), strict=True)


class Space:
    """The latent space: features, idf and projection, all of fixed size."""

    def __init__(self, features: Features, df: np.ndarray, n: int):
        self.features, self.idf = features, weights(df, n)
        self.foreign = float(np.log(n + 1) + 1) ** 2
        self.projection = np.zeros((FEATURES, 1), np.float32)
        self.other = np.float32(self.foreign)

    def vector(self, h: np.ndarray) -> np.ndarray:
        return self.projection[self.features.find(h)[1]].sum(axis=0)

    def energy(self, h: np.ndarray) -> float:
        _, feature = self.features.find(h)
        return float(((np.bincount(feature, minlength=FEATURES) * self.idf) ** 2).sum())

    def fit(self, passages: np.ndarray, n: int, items: np.ndarray, n_items: int) -> None:
        """The span of the items' and the passages' A'(A R), the passages with PASSAGE_WEIGHT of the items' energy."""
        passages *= np.float32(PASSAGE_WEIGHT * n_items / max(n, 1))
        passages += items
        # An orthonormal basis of the columns out of their inner products, which are RANK by RANK; directions without energy go.
        inner = np.zeros((RANK, RANK))
        for at in range(0, FEATURES, _ROWS):
            part = passages[at : at + _ROWS].astype(np.float64)
            inner += part.T @ part
        values, vectors = np.linalg.eigh(inner)
        kept = values > 1e-9 * values[-1]
        turn = np.where(kept, 1 / np.sqrt(np.where(kept, values, 1)), 0) * vectors
        for at in range(0, FEATURES, _ROWS):
            passages[at : at + _ROWS] = passages[at : at + _ROWS] @ turn * self.idf[at : at + _ROWS, None]
        self.projection = passages


class Retriever:
    """A space and the items of one pass: what the executors need."""

    def __init__(self, space: Space, items: list[tuple[int, np.ndarray, np.ndarray]]):
        self.space, self.items = space, items
        self.copies = Copies(items)
        raw = np.stack([space.vector(h) for _, h, _ in items])
        self.latent = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)

    def cosine(self, h: np.ndarray, item: int) -> float:
        """Latent cosine of the words h and an item."""
        vector = self.space.vector(h)
        others = len(h) - len(self.space.features.find(h)[0])
        return float(vector @ self.latent[item] / max(np.sqrt(vector @ vector + others * self.space.other), 1e-6))

    def windows(self, h: np.ndarray, offsets: np.ndarray):
        """For each window size: latent vectors of all windows with any term, their lengths with
        the words that no item has, their texts, and the words they begin and end at."""
        at, term = self.space.features.find(h)
        first, text, start = blocks(h, offsets)
        if not len(at):
            return
        text_of = np.searchsorted(offsets, at, side="right") - 1
        block = first[text_of] + (at - offsets[text_of]) // BLOCK
        # Blocks lie one after the other, with as many empty ones after each text as keep windows within it.
        gap = max(WINDOWS) - 1
        place = np.arange(first[-1]) + gap * text
        sums = np.zeros((first[-1] + gap * len(offsets), self.space.projection.shape[1]), np.float32)
        cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        sums[place[block[cut]]] = run_sums(self.space.projection, term, cut)
        # Words outside the vocabulary have no place in the latent space, but count as rare ones in a window's length.
        inside = np.zeros(len(sums), np.int64)
        inside[place] = np.bincount(block, minlength=first[-1])
        known = np.concatenate(([0], np.cumsum(inside)))
        twos = sums[:-1] + sums[1:]
        for size in WINDOWS:
            step = size // 2
            begin = np.flatnonzero((np.arange(first[-1]) - first[text]) % step == 0)
            terms = known[place[begin] + size] - known[place[begin]]
            begin, terms = begin[terms > 0], terms[terms > 0]
            if not len(begin):
                continue
            vector = twos[place[begin]]
            for j in range(2, size, 2):
                vector += twos[place[begin] + j]
            end = np.minimum(start[begin] + size * BLOCK, offsets[text[begin] + 1])
            others = end - start[begin] - terms
            yield vector, np.sqrt(np.einsum("ij,ij->i", vector, vector) + others * self.space.other), text[begin], start[begin], end

    def candidates(self, h: np.ndarray, offsets: np.ndarray):
        """(text, item, first word, end) of every window and item whose latent cosine reaches COSINE."""
        if not self.items:
            return
        for vector, norm, text, start, end in self.windows(h, offsets):
            # No cosine is above the share of a window's length that lies in the latent space.
            may = np.flatnonzero(np.einsum("ij,ij->i", vector, vector) >= (COSINE * norm) ** 2)
            vector, norm, text, start, end = vector[may], norm[may], text[may], start[may], end[may]
            for at in range(0, len(vector), 8192):
                part = slice(at, at + 8192)
                cos = vector[part] @ self.latent.T
                w, i = np.nonzero(cos >= COSINE * np.maximum(norm[part], 1e-6)[:, None])
                for a, b in zip((w + at).tolist(), i.tolist(), strict=True):
                    yield int(text[a]), b, int(start[a]), int(end[a]), float(cos[a - at, b] / norm[a])


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits: a row of the table is one integer."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = where.get(x, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def verdict(item: np.ndarray, answer: np.ndarray, text: np.ndarray) -> tuple[float, float]:
    """Shares of the item's words and of its answer's that text has in order."""
    return lcs(item, text) / max(len(item), 1), lcs(answer, text) / max(len(answer), 1)


def leaks(share: float, answered: float, size: int) -> bool:
    if size < MIN_WORDS:
        return share >= 1.0
    return share >= LCS_ALONE or (share >= LCS_WITH_ANSWER and answered >= ANSWER)


def may_leak(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether text has enough of the item's words in any order, without which no order of them leaks it."""
    have = set(text.tolist())
    return sum(x in have for x in item.tolist()) >= (1.0 if len(item) < MIN_WORDS else LCS_WITH_ANSWER) * len(item) - 1e-9


def _search(shared, kind):
    def run(batches):
        common.plain_memory()
        r = shared.value
        for batch in batches:
            out = []
            for first, h, offsets in tokens.words(batch.column(1)):
                leaked: set[tuple[int, int]] = set()
                # The exact search is asked only about what the latent one has not found.
                for found_by in (r.candidates(h, offsets), ((*run, None) for run in r.copies.runs(h, offsets))):
                    spans: dict[tuple[int, int], list] = {}
                    for text, i, a, b, cos in found_by:
                        if (text, i) not in leaked:
                            spans.setdefault((text, i), []).append((a, b, cos))
                    for (text, i), found in spans.items():
                        item_id, words, answer = r.items[i]
                        reach = len(words)
                        best = (0.0, 0.0, 0.0, 0)
                        done = -1
                        for a, b, cos in sorted(found):
                            lo, hi = max(offsets[text], a - reach // 2), min(offsets[text + 1], b + reach // 2)
                            if hi <= done:
                                continue
                            done = hi
                            near = h[lo:hi]
                            if not may_leak(words, near):
                                continue
                            cos = r.cosine(h[a:b], i) if cos is None else cos
                            best = max(best, (*verdict(words, answer, near), cos, int(lo - offsets[text])))
                        if leaks(best[0], best[1], len(words)):
                            leaked.add((text, i))
                            out.append((first + text, item_id, best[3], best[2], best[0], best[1]))
            rows = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), *(pa.array([x[j] for x in out], t) for j, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64()), (5, pa.float64())))],
                names=["doc_id", "item_id", "first_word", "cosine", "lcs_share", "answer_share"],
            )
        common.trim()

    return run


def _parts(benchmark: DataFrame):
    """The benchmark's items, MAX_ITEMS or so at a time: (item_id, words, words of the answer)."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    passes = max(1, -(-rows.count() // MAX_ITEMS))
    for i in range(passes):
        items, seen = [], set()
        for row in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).orderBy("item_id", "text").collect():
            h, answer = item_words(row.text)
            if len(h) and (row.item_id, h.tobytes()) not in seen:
                seen.add((row.item_id, h.tobytes()))
                items.append((row.item_id, h, answer if len(answer) else h))
        if items:
            yield items


def latent_space(docs: DataFrame, benchmark: DataFrame) -> Space | None:
    """The space of one benchmark and all documents: a pass for document frequencies, one for the decomposition."""
    context, features, n_items = docs.sparkSession.sparkContext, Features(), 0
    for items in _parts(benchmark):
        features.add(np.unique(np.concatenate([h for _, h, _ in items])))
        n_items += len(items)
    if not n_items:
        return None
    shared = context.broadcast(features)
    space = Space(features, *document_frequencies(docs, shared))
    shared.unpersist()
    shared = context.broadcast((features, space.idf))
    passages, n = passages_sketch(docs, shared, space.foreign)
    shared.unpersist()
    common.tidy(docs.sparkSession)
    own, test = np.zeros((FEATURES, RANK), np.float32), _random()
    for items in _parts(benchmark):
        h, sizes = np.concatenate([h for _, h, _ in items]), [len(h) for _, h, _ in items]
        at, feature = features.find(h)
        sketched(np.repeat(np.arange(len(items)), sizes)[at], feature, space.idf, 0.0, np.zeros(len(items)), test, own)
    space.fit(passages, n, own, n_items)
    # A foreign word would keep as small a share of its energy in the latent space as the items keep of theirs.
    kept = np.concatenate([[float(v @ v) / max(space.energy(h), 1e-9) for _, h, _ in items for v in (space.vector(h),)] for items in _parts(benchmark)])
    space.other = np.float32(space.foreign * np.median(kept))
    return space


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, cosine, lcs_share, answer_share of every item found in every document."""
    spark = docs.sparkSession
    common.settings(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, first_word long, cosine double, lcs_share double, answer_share double"
    space, out = latent_space(docs, benchmark), None
    for items in _parts(benchmark) if space else ():
        shared = spark.sparkContext.broadcast(Retriever(space, items))
        found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_search(shared, kind), schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item was found, with all their columns; rows with a null doc_id stay."""
    found = common.written(contaminated(docs, benchmark).select(F.col("doc_id").alias("_leaky")).distinct(), "leaks")
    return common.without(docs, "doc_id", found, "_leaky")


def op6(spark, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
