"""Toxicity scores by a convolutional text classifier in numpy.

A word is a run of letters and digits.  It is embedded as the sum of hashed
vectors of the word and of its first 4 to 7 bytes, so unseen forms of a known
stem have a place.  Filters of widths 1 to 3 run over the words of a whole text;
the three largest answers of each filter (k-max pooling) feed a logistic layer.
Everything is trained by Adam in one task from a bounded sample of labelled
rows (TRAIN_ROWS), beginning with vectors whose first place is the shrunken
log-odds of the bucket.  A quarter of the sample is kept from training and sets
a threshold for each language, which is guessed from function words of the text;
the threshold becomes 0.5 of the score.  Column lang is never read.

Defined cases: a null or empty text, or one without words, gets the score of an
empty text; without any labelled row of both classes all scores are 0; repeated
rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, tokens

#: Labelled rows that the classifier is fitted on, at most: the first by a hash of doc_id.
TRAIN_ROWS = 6000
BUCKETS = 1 << 18
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
TOP = 3
PREFIXES = (4, 5, 6, 7)
#: Empty rows before a text: as many as keep filters within it and give TOP answers to an empty text.
PAD = max(TOP, max(WIDTHS) - 1)
EPOCHS = 6
BATCH = 64
#: Texts of one forward pass in bytes.
CHUNK_BYTES = 1 << 20

_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Function words by which the language of a text is guessed, for its threshold only.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on with as by this be are from at have not".split(),
    "fr": "le la les de des et un une que qui pour dans est sur pas par avec au du elle il".split(),
    "de": "der die das und ist von zu mit den ein eine nicht auf für im sich auch dem als".split(),
    "es": "el la los las de que y en un una por con para se del no su al lo como más".split(),
}
LANGS = [*FUNCTION_WORDS, "other"]


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((tokens.hash_word(w), i) for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws)
    return np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])


_HASHES, _HASH_LANG = _word_table()


def features(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES):
    """Chunks of (buckets, offsets, language): a row of buckets a word, with PAD empty rows before each text."""
    for _, raw, ends in tokens.joined(texts, chunk_bytes):
        word = _WORDY[raw]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate(([0], edge))
        starts, stops = edge[0::2], edge[1::2]  # a text ends in a separator, so words are closed
        hashes = tokens.Hasher(raw)
        whole = hashes(starts, stops)
        rows = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
        rows[:, 0] = (whole >> np.uint64(40)) % np.uint64(BUCKETS)
        for j, n in enumerate(PREFIXES):
            h = hashes(starts, np.minimum(stops, starts + n))
            rows[:, j + 1] = np.where(stops - starts >= n, (tokens.mix(h + np.uint64(n)) >> np.uint64(40)) % np.uint64(BUCKETS), BUCKETS)
        per_text = np.searchsorted(starts, ends)
        counts = np.diff(per_text, prepend=0)
        text_of = np.repeat(np.arange(len(ends)), counts)
        at = np.arange(len(starts)) + PAD * (text_of + 1)
        out = np.full((len(starts) + PAD * len(ends), rows.shape[1]), BUCKETS, np.int32)
        out[at] = rows
        offsets = np.concatenate(([0], per_text)) + PAD * np.arange(len(ends) + 1)
        spot = np.minimum(np.searchsorted(_HASHES, whole), len(_HASHES) - 1)
        known = _HASHES[spot] == whole
        # A word that two languages share counts for the first alone; the others have enough of their own.
        hits = np.bincount(text_of[known] * len(FUNCTION_WORDS) + _HASH_LANG[spot[known]], minlength=len(ends) * len(FUNCTION_WORDS)).reshape(len(ends), -1)
        yield out, offsets, np.where(hits.max(axis=1) > 0, hits.argmax(axis=1), len(FUNCTION_WORDS))


class Model:
    """Embeddings, filters and the logistic layer."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"emb": np.zeros((BUCKETS + 1, DIM), np.float32), "out": np.zeros(TOP * FILTERS * len(WIDTHS), np.float32), "bias": np.zeros(1, np.float32)}
        self.p["emb"][:-1, 1:] = rng.normal(0, 0.02, (BUCKETS, DIM - 1))
        for w in WIDTHS:
            conv = rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32)
            conv[:, 0, :] += 1.0 / w
            self.p[f"conv{w}"], self.p[f"shift{w}"] = conv, np.zeros(FILTERS, np.float32)
            at = WIDTHS.index(w) * FILTERS * TOP
            self.p["out"][at : at + FILTERS * TOP] = np.repeat([0.06, 0.03, 0.02], FILTERS)[: FILTERS * TOP]
        self.shift = np.zeros(len(LANGS), np.float64)
        self.ready = False

    def pooled(self, rows: np.ndarray, offsets: np.ndarray):
        """k-max pooled answers of each text, the words' vectors, and where each answer came from."""
        emb = self.p["emb"]
        x = emb[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            x += emb[rows[:, j]]
        outs, places = [], []
        starts, counts = offsets[:-1], np.diff(offsets)
        for w in WIDTHS:
            conv = self.p[f"conv{w}"]
            z = x @ conv[w - 1]
            for j in range(1, w):  # a filter ends at its row; empty rows keep texts apart
                z[j:] += x[:-j] @ conv[w - 1 - j]
            z += self.p[f"shift{w}"]
            for _ in range(TOP):
                best = np.maximum.reduceat(z, starts, axis=0)
                r, f = np.nonzero(z == np.repeat(best, counts, axis=0))
                where = np.zeros(best.shape, np.int64)
                where[np.searchsorted(offsets, r, side="right") - 1, f] = r  # one place of equal answers
                places.append(where)
                outs.append(best)
                z[where, np.arange(FILTERS)] = -30.0
        return np.maximum(np.concatenate(outs, axis=1), -5.0), x, places

    def logits(self, rows, offsets) -> np.ndarray:
        """As `pooled` and the logistic layer, but by selection instead of tracking places."""
        emb = self.p["emb"]
        x = emb[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            x += emb[rows[:, j]]
        x = np.ascontiguousarray(x.T)
        z = np.empty((len(WIDTHS) * FILTERS, x.shape[1]), np.float32)
        weights = np.empty((len(WIDTHS) * FILTERS, TOP), np.float32)
        for i, w in enumerate(WIDTHS):
            own = z[i * FILTERS : (i + 1) * FILTERS]
            conv = self.p[f"conv{w}"]
            np.matmul(conv[w - 1].T, x, out=own)
            for j in range(1, w):
                own[:, j:] += conv[w - 1 - j].T @ x[:, :-j]
            own += self.p[f"shift{w}"][:, None]
            for t in range(TOP):
                weights[i * FILTERS : (i + 1) * FILTERS, t] = self.p["out"][(i * TOP + t) * FILTERS : (i * TOP + t + 1) * FILTERS]
        out = np.empty(len(offsets) - 1)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            n = b - a
            top = np.partition(z[:, a:b], range(n - TOP, n), axis=1)[:, n - TOP :][:, ::-1] if n > TOP else np.sort(z[:, a:b], axis=1)[:, ::-1]
            out[i] = (np.maximum(top, -5.0) * weights).sum()
        return out + self.p["bias"][0]

    def fit(self, sets: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, lang: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(sets))
        cut = max(1, len(sets) // 4)
        hold, use = order[:cut], order[cut:]
        if labels[use].min(initial=1) == labels[use].max(initial=0) or not len(use):
            hold = use = order
        self._odds([sets[i] for i in use], labels[use])
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            turn = rng.permutation(use)
            for at in range(0, len(turn), BATCH):
                step += 1
                ids = turn[at : at + BATCH]
                self._step([sets[i] for i in ids], labels, ids, moments, step)
        self._calibrate([sets[i] for i in hold], labels[hold], lang[hold])
        self.ready = True

    def _odds(self, sets, labels) -> None:
        seen = np.zeros((2, BUCKETS + 1))
        for rows, y in zip(sets, labels, strict=True):
            seen[y, np.unique(rows)] += 1
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        prior = 6.0
        odds = np.log((seen[1] + prior * share) / (seen[0] + prior * (1 - share))) - np.log(share / (1 - share))
        self.p["emb"][:-1, 0] = np.clip(odds[:-1], -1, 5) * 0.5
        self.p["bias"][0] = np.log(share / (1 - share)) - 1.0

    def _step(self, sets, labels, ids, moments, step) -> None:
        rows = np.concatenate(sets)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        v, x, places = self.pooled(rows, offsets)
        y = labels[ids].astype(np.float32)
        z = v @ self.p["out"] + self.p["bias"][0]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(ids)
        g = {"out": v.T @ d + 1e-4 * self.p["out"], "bias": np.array([d.sum()], np.float32)}
        back = (d[:, None] * self.p["out"]) * (v > -5.0)
        dx_at, dx = [], []
        for i, w in enumerate(WIDTHS):
            conv = self.p[f"conv{w}"]
            gc, gs = np.zeros_like(conv), np.zeros(FILTERS, np.float32)
            for t in range(TOP):
                b = back[:, (i * TOP + t) * FILTERS : (i * TOP + t + 1) * FILTERS]
                r = places[i * TOP + t]
                gs += b.sum(axis=0)
                for j in range(w):
                    at = np.maximum(r - j, 0)
                    gc[w - 1 - j] += np.einsum("nfd,nf->df", x[at], b)
                    dx_at.append(at.ravel())
                    dx.append((b[:, :, None] * conv[w - 1 - j].T[None]).reshape(-1, DIM))
            g[f"conv{w}"], g[f"shift{w}"] = gc, gs
        at, grad = np.concatenate(dx_at), np.concatenate(dx)
        touched = rows[at].ravel()
        grad = np.repeat(grad, rows.shape[1], axis=0)
        buckets, where = np.unique(touched, return_inverse=True)
        ge = np.zeros((len(buckets), DIM), np.float32)
        np.add.at(ge, where, grad)
        ge[buckets == BUCKETS] = 0
        rate = 0.01
        for k, value in g.items():
            m, s = moments[k]
            m[:] = 0.9 * m + 0.1 * value
            s[:] = 0.999 * s + 0.001 * value * value
            self.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        m, s = moments["emb"]  # only touched rows move
        m[buckets] = 0.9 * m[buckets] + 0.1 * ge
        s[buckets] = 0.999 * s[buckets] + 0.001 * ge * ge
        self.p["emb"][buckets] -= rate * m[buckets] / (np.sqrt(s[buckets]) + 1e-4)

    def _calibrate(self, sets, labels, lang) -> None:
        z = np.concatenate([self.logits(s, np.array([0, len(s)])) for s in sets])

        def best(z, y) -> float:
            order = np.argsort(z)
            z, y = z[order], y[order]
            right = np.concatenate(([0], np.cumsum(1 - y))) + y.sum() - np.concatenate(([0], np.cumsum(y)))
            top = np.flatnonzero(right == right.max())  # cuts that err least; the middle one of the widest run
            at = top[len(top) // 2]
            lo, hi = (z[at - 1] if at else z[0] - 1), (z[at] if at < len(z) else z[-1] + 1)
            return float((lo + hi) / 2)

        every = best(z, labels)
        for i in range(len(LANGS)):
            own = lang == i
            n = int(labels[own].sum())
            # A language moves from the threshold of all towards its own with the number of its positives.
            trust = n / (n + 10.0) if n >= 5 and n < own.sum() else 0.0
            self.shift[i] = every if not trust else trust * best(z[own], labels[own]) + (1 - trust) * every

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.ready:
            return np.zeros(len(texts))
        out = [np.zeros(0)]
        for rows, offsets, lang in features(texts):
            z = self.logits(rows, offsets) - self.shift[lang]
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out)


def fit(sample: pa.Table) -> Model:
    """A model of labelled texts (doc_id, text, toxic)."""
    model = Model()
    sample = sample.take(pc.sort_indices(sample["doc_id"]))
    y = sample["toxic"].to_numpy().astype(np.int64).clip(0, 1)
    if not len(y) or y.min() == y.max():
        return model
    sets, langs = [], []
    for part, offsets, lang in features(sample["text"]):
        sets += [part[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        langs.append(lang)
    model.fit(sets, y, np.concatenate(langs))
    return model


def train(docs: DataFrame, labels: DataFrame, may_learn, rows: int = TRAIN_ROWS) -> Model:
    """Fits a model on at most `rows` labelled documents for which the column may_learn (of doc_id) holds.

    One task fits it: its input is bounded by `rows`, and the driver gets the model alone.
    """
    common.settings(docs.sparkSession)
    some = (
        labels.where("doc_id is not null and toxic is not null").where(may_learn).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    )
    # The sample is bounded by `rows`, so it is what is broadcast; texts are not shuffled.
    got = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    sample = got.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))

    def run(batches):
        batches = list(batches)
        if batches:
            made = pickle.dumps(fit(pa.Table.from_batches(batches)))
            common.trim()
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").first()
    common.tidy(docs.sparkSession)
    return pickle.loads(bytes(made.model)) if made else Model()


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Columns keep, then score and predicted, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        common.plain_memory()
        for batch in batches:
            s = shared.value.scores(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])
        common.trim()

    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text")).mapInArrow(run, f"{head}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns, in one pass."""
    columns = docs.columns
    at = columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        common.plain_memory()
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at).cast(pa.string())) < 0.5))
        common.trim()

    return docs.mapInArrow(run, docs.schema)


def held_out(key="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(5)) == 0


def op7(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model, "doc_id").select("doc_id", held_out().alias("held_out"), "score", "predicted")
