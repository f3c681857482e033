"""Toxicity: a bidirectional gated recurrent network with attention, trained in numpy."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbeam.llm.common import map_batches, text_of

SAMPLE_PER_CLASS = 2000  # labelled documents of each class that the model is fitted on
LONGEST_SAMPLED = 20_000  # characters; longer documents are scored, but not fitted on
WORDS, GRAMS = 20_000, 20_000  # most frequent ones of the sample that have vectors
WORD_DIM, GRAM_DIM, HIDDEN = 8, 8, 8
WINDOW, STRIDE = 64, 32  # words; any passage of up to 33 words lies whole in some window
SEGMENT, SEGMENT_STEP = 16, 8  # characters of a word at most, and between a longer run's words
EPOCHS, STEPS, BATCH, RATE = 4, 200, 64, 0.01  # at least so many epochs and so many steps
DOUBT = 4.0  # how many documents a word's or 4-gram's first log-odds are held back by
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")
_UNKNOWN, _PAD = 0, 1  # rows of the tables of words
_SLAB = 2048  # windows scored at once
_MOST_WORDS = 80_000  # distinct words that a Python worker remembers


def segments_of(run: str) -> list[str]:
    """A run's stretches of ``SEGMENT`` characters, one each ``SEGMENT_STEP``; the last one
    ends with the run. Together they hold every 4-gram. A run no longer than one is itself."""
    last = max(0, len(run) - SEGMENT)
    return [run[at : at + SEGMENT] for at in (*range(0, last, SEGMENT_STEP), last)]


def words_of(text: str | None) -> list[str]:
    """The segments of all runs of word characters, in order. Most runs are one word; a
    longer one, such as a sentence in a script without spaces, is several, each with its
    4-grams and its place in the windows."""
    runs = _WORD.findall((text or "").lower())
    if max(map(len, runs), default=0) <= SEGMENT:
        return runs  # each is its only segment
    return [part for run in runs for part in segments_of(run)]


def grams_of(word: str) -> list[str]:
    """Character 4-grams of the word within its bounds."""
    marked = f"^{word}$"
    return [marked[i : i + 4] for i in range(max(1, len(marked) - 3))]


def window_starts(n: int) -> list[int]:
    """Where windows of ``n`` words start. Together they cover every word; the last one
    ends with the text. A text without words has one empty window."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scan(inputs: np.ndarray, ids: np.ndarray, recurrent: np.ndarray, keep: bool):
    """A gated recurrent pass. ``inputs`` has each word's projected gates, ``ids`` the words
    by window and step. Padding has an update gate that lets the state pass unchanged."""
    n, steps = ids.shape
    h = np.zeros((n, HIDDEN), dtype=np.float32)
    states = np.empty((steps, n, HIDDEN), dtype=np.float32)
    trace = []
    for t in range(steps):
        x, g = inputs[ids[:, t]], h @ recurrent
        gates = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        if keep:
            trace.append((h, z, r, new, g[:, 2 * HIDDEN :]))
        h = new + z * (h - new)
        states[t] = h
    return states, trace


def _scan_back(d_states: np.ndarray, trace: list, recurrent: np.ndarray):
    """Gradients of the projected gates (by step and window) and of ``recurrent``."""
    d_recurrent = np.zeros_like(recurrent)
    d_inputs = np.empty((*d_states.shape[:2], 3 * HIDDEN), dtype=np.float32)
    d_h = np.zeros_like(d_states[0])
    for t in range(len(trace) - 1, -1, -1):
        h, z, r, new, g_new = trace[t]
        d_h = d_h + d_states[t]
        d_new = d_h * (1 - z) * (1 - new * new)
        d_z = d_h * (h - new) * z * (1 - z)
        d_r = d_new * g_new * r * (1 - r)
        d_inputs[t] = np.concatenate([d_z, d_r, d_new], axis=1)
        d_gates = np.concatenate([d_z, d_r, d_new * r], axis=1)
        d_recurrent += h.T @ d_gates
        d_h = d_h * z + d_gates @ recurrent.T
    return d_inputs, d_recurrent


@dataclass
class Network:
    """Words enter as a vector of their own beside the mean vector of their 4-grams."""

    words: dict[str, int]
    grams: dict[str, int]
    p: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)  # from a document's logit to its score's logit

    def mixed(self, found: Sequence[str]) -> tuple[np.ndarray, list[list[int]]]:
        """Rows of word ids' inputs before projection, and the 4-grams of each."""
        rows = [[self.grams[g] for g in grams_of(w) if g in self.grams] for w in found]
        ids = [self.words.get(w, _UNKNOWN) for w in found]
        x = np.zeros((len(found), WORD_DIM + GRAM_DIM), dtype=np.float32)
        if found:
            x[:, :WORD_DIM] = self.p["word"][ids]
            sizes = np.array([len(r) for r in rows])
            flat = np.array([g for r in rows for g in r], dtype=np.int64)
            if len(flat):
                owner = np.repeat(np.arange(len(rows)), sizes)
                order = np.flatnonzero(sizes)
                starts = np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
                sums = np.add.reduceat(self.p["gram"][flat], starts, axis=0)
                x[order, WORD_DIM:] = sums / sizes[order, None]
                del owner
        return x, rows

    def projected(self, x: np.ndarray, side: str) -> np.ndarray:
        return x @ self.p[f"in_{side}"] + self.p[f"bias_{side}"]

    def padding(self) -> np.ndarray:
        row = np.zeros((1, 3 * HIDDEN), dtype=np.float32)
        row[:, :HIDDEN] = 30
        return row

    def logits(self, tables: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
        """Logit of each window; ``tables`` holds every word's projected gates by side."""
        ahead, trace_a = _scan(tables["a"], ids, self.p["rec_a"], keep)
        back, trace_b = _scan(tables["b"], ids[:, ::-1], self.p["rec_b"], keep)
        states = np.concatenate([ahead, back[::-1]], axis=2)  # step, window, 2 HIDDEN
        focus = states @ self.p["focus"]
        focus = np.where(ids.T == _PAD, -1e9, focus)
        weight = np.exp(focus - focus.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states, optimize=True)
        out = pooled @ self.p["out"] + self.p["out_bias"][0]
        return out, (states, weight, pooled, trace_a, trace_b)

    def gradients(self, found: Sequence[str], ids: np.ndarray, target: np.ndarray):
        """Mean cross-entropy over windows, and its gradient by every parameter."""
        x, rows = self.mixed(found)
        tables = {
            s: np.concatenate([self.padding(), self.padding(), self.projected(x, s)])
            for s in "ab"
        }
        out, (states, weight, pooled, trace_a, trace_b) = self.logits(tables, ids, keep=True)
        score = _sigmoid(out)
        loss = -np.mean(target * np.log(score + 1e-9) + (1 - target) * np.log(1 - score + 1e-9))
        d_out = ((score - target) / len(target)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"] = pooled.T @ d_out
        g["out_bias"][0] = d_out.sum()
        d_pooled = d_out[:, None] * self.p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled, optimize=True)
        d_focus = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["focus"] = np.einsum("tn,tnh->h", d_focus, states, optimize=True)
        d_states = d_states + d_focus[:, :, None] * self.p["focus"]
        d_x = np.zeros_like(x)
        for side, d_side, trace, order in (
            ("a", d_states[:, :, :HIDDEN], trace_a, ids),
            ("b", d_states[::-1, :, HIDDEN:], trace_b, ids[:, ::-1]),
        ):
            d_in, g[f"rec_{side}"] = _scan_back(d_side, trace, self.p[f"rec_{side}"])
            d_table = np.zeros_like(tables[side])
            np.add.at(d_table, order.T, d_in)
            d_table = d_table[2:]
            g[f"in_{side}"] = x.T @ d_table
            g[f"bias_{side}"] = d_table.sum(axis=0)
            d_x += d_table @ self.p[f"in_{side}"].T
        known = np.array([self.words.get(w, _UNKNOWN) for w in found])
        np.add.at(g["word"], known, d_x[:, :WORD_DIM])
        sizes = np.array([len(r) for r in rows])
        flat = np.array([c for r in rows for c in r], dtype=np.int64)
        if len(flat):
            each = np.repeat(d_x[:, WORD_DIM:] / np.maximum(sizes, 1)[:, None], sizes, axis=0)
            np.add.at(g["gram"], flat, each)
        return loss, g


class Scorer:
    """Scores texts with a network; remembers the projected gates of words it has met."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.tables = {s: np.repeat(self.net.padding(), 2, axis=0) for s in "ab"}

    def _ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.ids) > _MOST_WORDS:
            self.forget()
        known = self.ids
        new = dict.fromkeys(w for words in texts for w in words if w not in known)
        if new:
            known.update(zip(new, range(len(known) + 2, len(known) + 2 + len(new)), strict=True))
            x, _ = self.net.mixed(list(new))
            for s in "ab":
                self.tables[s] = np.concatenate([self.tables[s], self.net.projected(x, s)])
        return [np.array([known[w] for w in words], dtype=np.int32) for words in texts]

    def windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All windows of all texts as rows of word ids, and the text that each is of."""
        ids = self._ids(texts)
        starts = [window_starts(len(i)) for i in ids]
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
        out = np.full((len(owner), WINDOW), _PAD, dtype=np.int32)
        row = 0
        for words, places in zip(ids, starts, strict=True):
            for at in places:
                part = words[at : at + WINDOW]
                out[row, : len(part)] = part
                row += 1
        return out, owner

    def window_logits(self, ids: np.ndarray) -> np.ndarray:
        """Windows are scored in slabs, short ones first and only as far as they reach."""
        out = np.empty(len(ids), dtype=np.float32)
        lengths = (ids != _PAD).sum(axis=1)
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), _SLAB):
            rows = order[at : at + _SLAB]
            out[rows] = self.net.logits(self.tables, ids[rows, : max(1, lengths[rows[-1]])])[0]
        return out

    def document_logits(self, texts: list[list[str]]) -> np.ndarray:
        """The highest logit among a text's windows."""
        ids, owner = self.windows(texts)
        logits = self.window_logits(ids)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        return np.maximum.reduceat(logits, first)

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """Score of each text, a few hundred thousand characters at a time."""
        out: list[np.ndarray] = []
        chunk: list[list[str]] = []
        held = 0
        for text in texts:
            chunk.append(words_of(text))
            held += len(chunk[-1])
            if held > 100_000:
                out.append(self.document_logits(chunk))
                chunk, held = [], 0
        if chunk:
            out.append(self.document_logits(chunk))
        logits = np.concatenate(out) if out else np.empty(0)
        slope, shift = self.net.scale
        return _sigmoid(slope * logits.astype(np.float64) + shift)


def _vocabulary(
    texts: list[list[str]], target: np.ndarray, most: int, first: int, parts
) -> tuple[dict[str, int], np.ndarray]:
    """The most frequent parts by documents (at least three), and the log-odds of a toxic
    document that has them, drawn to zero as if ``DOUBT`` more documents had shown none."""
    both, bad = Counter(), Counter()
    for words, y in zip(texts, target, strict=True):
        found = {p for w in set(words) for p in parts(w)}
        both.update(found)
        if y:
            bad.update(found)
    chosen = sorted((p for p in both if both[p] > 2), key=lambda p: (-both[p], p))[:most]
    n = np.array([max(1, (target == y).sum()) for y in (0, 1)])
    doubt = DOUBT * n / n.sum()
    seen = np.array([[both[p] - bad[p], bad[p]] for p in chosen]).reshape(-1, 2)
    clean, toxic = np.log((seen + doubt) / (n + DOUBT)).T
    return {p: i + first for i, p in enumerate(chosen)}, (toxic - clean).astype(np.float32)


def _initial(texts: list[list[str]], target: np.ndarray, rng: np.random.Generator) -> Network:
    """One coordinate of every vector starts as its log-odds, all else at random."""
    words, word_odds = _vocabulary(texts, target, WORDS, 2, lambda w: (w,))
    grams, gram_odds = _vocabulary(texts, target, GRAMS, 0, grams_of)

    def small(*shape: int, by: float = 0.3) -> np.ndarray:
        return (rng.standard_normal(shape) * by).astype(np.float32)

    p = {"word": small(len(words) + 2, WORD_DIM, by=0.05), "gram": small(max(1, len(grams)), GRAM_DIM, by=0.05)}
    p["word"][:, 0], p["gram"][:, 0] = 0, 0
    p["word"][2:, 0], p["gram"][: len(grams), 0] = word_odds, gram_odds
    for side in "ab":
        p[f"in_{side}"] = small(WORD_DIM + GRAM_DIM, 3 * HIDDEN)
        p[f"bias_{side}"] = np.zeros(3 * HIDDEN, dtype=np.float32)
        p[f"rec_{side}"] = small(HIDDEN, 3 * HIDDEN)
    p["focus"], p["out"] = small(2 * HIDDEN), small(2 * HIDDEN)
    p["out_bias"] = np.zeros(1, dtype=np.float32)
    return Network(words, grams, p)


def _calibrated(logits: np.ndarray, target: np.ndarray, rate: float) -> tuple[float, float]:
    """Logistic regression of the label on the logit, each class weighing as in all labels.

    A pull towards slope 1 keeps it finite where the classes are apart, and steps are
    shortened until they improve."""
    weight = np.where(target == 1, rate, 1 - rate) / np.array(
        [max(1, (target == y).sum()) for y in (0, 1)]
    )[target.astype(int)]
    x = np.stack([logits, np.ones_like(logits)], axis=1).astype(np.float64)
    start = np.array([1.0, 0.0])

    def loss(theta: np.ndarray) -> float:
        signed = np.where(target == 1, 1, -1) * (x @ theta)
        return float(weight @ np.logaddexp(0, -signed) + 0.005 * ((theta - start) ** 2).sum())

    theta = start
    for _ in range(30):
        score = _sigmoid(x @ theta)
        gradient = x.T @ (weight * (score - target)) + 0.01 * (theta - start)
        hessian = (x * (weight * score * (1 - score))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        while loss(theta - step) > loss(theta) and np.abs(step).max() > 1e-6:
            step = step / 2
        theta = theta - step
    return float(theta[0]), float(theta[1])


def train(texts: Sequence[str | None], toxic: Sequence[int], rate: float, seed: int = 7) -> Network:
    """Fit on whole documents whose label holds for some window of theirs.

    In every epoch a toxic document is represented by the window that now scores highest,
    a clean one by its highest and by one at random. Every fifth document is kept out of
    this and calibrates the scores. ``rate``: share of toxic documents among all labels.
    """
    rng = np.random.default_rng(seed)
    target = np.asarray(toxic, dtype=np.float32)
    shared: dict[str, str] = {}  # one object per word, however often it occurs
    words = [[shared.setdefault(w, w) for w in words_of(t)] for t in texts]
    aside = np.arange(len(words)) % 5 == 4
    if len(set(target[~aside])) < 2:  # the labels tell nothing apart
        net = _initial(words, target, rng)
        net.p["out"][:] = 0
        return Network(net.words, net.grams, net.p, (0.0, -30.0 if rate < 1 else 30.0))
    fit = [w for w, a in zip(words, aside, strict=True) if not a]
    fit_target = target[~aside]
    net = _initial(fit, fit_target, rng)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(fit) + int((fit_target == 0).sum()))))
    for epoch in range(epochs):
        scorer = Scorer(net)
        ids, owner = scorer.windows(fit)
        spelt = [None, None, *scorer.ids]
        logits = scorer.window_logits(ids) if epoch else _evidence(net, scorer, ids)
        order = np.lexsort((logits, owner))
        best = order[np.flatnonzero(np.diff(owner[order], append=-1))]
        clean = np.flatnonzero(fit_target[owner] == 0)
        some = rng.choice(clean, size=min(len(clean), int((fit_target == 0).sum())), replace=False)
        chosen = rng.permutation(np.concatenate([best, some]))
        for at in range(0, len(chosen), BATCH):
            rows = chosen[at : at + BATCH]
            used, local = np.unique(ids[rows], return_inverse=True)
            real = used[used != _PAD]
            shift = np.where(used == _PAD, _PAD, np.searchsorted(real, used) + 2)
            _, g = net.gradients(
                [spelt[i] for i in real],
                shift[local.reshape(len(rows), WINDOW)],
                fit_target[owner[rows]],
            )
            step += 1
            for k, (m, v) in moment.items():
                m += 0.1 * (g[k] - m)
                v += 0.001 * (g[k] ** 2 - v)
                size = np.sqrt(v / (1 - 0.999**step)) + 1e-8
                net.p[k] -= (RATE * (1 - epoch / epochs) * m / (1 - 0.9**step) / size).astype(
                    np.float32
                )
    asked = np.flatnonzero(aside) if len(set(target[aside])) == 2 else np.arange(len(words))
    logits = Scorer(net).document_logits([words[i] for i in asked])
    net.scale = _calibrated(logits, target[asked], rate)
    return net


def _evidence(net: Network, scorer: Scorer, ids: np.ndarray) -> np.ndarray:
    """Before the first epoch, windows rank by the log-odds of their words and 4-grams."""
    x, _ = net.mixed(list(scorer.ids))
    odds = np.concatenate([[0, 0], np.maximum(x[:, 0], 0) + np.maximum(x[:, WORD_DIM], 0)])
    return odds[ids].sum(axis=1)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Network:
    """Train on at most ``per_class`` labelled documents of each class.

    The sample is drawn from the labels alone, by a hash of the id, and fetched in one scan
    of ``docs`` against a broadcast of at most ``4 * per_class`` ids. Documents beyond
    ``LONGEST_SAMPLED`` characters are left out of it, which bounds what reaches the
    driver. Labels without an id or a value are ignored; of several for one id the highest
    counts. Where all documents found of a class are beyond that length, this is an error,
    since the scores would call everything the other class.
    """
    usable = (
        labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label_toxic"))
    )
    counts = {int(r[0]): r[1] for r in usable.groupBy("label_toxic").count().collect()}
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    sample = None
    for y in (0, 1):
        part = usable.filter(F.col("label_toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id")
        part = part.limit(2 * per_class)
        sample = part if sample is None else sample.unionByName(part)
    sample = sample.select(F.col("doc_id").alias("label_doc_id"), "label_toxic")
    text = text_of(docs)
    rows = (
        docs.select("doc_id", F.when(F.length(text) <= LONGEST_SAMPLED, text).alias("text"))
        .join(F.broadcast(sample), F.col("doc_id") == F.col("label_doc_id"))
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("label_toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .collect()
    )
    short = [r for r in rows if r["text"] is not None]
    chosen = [r for y in (0, 1) for r in [r for r in short if r["toxic"] == y][:per_class]]
    chosen.sort(key=lambda r: r["doc_id"])
    unseen = {r["toxic"] for r in rows} - {r["toxic"] for r in chosen}
    if unseen:
        raise ValueError(f"all documents labelled {unseen} are over {LONGEST_SAMPLED} characters")
    return train([r["text"] for r in chosen], [r["toxic"] for r in chosen], rate)


def _score_batches(net, batches: Iterator[pa.RecordBatch], text: str):
    scorer = Scorer(net.value)
    for batch in batches:
        parts = (batch[text].slice(at, 512) for at in range(0, batch.num_rows, 512))
        scores = [scorer.scores(part.to_pylist()) for part in parts]
        yield batch, np.concatenate([np.empty(0), *scores])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted.

    Each text is scored where it is read, over all its overlapping windows; its score comes
    from the highest. Nothing is shuffled. The network that is broadcast has at most
    ``WORDS + GRAMS`` vectors. Text without spaces is read to its end, in segments that
    count as words (``words_of``). A missing or empty text is one empty window and gets a score
    like any other. Repeated rows are scored each; a missing doc_id is not held out. Other
    columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _score_batches(shared, batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_batches(narrow, work, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, whole and with all their columns.

    They are filtered in the tasks that score them, so no text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _score_batches(shared, batches, "text"):
            yield batch.filter(pa.array(scores < THRESHOLD))

    return map_batches(docs, work, docs.schema)
