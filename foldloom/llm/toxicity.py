"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

Words are compared by the letter triples they contain in order, neighbours or with letters
between them, weighted down for every letter skipped; an insult with gaps or inserted characters
keeps most of its triples.  A sentence's kernel with a landmark word is the sum over its words of
the normalised word kernel, raised to a power; sums and powers of kernels are kernels, and the
Nyström map of the landmarks turns them into finite vectors.  The machine is trained on labelled
sentences: of a toxic text the one that looks worst, of a clean text the worst and an ordinary
one.  In the linear machine a word contributes a fixed amount to its sentence, so scoring is one
lookup per word; a text scores by the soft maximum of its two worst sentences.

Defined results: null and empty texts score as a sentence without words; rows repeat as given;
without labelled rows of both classes the score is the share of the only class (0.5 without
any); extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import parts, prepare, release, texts_of
from foldloom.llm.training import held_out, labelled_sample, lists_of, logistic, sigmoid
from foldloom.session import cut_lineage

#: Most labelled rows that the model is fitted on; landmarks, toxic-looking and ordinary.
SAMPLE, TOXIC_LANDMARKS, PLAIN_LANDMARKS = 20_000, 96, 16
#: Offsets of the second and third letter of a triple with the letters skipped, the decay of each.
OFFSETS, DECAY, POWER = ((1, 2, 0), (1, 3, 1), (2, 3, 1), (2, 4, 2), (1, 4, 2)), 0.7, 3
WEIGHTS = DECAY ** np.arange(4, dtype=np.float64)
#: Longest stretch of letters compared as one word; longer ones are cut into overlapping pieces.
PIECE, LAP = 32, 8
#: Words whose values a worker keeps; words whose kernels are computed at once; words of a sentence at most.
CACHE, STEP, SPAN = 200_000, 400, 16
#: How close the soft maximum is to the maximum.
SHARPNESS = 4.0
#: Bytes of text taken apart at once.
BATCH_BYTES = 500_000
#: Digits and signs that stand for letters (fixed values).
LOOKALIKE = str.maketrans("013457@$", "oieastas")
LETTERS = re.compile(r"[^\W\d_]+")
#: Three or more single characters in a row, read as one word.
SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")


def plain(word: str) -> str:
    """The letters of a word in lower case, signs inside it dropped and lookalikes read as letters."""
    if word.isalpha():
        return word.lower()
    inner = word.strip(".,;:!?\"'()[]{}|#%&*$")
    if any(c.isalpha() for c in inner):
        inner = inner.translate(LOOKALIKE)
    return "".join(LETTERS.findall(inner)).lower()


def tokens(text: str) -> list[str]:
    return SPELLED.sub(lambda m: "".join(m[0].split()), text).split()


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else [word[k:k + PIECE] for k in range(0, len(word) - LAP, PIECE - LAP)]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, triple, weight) of the letter triples in order within a span of five, between a start and an end mark.

    At most STEP words.  A letter is a number below 64; equal triples of a word are one feature.
    """
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    width = int(sizes.max()) + 2
    grid = np.full((n, width + 4), -1, np.int32)
    grid[:, 0] = 62
    row = np.repeat(np.arange(n), sizes)
    grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1] = np.where((flat >= 97) & (flat <= 122), flat - 96, 27 + flat % 35)
    grid[np.arange(n), sizes + 1] = 63
    first = (np.arange(n, dtype=np.int32)[:, None] << 18) | (grid[:, :width] << 12)
    keys = []
    for second, third, skipped in OFFSETS:
        last = grid[:, third:third + width]
        inside = last >= 0
        keys.append((((first | (grid[:, second:second + width] << 6) | last)[inside]) << 2) | skipped)
    key = np.concatenate(keys)
    key.sort()
    found = key >> 2
    start = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
    weight = np.add.reduceat(WEIGHTS[key & 3], start) if len(found) else np.zeros(0)
    return found[start] >> 18, found[start] & (64 ** 3 - 1), weight


class Landmarks:
    """The triple weights of the landmark words, normalised, listed by triple: few words hold the same one."""

    def __init__(self, words: list[str]):
        self.words = words
        number, triple, weight = triples(words)
        weight = weight / np.sqrt(np.bincount(number, weights=weight ** 2, minlength=len(words)))[number]
        order = np.argsort(triple, kind="stable")
        self.column, self.weight = number[order].astype(np.int64), weight[order]
        self.count = np.bincount(triple, minlength=64 ** 3)
        self.start = np.cumsum(self.count) - self.count

    def kernel(self, words: list[str]) -> np.ndarray:
        """Power of the normalised kernel of each word with each landmark."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        for begin in range(0, len(words), STEP):
            part = words[begin:begin + STEP]
            number, triple, weight = triples(part)
            norm = np.sqrt(np.bincount(number, weights=weight ** 2, minlength=len(part)))
            hit = np.flatnonzero(self.count[triple])
            times = self.count[triple[hit]]
            entry = np.arange(times.sum()) + np.repeat(self.start[triple[hit]] - (np.cumsum(times) - times), times)
            hit = np.repeat(hit, times)
            total = np.bincount(
                number[hit] * len(self.words) + self.column[entry], weights=weight[hit] * self.weight[entry],
                minlength=len(part) * len(self.words))
            value = total.reshape(len(part), -1) / np.maximum(norm, 1e-9)[:, None]
            out[begin:begin + STEP] = value ** POWER
        return out

    def of_words(self, words: list[str]) -> np.ndarray:
        """Kernels of plain words of any length; the pieces of a long one add up."""
        cut = [pieces(w) for w in words]
        if not words:
            return np.zeros((0, len(self.words)), np.float32)
        starts = np.cumsum([0, *map(len, cut)])[:-1]
        return np.add.reduceat(self.kernel([p for c in cut for p in c]), starts, axis=0)


class Machine:
    """Landmarks with their weights: what a word adds to its sentence."""

    def __init__(self, landmarks: Landmarks, weights: np.ndarray, bias: float):
        self.landmarks, self.weights, self.bias = landmarks, weights, bias
        self.slopes, self.offset = np.ones(1), 0.0

    def values(self, raw: list[str]) -> np.ndarray:
        """Values of words as they stand in a text; of those without letters 0."""
        words = [plain(r) for r in raw]
        full = [k for k, w in enumerate(words) if w]
        out = np.zeros(len(raw))
        for begin in range(0, len(full), 20_000):
            part = full[begin:begin + 20_000]
            out[part] = self.landmarks.of_words([words[k] for k in part]) @ self.weights
        return out

    def sentences(self, texts: list[str], known: Lexicon) -> Sentences:
        return known.cut([tokens(t) for t in texts], self)

    def margins(self, texts: list[str], known: Lexicon) -> np.ndarray:
        """Soft maximum of the margins of each text's two worst sentences, as a column; of an empty one where there are fewer."""
        s = self.sentences(texts, known)
        order = np.lexsort((-s.sums, s.owner))
        place = np.arange(len(order)) - np.searchsorted(s.owner[order], s.owner[order])
        worst = np.zeros((len(texts), 2))
        for k in (0, 1):
            at = order[place == k]
            worst[s.owner[at], k] = s.sums[at]
        return np.logaddexp.reduce(SHARPNESS * np.clip(worst + self.bias, -6, 6), axis=1, keepdims=True) / SHARPNESS

    def probabilities(self, texts: list[str], known: Lexicon) -> np.ndarray:
        return sigmoid(self.margins(texts, known) @ self.slopes + self.offset)


class Sentences:
    """Sentences of a batch of texts: words, start and end, text, sum of word values."""

    def __init__(self, words: list[str], starts: np.ndarray, owner: np.ndarray, sums: np.ndarray):
        self.words, self.starts, self.owner, self.sums = words, starts, owner, sums
        self.ends = np.r_[starts[1:], len(words)]


class Lexicon:
    """Values of the words a worker has met, and whether they end a sentence."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.value, self.closes = np.zeros(0), np.zeros(0, bool)

    def cut(self, texts: list[list[str]], machine: Machine) -> Sentences:
        flat = [w for t in texts for w in t]
        if not flat:
            return Sentences([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        new = list(set(flat) - self.index.keys())
        value = np.r_[self.value, machine.values(new)]
        closes = np.r_[self.closes, np.fromiter((w.rstrip("\"')]}#%&*$").endswith((".", "!", "?")) for w in new), bool, len(new))]
        index = self.index
        if len(index) + len(new) <= CACHE:
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.value, self.closes = value, closes
        else:  # full: the new words count for this batch only
            index = _Both(index, dict(zip(new, range(len(index), len(index) + len(new)), strict=True)))
        at = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), sizes)
        opens = np.r_[True, closes[at[:-1]] | (owner[1:] != owner[:-1])]
        begin = np.flatnonzero(opens)
        inside = np.arange(len(flat)) - np.repeat(begin, np.diff(np.r_[begin, len(flat)]))
        starts = np.flatnonzero(inside % SPAN == 0)
        return Sentences(flat, starts, owner[starts], np.add.reduceat(value[at], starts))


class _Both:
    def __init__(self, first: dict[str, int], second: dict[str, int]):
        self.first, self.second = first, second

    def __getitem__(self, word: str) -> int:
        found = self.first.get(word)
        return self.second[word] if found is None else found


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (word, toxic, clean): in how many texts of the batch a word occurs."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for w in {plain(r) for r in set(tokens(text))}:
                if 2 < len(w) <= PIECE:
                    counts.setdefault(w, [0, 0])[1 - label] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))],
            names=["word", "toxic", "clean"])


def _kernel_rows(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, k): landmark kernels of the training sentences of each text, chosen by ``machine``."""
    known = Lexicon()
    for batch in batches:
        labels = iter(batch.column("label").to_pylist())
        rows, kernels = [], [np.zeros((0, len(machine.landmarks.words)), np.float32)]
        for part in parts(batch, "text", BATCH_BYTES):
            texts = texts_of(part)
            s = machine.sentences(texts, known)
            bounds = np.searchsorted(s.owner, np.arange(len(texts) + 1))
            for i in range(len(texts)):
                label = next(labels)
                if bounds[i] == bounds[i + 1]:
                    continue
                worst = int(bounds[i] + s.sums[bounds[i]:bounds[i + 1]].argmax())
                for k in sorted({worst} if label else {worst, int(bounds[i] + bounds[i + 1]) // 2}):
                    words = [w for w in map(plain, s.words[s.starts[k]:s.ends[k]]) if w]
                    rows.append(label)
                    kernels.append(machine.landmarks.of_words(words).sum(0, keepdims=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.array(np.concatenate(kernels).astype(np.float64).tolist(), pa.list_(pa.float64()))],
            names=["label", "k"])
    del known
    release()


def support_vectors(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Primal linear machine with squared hinge loss, by Newton steps over the active rows; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        active = y * (x @ w) < 1
        a, c = x[active], cost[active]
        new = np.linalg.solve(penalty + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Machine | float:
    """The trained machine, or the share of toxic rows where one class is missing."""
    sample = cut_lineage(labelled_sample(docs, labels, "toxic", most).select("label", "text"))
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if set(sizes) != {0, 1}:
        return float(next(iter(sizes))) if sizes else 0.5
    words = cut_lineage(sample.mapInArrow(_word_rows, "word string, toxic long, clean long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    rate = (F.col("toxic") + F.col("clean") + 1) / (sizes[0] + sizes[1] + 2)
    # how far the share among toxic texts exceeds the expected one, in deviations
    excess = (F.col("toxic") - sizes[1] * rate) / F.sqrt(sizes[1] * rate)
    bad = words.where("toxic > 1").withColumn("excess", excess).orderBy(F.desc("excess"), "word").limit(TOXIC_LANDMARKS).collect()
    plain_words = words.orderBy(F.col("clean").desc(), "word").limit(PLAIN_LANDMARKS).select("word").collect()
    chosen = list(dict.fromkeys(r["word"] for r in [*bad, *plain_words]))
    if not chosen:
        return sizes[1] / (sizes[0] + sizes[1])
    landmarks = Landmarks(chosen)

    values, vectors = np.linalg.eigh(landmarks.kernel(chosen).astype(np.float64))
    good = values > 1e-4 * values.max()
    nystroem = vectors[:, good] / np.sqrt(values[good])
    looks = np.zeros(len(chosen), np.float32)
    looks[:len(bad)] = [max(0.0, r["excess"]) for r in bad]  # the first choice of sentences goes by these landmarks
    looks /= max(looks.max(), 1e-9)
    machine = Machine(landmarks, looks, 0.0)
    for _ in range(2):  # the second time sentences are chosen by the first machine
        rows = sample.mapInArrow(lambda it, m=machine: _kernel_rows(it, m), "label int, k array<double>").toArrow()
        labels_found = rows.column("label").to_numpy()
        k, y = lists_of(rows, "k"), np.where(labels_found == 1, 1.0, -1.0)
        if len(set(labels_found.tolist())) < 2:
            return sizes[1] / (sizes[0] + sizes[1])
        # the words of clean texts add nothing on average, nor do words like no landmark, so that sentences of any length compare
        average = k[y < 0].sum(0)
        average /= max(average.sum(), 1e-9)
        share = (y > 0).mean()
        cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y) * 2000
        w = support_vectors((k - k.sum(1, keepdims=True) * average) @ nystroem, y, cost)
        weights = nystroem @ w[:-1]
        machine = Machine(landmarks, (weights - average @ weights).astype(np.float32), float(w[-1]))

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon()
        for batch in batches:
            found = [m for part in parts(batch, "text", BATCH_BYTES) for m in machine.margins(texts_of(part), known).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], names=["label", "margins"])
        del known
        release()

    rows = sample.mapInArrow(margins, "label int, margins array<double>").toArrow()
    machine.slopes, machine.offset = logistic(
        lists_of(rows, "margins"), rows.column("label").to_numpy().astype(float))
    return machine


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = SAMPLE, training: DataFrame | None = None,
) -> DataFrame:
    """Per row: doc_id, th (hash of the text), held_out, score, predicted; learns on ``training`` or else ``docs``."""
    prepare(docs.sparkSession)
    model = fit(docs if training is None else training, labels, most)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon()
        for batch in batches:
            values: list[float] = []
            for part in parts(batch, "text", BATCH_BYTES):
                if isinstance(model, float):
                    values += [model] * part.num_rows
                else:
                    values += model.probabilities(texts_of(part), known).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(values, pa.float64())], names=["doc_id", "th", "score"])
        del known
        release()

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    out = base.mapInArrow(score, "doc_id long, th long, score double")
    return out.select(
        "doc_id", "th", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
