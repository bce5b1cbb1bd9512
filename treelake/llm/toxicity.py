"""Toxicity scores from a support vector machine over a gap-weighted subsequence string kernel.

A text is cut into sentences and those into units: words reduced to their letters (common digit-for-letter swaps undone,
separators inside a word dropped, runs of single letters joined), and the pieces of a word between its separators. Long
units also count by short windows. The kernel compares two units by the three-letter
subsequences they share, each weighing DECAY to the letters it spans (at most SPAN), so inserted letters and gaps lower
the likeness a little instead of ending it. Nyström landmarks are units of the training texts: those most tied to toxic
documents, and those of clean documents that are likest to them; a linear SVM is trained on the features they span.
Training is on sentences of labelled documents: the highest sentences of clean ones are negative, the highest sentence of
a toxic one is positive, as are toxic landmarks with letters put in. A sentence stands for its highest unit, a document
for its highest sentence, and a logistic curve over document maxima turns values into probabilities.

A bound on the likeness spares most units the comparison.

The classifier is fitted on at most SAMPLE_DOCS labelled documents (the first by hash), a bound that is a parameter; all
documents are scored whole. Null and empty texts have no units and get the score of a clean document, as has every
document when there is nothing to learn from. Repeated rows get equal scores. Extra columns are not used.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, text_or_empty

SAMPLE_DOCS = 12_000
DECAY = 0.6
SPAN = 6
#: The kernel's power, and the likeness under which it counts as 0: two letters put into a word of five leave 0.43 or more.
POWER, LEAST = 2, 0.42
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 64, 64
#: Letters of a window, its two end marks included; a longer unit counts as its highest window.
WINDOW, STRIDE = 26, 12
#: Units of more letters than LONG, end marks included, also count by windows of SHORT letters, STEP apart, so that a word
#: of five or six letters inside lies in one whole.
LONG, SHORT, STEP = 11, 8, 3
CODES = 64
HARD_SENTENCES = 6
THRESHOLD = 0.3
MEMO = 400_000
#: Likelihood ratio from which a unit counts as tied to toxic documents; units of at least this share of the highest ratio
#: also teach the gaps.
TIED, SHARE = 20.0, 0.2
#: Units as like as this to a landmark add little to it, so they are none.
ALIKE = 0.75

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPELLED = re.compile(r"(?<![^\x20\x09-\x0D])(?:[^\W\d_][\x20\-._*]){2,}[^\W\d_](?![^\x20\x09-\x0D])")
#: Parts of a word between separators, and its runs of letters.
PIECE, RUN = re.compile(r"[^\W_@]+(?:@+[^\W_@]+)*"), re.compile(r"[^\W\d_]+")
#: What is no part of a word at its ends.
EDGE = "#*$%&|<>!?.,;:-_()[]{}\"'"
SWAPS = str.maketrans("013457@", "oieasta")


def letters(word: str) -> str:
    """The letters of a word, lower case; digits inside it that stand for letters are undone."""
    low = word.lower()
    if low.isalpha():
        return low
    low = low.strip(EDGE)
    if any(c.isalpha() for c in low):
        low = low.translate(SWAPS)
    return "".join(filter(str.isalpha, low))


def forms(word: str) -> set[str]:
    """The letters of a word as a whole, of its pieces between separators, and its runs of letters."""
    core = word.strip(EDGE)
    if core.isalpha():
        return {core.lower()}
    return {letters(word), *map(letters, PIECE.findall(word)), *(r.lower() for r in RUN.findall(word))}


def units(sentence: str) -> list[str]:
    """The words of a sentence, and runs of single letters joined."""
    found = WORD.findall(sentence)
    joined = [re.sub(r"[^\w]|_", "", m) for m in SPELLED.findall(sentence)]
    return found + joined


def codes(words: list[str], short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Windows of letter codes (0 pads) of reduced words between end marks, and the word that each window is of."""
    rows, owner = [], []
    for k, word in enumerate(words):
        marked = f"\x01{word}\x02"
        for start in range(0, max(1, len(marked) - STRIDE), STRIDE) if len(marked) > WINDOW else (0,):
            rows.append(marked[start : start + WINDOW])
            owner.append(k)
        if short and len(marked) > LONG:
            for start in range(0, len(marked) - SHORT + STEP, STEP):
                at = min(start, len(marked) - SHORT)
                rows.append(marked[at : at + SHORT])
                owner.append(k)
    out = np.zeros((len(rows), WINDOW), np.int32)
    if rows:
        flat = np.frombuffer("".join(rows).encode("utf-32-le"), "<u4").astype(np.int64)
        length = np.array([len(r) for r in rows])
        latin = flat - 96
        code = np.where((latin >= 1) & (latin <= 26), latin, 27 + flat % (CODES - 29))
        out[np.arange(WINDOW) < length[:, None]] = np.where(flat <= 2, CODES - 3 + flat, code)
    return out, np.array(owner, np.int64)


GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


def triples(windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of gaps: codes of the three-letter subsequences at each place, where they are, and their weight."""
    width = windows.shape[1]
    for a, b in GAPS:
        if a + b < width:
            left, mid, right = windows[:, : width - a - b], windows[:, a : width - b], windows[:, a + b :]
            yield (left * CODES + mid) * CODES + right, right > 0, DECAY ** (a + b + 1)


class Landmarks:
    """The kernel between words and the landmarks. Norms depend on length alone, which keeps the kernel positive; the
    power of a kernel is a kernel."""

    def __init__(self, words: list[str], n_toxic: int | None = None):
        windows = codes([w[: WINDOW - 2] for w in words], short=False)[0]
        parts = [(code[there], np.nonzero(there)[0], weight) for code, there, weight in triples(windows)]
        known = np.unique(np.concatenate([p[0] for p in parts]))
        self.n_toxic = len(words) if n_toxic is None else n_toxic
        # Codes with padding are in no landmark, so they weigh nothing below.
        self.at = np.full(CODES**3, len(known), np.int32)
        self.at[known] = np.arange(len(known))
        self.right = np.zeros((len(known) + 1, len(words)), np.float32)
        size = self.norms(windows)
        for code, row, weight in parts:
            np.add.at(self.right, (self.at[code], row), weight / size[row])
        self.toxic_right, self.other_right = (np.ascontiguousarray(x) for x in np.split(self.right, [self.n_toxic], axis=1))
        self.most = np.zeros(CODES**3, np.float32)
        self.most[known] = self.right[:-1, : self.n_toxic].max(1)

    @staticmethod
    def norms(windows: np.ndarray) -> np.ndarray:
        length = (windows > 0).sum(1)
        total = np.zeros(len(windows))
        for a, b in GAPS:
            total += DECAY ** (2 * (a + b + 1)) * np.maximum(length - a - b, 0)
        return np.sqrt(np.maximum(total, 1e-9)).astype(np.float32)

    def kernel(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (word numbers, kernel rows) of the windows that are like some toxic landmark; the others count as
        bare. Likeness is at most the sum over subsequences with the highest weight that a landmark gives each."""
        for start in range(0, len(words), 8192):
            every, owners = codes(words[start : start + 8192])
            widths = (every > 0).sum(1)
            by_length = np.argsort(widths, kind="stable")
            for k in range(0, len(every), 8192):
                part = by_length[k : k + 8192]
                yield from self.block(every[part, : max(3, int(widths[part].max(initial=3)))], owners[part] + start)

    def block(self, windows: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bound, size = np.zeros(len(windows), np.float32), self.norms(windows)
        for code, _, weight in triples(windows):
            bound += np.float32(weight) * self.most[code].sum(1)
        near = np.flatnonzero(bound >= LEAST * size)
        for first in range(0, len(near), 512):
            rows = near[first : first + 512]
            like = self.likeness(windows[rows], self.toxic_right) / size[rows][:, None]
            some = np.flatnonzero(like.max(1) >= LEAST)
            if len(some):
                rest = self.likeness(windows[rows[some]], self.other_right) / size[rows[some]][:, None]
                like = np.hstack([like[some], rest])
                yield owner[rows[some]], np.where(like >= LEAST, like, 0) ** POWER

    def likeness(self, windows: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sums of the weights of each window's subsequences, of those that some landmark has."""
        out = np.zeros((len(windows), right.shape[1]), np.float32)
        for code, _, weight in triples(windows):
            at = self.at[code]
            for k in range(at.shape[1]):
                out += np.float32(weight) * right[at[:, k]]
        return out

    def rows(self, words: list[str]) -> np.ndarray:
        """The kernel row of each word: that of the window which is likest to any landmark."""
        out = np.zeros((len(words), self.right.shape[1]), np.float32)
        for numbers, block in self.kernel(words):
            for k, row in zip(numbers.tolist(), block, strict=True):
                if row.max() > out[k].max():
                    out[k] = row
        return out


class Scorer:
    """Decision values of words, remembered."""

    def __init__(self, landmarks: list[str], n_toxic: int, beta: np.ndarray, bias: float):
        self.landmarks, self.beta, self.bias, self.memo = Landmarks(landmarks, n_toxic) if landmarks else None, beta, bias, {}

    def evaluate(self, words: list[str]) -> list[float]:
        out = np.full(len(words), self.bias)
        if self.landmarks:
            for numbers, block in self.landmarks.kernel(words):
                np.maximum.at(out, numbers, block @ self.beta + self.bias)
        return out.tolist()

    def values(self, texts: list[list[str]]) -> list[list[float]]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        fresh = {w: forms(w) for words in texts for w in words if w not in memo}
        reduced = list(set().union(*fresh.values()))
        value = dict(zip(reduced, self.evaluate(reduced), strict=True))
        memo.update((w, max(map(value.__getitem__, x))) for w, x in fresh.items())
        return [list(map(memo.__getitem__, words)) for words in texts]


def tied(positive: float, negative: float, n_positive: float, n_negative: float) -> float:
    """Signed likelihood ratio of a unit's counts in toxic and clean documents."""
    both, share = positive + negative, n_positive / (n_positive + n_negative)
    part = lambda seen, due: seen * np.log(seen / due) if seen else 0.0
    ratio = 2 * (part(positive, both * share) + part(negative, both * (1 - share)))
    return ratio if positive > both * share else -ratio


def unlike(words: list[str]) -> list[str]:
    """The words, in their order, without those that are ALIKE to one kept before them."""
    if not words:
        return []
    rows, kept = Landmarks(words).rows(words) ** (1 / POWER), []
    for k in range(len(words)):
        if not kept or rows[k, kept].max() < ALIKE:
            kept.append(k)
    return [words[k] for k in kept]


def training_sample(docs: DataFrame, labels: DataFrame, held_out, bound: int = SAMPLE_DOCS) -> DataFrame:
    """toxic, text of at most bound labelled documents that are not held out, the first by hash."""
    known = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = known.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def distorted(word: str) -> list[str]:
    """A word with a letter put in at, or doubled in, each inner place, and from five letters on with letters put in at each two
    inner places."""
    if len(word) < 4:
        return []
    once = [word[:k] + extra + word[k:] for k in range(1, len(word)) for extra in ("x", word[k - 1])]
    return once if len(word) < 5 else once + [word[:j] + "x" + word[j:k] + "x" + word[k:] for k in range(2, len(word)) for j in range(1, k)]


def train(sample: DataFrame) -> tuple:
    """Landmarks, how many of them are toxic (they come first), their weights, bias, and slope and offset of the logistic curve. All that comes back is bounded by the
    sample."""
    empty = [], 0, np.zeros(0), 0.0, 1.0, -4.0
    columns = ["toxic", "text"]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flags, texts in row_chunks(batch, columns):
                seen: dict[str, list[int]] = {"": [0, 0]}
                for flag, text in zip(flags, texts, strict=True):
                    for word in {"", *(x[: WINDOW - 2] for w in set(units(text)) for x in forms(w))}:
                        seen.setdefault(word, [0, 0])[flag] += 1
                names = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[w][1] for w in names], pa.int64()), pa.array([seen[w][0] for w in names], pa.int64())], ["unit", "pos", "neg"])

    counts = sample.mapInArrow(count, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.filter("unit = '' or (length(unit) >= 3 and (pos >= 3 or neg >= 3))").collect()
    n_pos, n_neg = next(((r.pos, r.neg) for r in counts if r.unit == ""), (0, 0))
    if not n_pos or not n_neg:
        return empty
    ranked = sorted((-tied(r.pos, r.neg, n_pos, n_neg), r.unit) for r in counts if r.unit)
    tied_units = [(-value, u) for value, u in ranked[: 8 * TOXIC_LANDMARKS] if -value >= TIED] or [(-value, u) for value, u in ranked[:8]]
    if not tied_units:
        return empty
    toxic = unlike([u for _, u in tied_units])[:TOXIC_LANDMARKS]
    strong = {u for value, u in tied_units if value >= SHARE * tied_units[0][0]}
    # Clean landmarks: the units of clean documents that are likest to toxic ones.
    plain = [(u, r) for r in counts if (u := r.unit) and r.neg >= 3 and r.neg * n_pos > r.pos * n_neg]
    near = Landmarks(toxic).rows([u for u, _ in plain]).max(1) if plain else []
    clean = [u for _, u in sorted((-float(v), u) for v, (u, _) in zip(near, plain, strict=True) if v > 0)[:CLEAN_LANDMARKS]]
    landmarks = toxic + clean

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = Scorer(landmarks, len(toxic), np.array([1.0] * len(toxic) + [-1.0] * len(clean)) / 4, 0.0)
        for batch in batches:
            for flags, texts in row_chunks(batch, columns, 1 << 20):
                out = []
                for flag, text in zip(flags, texts, strict=True):
                    # Each sentence by its highest unit, and of a document the highest sentences.
                    cut = [units(s) for s in SENTENCE.findall(text)]
                    tops = [max(zip(v, w, strict=True)) for v, w in zip(first.values(cut), cut, strict=True) if w]
                    # A word stands for its highest form.
                    made = [sorted(forms(w)) for _, w in tops]
                    highest = [x[0] if len(x) == 1 else max(zip(v, x, strict=True))[1] for v, x in zip(first.values([x if len(x) > 1 else [] for x in made]), made, strict=True)]
                    tops = sorted({(v, x) for (v, _), x in zip(tops, highest, strict=True)}, key=lambda x: (-x[0], x[1]))
                    out += [(flag, k == 0, unit) for k, (_, unit) in enumerate(tops[: 1 if flag else HARD_SENTENCES])]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.string())], ["toxic", "top", "unit"])

    picked = sample.mapInArrow(pick, "toxic int, top boolean, unit string").groupBy("toxic", "top", "unit").count().collect()
    picked = sorted(((r.toxic, r.top, r.unit, float(r["count"])) for r in picked), key=str)
    kernel = Landmarks(landmarks, len(toxic))
    rows = kernel.rows([p[2] for p in picked]).astype(float)
    # A toxic sentence that is like no landmark teaches nothing; distorted landmarks teach the gaps.
    use = np.array([p[0] == 0 or row[: len(toxic)].any() for p, row in zip(picked, rows, strict=True)])
    spelled = [d for u in toxic[:48] if u in strong for d in distorted(u)]
    if not use[[p[0] == 1 for p in picked]].any() or all(p[0] for p in picked):
        return empty
    sign = np.array([1.0 if p[0] else -1.0 for p in picked])
    count_ = np.array([p[3] for p in picked])
    pos, neg = use & (sign > 0), sign < 0
    values, vectors = np.linalg.eigh(kernel.rows(landmarks).astype(float) + kernel.rows(landmarks).astype(float).T)
    kept = values > 1e-4 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept] / 2)
    extra = kernel.rows(spelled).astype(float) if spelled else np.zeros((0, len(landmarks)))
    x = np.vstack([rows[pos], rows[neg], extra]) @ whiten
    labels = np.concatenate([np.ones(pos.sum()), -np.ones(neg.sum()), np.ones(len(extra))])
    weight = np.concatenate([count_[pos] / count_[pos].sum(), count_[neg] / count_[neg].sum(), np.full(len(extra), 0.7 / max(1, len(extra)))])
    w, b = svm(x, labels, weight)
    beta = whiten @ w
    top = np.array([p[1] for p in picked])
    slope, offset = logistic((rows @ beta + b)[top], sign[top] > 0, count_[top])
    return landmarks, len(toxic), beta, float(b), slope, offset


def svm(x: np.ndarray, sign: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by accelerated gradient steps; both classes weigh the same."""
    z = np.hstack([x, np.ones((len(x), 1))])
    scale = 2 * (weight[:, None] * z * z).sum() + ridge
    w = v = np.zeros(z.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - sign * (z @ v))
        step = v - (-2 * z.T @ (weight * sign * slack) + ridge * np.append(v[:-1], 0)) / scale
        v = step + k / (k + 3) * (step - w)
        w = step
    return w[:-1], float(w[-1])


def logistic(value: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton steps, with targets drawn in a little as in Platt's method."""
    n_pos, n_neg = weight[positive].sum(), weight[~positive].sum()
    if not n_pos or not n_neg:
        return 1.0, -1.0
    goal = np.where(positive, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * value + b, -30, 30)))
        g, h = weight * (p - goal), np.maximum(weight * p * (1 - p), 1e-9)
        gradient = np.array([(g * value).sum() + 1e-3 * a, g.sum()])
        hessian = np.array([[(h * value * value).sum() + 1e-3, (h * value).sum()], [(h * value).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1, 2 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def score_documents(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, score of every row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = ["doc_id", "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks, n_toxic, beta, bias, slope, offset = held.value
        scorer = Scorer(landmarks, n_toxic, beta, bias)
        for batch in batches:
            for ids, texts in row_chunks(batch, columns, 4 << 20):
                # The highest sentence's highest unit is the document's highest unit.
                values = scorer.values([units(t) for t in texts])
                top = np.array([max(v, default=bias) for v in values])
                score = np.round(1 / (1 + np.exp(-np.clip(slope * top + offset, -30, 30))), 9)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = train(training_sample(docs, labels, held_out))
    out = score_documents(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
