"""Toxicity of text after noisy-channel deobfuscation.

A noisy stretch of a text (a token with a letter and a look-alike character or with a repeated letter, or single
characters spelled out with separators) becomes a character lattice: an observed character stands for itself, for a letter it looks like, for nothing (a
repetition or a separator) or for a word border. Viterbi decoding under a character trigram model, with the learnt
toxic words held as tracked prefixes, gives the restored stretch. A stretch without such characters has one path, its
own, so it is passed on as it is. The restored text is scored by the toxic words and word beginnings it holds.

Everything is learnt from all labelled rows outside the held-out fold: the character model from their words, the
lexicon from the words and beginnings that mark label 1, the final score by logistic regression on lexicon features.
Counts and the sums of the regression's steps are made by tasks; character trigrams and the lexicon reach the driver.
Every document is scored, over its whole text.

Null is the empty text, which has a score like any other. Without labels of both classes the score is the smoothed
share of label 1. Rows are independent; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, bounded_batches, drop_table, release, text_of, through_table, trim
from ._labels import held_out, labelled

FOLDS, HELD, THRESHOLD = 3, 1, 0.7
#: Words and marks that a task counts before it passes the counts on.
COUNTED = 200_000
#: Weights of trigrams are whole numbers of this part, so that their sums don't depend on the order of words.
_PART = 2.0**-32
#: The letters that each look-alike may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_*"
BORDER = "^"
_LETTER = re.compile(r"[^\W\d_]")
_LIKE, _BETWEEN = (f"[{re.escape(x)}]" for x in ("".join(LOOKALIKES), SEPARATORS))
#: Single characters set apart by separators, three or more.
_SPELLED = re.compile(rf"(?<!\w)(?:[^\W_]|{_LIKE})(?:{_BETWEEN}(?:[^\W_]|{_LIKE})(?![^\W_])){{2,}}")
#: A token with a look-alike or a doubled letter anywhere, found in one pass from the token's start.
_NOISY = re.compile(rf"(?<!\S)\S*?(?:{_LIKE}|([^\W\d_])\1)\S*")
_EDGE = "!?.,;:\"')("
#: Bytes that end a word when restored text is scored.
_TO_SPACE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_KEEP, _DROP, _SPLIT = math.log(0.7), math.log(0.3), math.log(0.05)


def trigrams(words: Iterable[tuple[str, int]]) -> Counter:
    """Weight of each character trigram, in _PARTs, over words and the number of documents that have them."""
    found = Counter()
    for word, n in words:
        seq = BORDER * 2 + word + BORDER
        weight = round(math.log1p(n) / _PART)
        for k in range(2, len(seq)):
            found[seq[k - 2 : k + 1]] += weight
    return found


class CharacterModel:
    """Interpolated character trigrams over words, words set off by borders."""

    def __init__(self, words: Counter, weights: dict[str, int] | None = None):
        """Of the words, or of trigrams that were weighted before."""
        tri, bi, uni = trigrams(words.items()) if weights is None else weights, Counter(), Counter()
        left, two = Counter(), Counter()
        for g, n in tri.items():
            bi[g[1:]] += n
            uni[g[2]] += n
            two[g[:2]] += n
        for g, n in bi.items():
            left[g[0]] += n
        self.tri, self.bi, self.uni, self.two, self.left = ({g: n * _PART for g, n in x.items()} for x in (tri, bi, uni, two, left))
        self.total = sum(uni.values()) * _PART
        self._known: dict[str, float] = {}

    def log(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        got = self._known.get(key)
        if got is None:
            p = (self.uni.get(c, 0) + 0.5) / (self.total + 0.5 * (len(self.uni) + 1))
            if n := self.left.get(b):
                p = 0.3 * p + 0.7 * self.bi.get(b + c, 0) / n
            if n := self.two.get(a + b):
                p = 0.3 * p + 0.7 * self.tri.get(key, 0) / n
            got = math.log(max(p, 1e-12))
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[key] = got
        return got


class Restorer:
    """Viterbi decoding of noisy stretches."""

    def __init__(self, model: CharacterModel, lexicon: set[str], bonus: float = 8.0):
        self.model, self.lexicon, self.bonus = model, lexicon, bonus
        self.prefixes = {w[:k] for w in lexicon for k in range(len(w) + 1)}
        self._known: dict[str, str] = {}
        self._tokens: dict[str, str] = {}

    def _options(self, text: str, k: int) -> list[tuple[str | None, float]]:
        c = text[k]
        if c in SEPARATORS:
            return [(None, _DROP), (BORDER, _KEEP)]
        out = []
        if c in LOOKALIKES:
            letters = LOOKALIKES[c]
            out = [(x, _KEEP - math.log(len(letters))) for x in letters] + [(BORDER, _SPLIT)]
        elif c.isalpha():
            out = [(c, 0.0)]
        else:
            out = [(BORDER, 0.0)]
        if k and text[k - 1] == c:
            out = [(x, s + _KEEP) for x, s in out] + [(None, _DROP)]
        return out

    def decode(self, text: str) -> str:
        """The likeliest restored form of one lower-case stretch; the cells of a column are kept by their context."""
        got = self._known.get(text)
        if got is not None:
            return got
        log, bonus = self.model.log, self.bonus
        # state: last two letters, tracked lexicon prefix of the current word (None if it is none) -> score, back link
        column = {(BORDER, BORDER, ""): (0.0, None)}
        for k in range(len(text)):
            options, after = self._options(text, k), {}
            for (a, b, track), (score, back) in column.items():
                for c, cost in options:
                    if c is None:
                        state, total, link = (a, b, track), score + cost, back
                    elif c == BORDER:
                        if b == BORDER:
                            state, total, link = (BORDER, BORDER, ""), score + cost, back
                        else:
                            total = score + cost + log(a, b, BORDER) + (bonus if track in self.lexicon else 0.0)
                            state, link = (BORDER, BORDER, ""), (" ", back)
                    else:
                        follow = track + c if track is not None and track + c in self.prefixes else None
                        state, total, link = (b, c, follow), score + cost + log(a, b, c), (c, back)
                    if state not in after or after[state][0] < total:
                        after[state] = (total, link)
            column = after
        best, link = -math.inf, None
        for (a, b, track), (score, back) in column.items():
            total = score + (0.0 if b == BORDER else log(a, b, BORDER) + (bonus if track in self.lexicon else 0.0))
            if total > best:
                best, link = total, back
        letters = []
        while link is not None:
            letters.append(link[0])
            link = link[1]
        out = "".join(letters[::-1]).strip()
        if len(text) <= 64:
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[text] = out
        return out

    def _token(self, match: re.Match) -> str:
        token = match[0]
        out = self._tokens.get(token)
        if out is None:
            out = self._restored(token)
            if len(token) <= 64:
                if len(self._tokens) > 200_000:
                    self._tokens.clear()
                self._tokens[token] = out
        return out

    def _restored(self, token: str) -> str:
        core = token.strip(_EDGE)
        if not _LETTER.search(core):
            return token
        out = self.decode(core)
        if out not in self.lexicon:
            # a look-alike at the edge is punctuation, unless it makes the token a word of the lexicon
            first = token.index(core)
            past = first + len(core)
            wide = token[first - (first > 0 and token[first - 1] in LOOKALIKES) : past + (past < len(token) and token[past] in LOOKALIKES)]
            if len(wide) > len(core) and (whole := self.decode(wide)) in self.lexicon:
                core, out = wide, whole
        return token.replace(core, out, 1)

    def restore(self, text: str) -> str:
        """The whole text, lower-case, with its noisy stretches restored."""
        low = _SPELLED.sub(lambda m: self.decode(m[0]), text.lower())
        return _NOISY.sub(self._token, low)


def word_set(restored: str) -> tuple[set[bytes], int]:
    """The distinct words of restored text, in UTF-8, and the number of words."""
    words = restored.encode().translate(_TO_SPACE).split()
    return set(words), len(words)


def _marks(words: set[bytes]) -> set[bytes]:
    """Words, and word beginnings of four to seven bytes marked with a star."""
    return words | {w[:k] + b"*" for w in words for k in (4, 5, 6, 7) if len(w) > k}


class Counts:
    """Documents that have a word, by word, and documents that have a mark, by their label and the mark."""

    def __init__(self):
        self.words, self.marks = Counter(), (Counter(), Counter())

    def add(self, text: str, label: int) -> None:
        low = text.lower()
        self.words.update(set(re.findall(r"[^\W\d_]+", low)))
        self.marks[bool(label)].update(_marks(word_set(low)[0]))

    def __len__(self) -> int:
        return len(self.words) + len(self.marks[0]) + len(self.marks[1])


def mark_weight(n: int, k: int, pos: int, neg: int) -> float | None:
    """Weight of a mark of n of the pos documents of label 1 and k of the neg others, if it is far more frequent there
    and a likelihood ratio test leaves no doubt."""
    if n < 3:
        return None
    weight = math.log((n + 0.1) / (pos + 1)) - math.log((k + 0.1) / (neg + 1))
    if weight <= 2:
        return None
    share = (n + k) / (pos + neg)
    test = 2 * (n * math.log(n / (share * pos)) + (k * math.log(k / (share * neg)) if k else 0.0))
    return weight if test > 16 else None


def step_sums(x: np.ndarray, y: np.ndarray, rows: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the log likelihood, flat, over rows of features that occur so many times with y of label 1."""
    p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
    return np.concatenate([x.T @ (y - rows * p), ((x * (rows * p * (1 - p))[:, None]).T @ x).ravel()])


def logistic(sums: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Newton steps with a small ridge, hardly any on the intercept, from the sums at given coefficients."""
    coef, ridge = np.zeros(width), np.diag([1e-6, *[0.3] * (width - 1)])
    for _ in range(30):
        flat = sums(coef)
        step = np.linalg.solve(flat[width:].reshape(width, width) + ridge, flat[:width] - ridge @ coef)
        coef = coef + step
        if np.abs(step).max() < 1e-8:
            break
    return np.round(coef, 10)  # beyond what the order of sums can change


class ToxicityModel:
    """Restorer, lexicon of weighted marks, and the logistic layer."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        """Learnt from texts at hand; fit_toxicity() learns the same from tables of any size."""
        y = np.asarray(labels, np.float64)
        counts, pos = Counts(), int(y.sum())
        for text, label in zip(texts, y, strict=True):
            counts.add(text, label)
        other, toxic = counts.marks
        self.learn(CharacterModel(counts.words), {m: w for m, n in toxic.items() if (w := mark_weight(n, other[m], pos, len(y) - pos))}, pos, len(y) - pos)
        if 0 < pos < len(y):
            x = np.array([self.features(t) for t in texts])
            self.coef = logistic(lambda coef: step_sums(x, y, np.ones(len(y)), coef), x.shape[1])

    def learn(self, chars: CharacterModel, weights: dict[bytes, float], pos: int, neg: int) -> None:
        """What is known before the logistic layer; without it, the score is the smoothed share of label 1."""
        self.weights = dict(sorted(weights.items()))
        self.heads = {m.rstrip(b"*")[:4] for m in weights}  # no other word has a weight
        self.restorer = Restorer(chars, {m.decode() for m in weights if not m.endswith(b"*")})
        self.coef = np.zeros(5)
        self.coef[0] = math.log((pos + 1) / (neg + 1))

    def features(self, text: str) -> list[float]:
        words, n = word_set(self.restorer.restore(text))
        weights, heads, found = self.weights, self.heads, []
        for w in words:
            if w[:4] not in heads:
                continue
            best = weights.get(w, 0.0)
            if len(w) > 4:
                best = max(best, weights.get(w[:4] + b"*", 0.0), weights.get(w[:5] + b"*", 0.0), weights.get(w[:6] + b"*", 0.0), weights.get(w[:7] + b"*", 0.0))
            if best:
                found.append(best)
        return [1.0, max(found, default=0.0) / 8, min(len(found), 8) / 8, float(bool(found)), math.log1p(n) / 10]

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, len(self.coef))
        return 1 / (1 + np.exp(-np.clip(x @ self.coef, -30, 30)))


def counted(own: DataFrame) -> DataFrame:
    """Of the words (kind 0) and marks (kind 1) of labelled texts, the documents of label 1 and the others that have
    them; marks of fewer than three of label 1 are left out, as mark_weight() leaves them."""
    columns = ("kind", "key", "toxic", "other")

    def batches_of(counts: Counts) -> Iterator[pa.RecordBatch]:
        other, toxic = counts.marks
        rows = [(0, w.encode(), 0, n) for w, n in counts.words.items()] + [(1, m, toxic[m], other[m]) for m in {*toxic, *other}]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 50_000], strict=True), (pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=columns)

    def run(batches):
        release()
        counts = Counts()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.add(text, label)
                if len(counts) > COUNTED:
                    yield from batches_of(counts)
                    counts = Counts()
        yield from batches_of(counts)
        batch = counts = None
        trim()

    each = own.select("text", "label").mapInArrow(run, "kind int, key binary, toxic long, other long")
    return each.groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where("kind = 0 or toxic >= 3")


def trigram_weights(counts: DataFrame) -> dict[str, int]:
    """trigrams() of all counted words."""

    def run(batch):
        found = trigrams(zip((w.decode() for w in batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "weight"])

    each = arrow_map(counts.where("kind = 0").select("key", "other"), run, "gram string, weight long")
    return {r.gram: r.weight for r in each.groupBy("gram").agg(F.sum("weight").alias("weight")).collect()}


def lexicon(counts: DataFrame, pos: int, neg: int) -> dict[bytes, float]:
    """The marks that have a weight; only these are gathered."""

    def run(batch):
        keys, toxic, other = (batch.column(k).to_pylist() for k in range(3))
        found = [(m, w) for m, n, k in zip(keys, toxic, other, strict=True) if (w := mark_weight(n, k, pos, neg))]
        return pa.RecordBatch.from_arrays([pa.array([m for m, _ in found], pa.binary()), pa.array([w for _, w in found], pa.float64())], names=["mark", "weight"])

    return {bytes(r.mark): r.weight for r in arrow_map(counts.where("kind = 1").select("key", "toxic", "other"), run, "mark binary, weight double").collect()}


def logistic_layer(own: DataFrame, model: ToxicityModel) -> np.ndarray:
    """Coefficients over the features of all labelled texts; equal features are one row of the table that each step reads."""
    width = len(model.coef)
    names = [f"x{k}" for k in range(width)]

    def features(batch):
        x = np.array([model.features(t) for t in batch.column(0).to_pylist()])
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1)], names=[*names, "label"])

    each = arrow_map(own.select("text", "label"), features, ", ".join(f"{x} double" for x in names) + ", label int")
    cells = through_table(each.groupBy(*names).agg(F.sum("label").cast("double").alias("y"), F.count(F.lit(1)).cast("double").alias("n")), "toxicity-cells")
    totals = [f"s{k}" for k in range(width + width * width)]

    def sums(coef: np.ndarray) -> np.ndarray:
        def run(batch):
            x, y, n = np.column_stack([batch.column(k).to_numpy() for k in range(width)]), batch.column(width).to_numpy(), batch.column(width + 1).to_numpy()
            return pa.RecordBatch.from_arrays([pa.array([s]) for s in step_sums(x, y, n, coef)], names=totals)

        return np.array(arrow_map(cells, run, ", ".join(f"{s} double" for s in totals)).agg(*(F.sum(s) for s in totals)).first())

    coef = logistic(sums, width)
    drop_table(cells)
    return coef


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from every labelled document outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    own = through_table(labelled(docs, labels, "toxic", FOLDS, HELD), "labelled")
    counts = through_table(counted(own), "toxicity-counts")
    rows, pos = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    model = ToxicityModel([], np.zeros(0))
    model.learn(CharacterModel(Counter(), trigram_weights(counts)), lexicon(counts, pos, rows - pos), pos, rows - pos)
    if 0 < pos < rows:
        model.coef = logistic_layer(own, model)
    drop_table(counts)
    drop_table(own)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every document."""
    bounded_batches(docs.sparkSession)

    def run(batch):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, "doc_id long, score double")


def toxicity_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out("doc_id", FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
