"""Language identification by unigram piece models that sum over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. The
probability of a word is the sum, over all ways to cut it into pieces, of the product of
its pieces' probabilities; the forward algorithm computes it, and expectation
maximisation fits the probabilities on word counts. A document's score is the product
over all its words.

Fitting reads whole texts of at most about ``per_language`` labelled rows a language (a
documented bound of the sample) and every word of these; scoring covers every word of every
text. Words and pieces of any length count.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, DoubleType

from .common import resident, share, small_batches

UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Letters between two rescalings of the sums over a word, so that long words don't underflow;
#: and letters up to which words are fitted without logarithms.
_RESCALE, _PLAIN = 16, 32
_SLICE = 512


def letter_words(text: str) -> list[str]:
    """Lower-case runs of letters (what ``str.isalpha`` takes for one: numerals such as a half are none)."""
    words = _LETTERS.findall(text.lower())
    if not all(map(str.isalpha, words)):
        words = [w for run in words for w in "".join(c if c.isalpha() else " " for c in run).split()]
    return words


class Trie:
    """A trie over letter classes. A piece's first letter is looked up in ``first``; further ones in a
    table with a row for each node that has children and a column for each class under ``wide``, the
    classes that follow others in some piece."""

    def __init__(self, words: list[tuple[int, ...]], classes: int):
        children: list[dict[int, int]] = [{}]
        self.ends: list[int] = []
        for word in words:
            node = 0
            for c in word:
                below = children[node].get(c)
                if below is None:
                    below = children[node][c] = len(children)
                    children.append({})
                node = below
            self.ends.append(node)
        self.nodes = len(children)
        self.first = np.zeros(classes, np.int32)
        for c, below in children[0].items():
            self.first[c] = below
        self.wide = 1 + max((c for row in children[1:] for c in row), default=0)
        inner = [n for n in range(1, self.nodes) if children[n]]
        self.row = np.zeros(self.nodes, np.int32)  # row 0 leads nowhere
        self.table = np.zeros((len(inner) + 1, self.wide + 1), np.int32)
        for r, n in enumerate(inner, start=1):
            self.row[n] = r
            for c, below in children[n].items():
                self.table[r, c] = below

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Each node's child for a letter class; 0 where there is none."""
        return self.table[self.row.take(node), np.minimum(letter, self.wide)]


@dataclass
class PieceModel:
    """``prob[node, language]`` is 0 where no piece ends at the trie's node."""

    languages: list[str]
    alphabet: dict[str, int]
    trie: Trie
    prob: np.ndarray
    longest: int

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter classes in rows, 0 past the end; each word begins with the word mark."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        rows = np.zeros((len(words), int(lengths.max(initial=1))), np.int64)
        get, other = self.alphabet.get, len(self.alphabet) + 1
        flat = np.fromiter((get(c, other) for w in words for c in "▁" + w), np.int64, int(lengths.sum()))
        rows[np.arange(rows.shape[1]) < lengths[:, None]] = flat
        return rows, lengths

    def walks(self, rows: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, rows, nodes) of the beginnings of pieces found from a place on."""
        live = np.arange(len(rows))
        for j in range(start, min(rows.shape[1], start + self.longest)):
            node = self.trie.step(node, rows[live, j]) if j > start else self.trie.first.take(rows[:, j])
            on = np.flatnonzero(node)
            if not len(on):
                return
            live, node = live[on], node[on]
            yield j + 1, live, node

    def forward(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log probability of each word under each language."""
        n, width = rows.shape
        k = self.prob.shape[1]
        alpha = np.zeros((width + 1, n, k))
        alpha[0] = 1.0
        scale = np.zeros((n, k))
        for i in range(width):
            if i and i % _RESCALE == 0:
                _rescale(alpha[i : i + self.longest], scale, lengths[:, None] >= i)
            for end, live, node in self.walks(rows, i):
                alpha[end, live] += alpha[i, live] * self.prob.take(node, axis=0)
        total = alpha[lengths, np.arange(n)]
        return np.log(np.maximum(total, 1e-300)) + scale

    def score(self, words: list[str]) -> np.ndarray:
        """One row of log probabilities for each word; words are taken by length to waste no work."""
        out = np.empty((len(words), len(self.languages)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            size = max(1, min(4096, 400_000 // (len(words[order[at]]) + 8)))
            part = order[at : at + size]
            part = [i for i in part if len(words[i]) <= 2 * len(words[part[0]]) + 8]
            out[part] = self.forward(*self.encode([words[i] for i in part]))
            at += len(part)
        return out


def _rescale(window: np.ndarray, scale: np.ndarray, counts: np.ndarray) -> None:
    """Divide what the next places hold by its largest, and note that in the logarithm."""
    top = window.max(axis=0)
    top[top == 0] = 1.0
    window /= top
    scale += np.where(counts, np.log(top), 0.0)


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = 3) -> PieceModel:
    """Piece probabilities from word counts by language.

    The alphabet holds every letter of the pieces and the counted words; all other letters are
    one class. Pieces that no lower-case word can hold (capitals, digits, marks) are left out.
    """
    languages = sorted(counts)
    usable = {p for p in pieces if p and p == p.lower() and (p.lstrip("▁") == "" or p.lstrip("▁").isalpha()) and "▁" not in p[1:]}
    letters = {c for p in usable for c in p} | {c for words in counts.values() for w in words for c in w} | {"▁"}
    inside = {c for p in usable for c in p[1:]}  # these have the low classes
    alphabet = {c: i + 1 for i, c in enumerate([*sorted(inside), *sorted(letters - inside)])}
    usable = sorted(usable | letters)
    other = len(alphabet) + 1  # any other letter
    trie = Trie([*(tuple(alphabet[c] for c in p) for p in usable), (other,)], other + 1)
    finals = np.array(trie.ends)
    sizes = np.array([*map(len, usable), 1])
    prob = np.zeros((trie.nodes, len(languages)))
    model = PieceModel(languages, alphabet, trie, prob, int(sizes.max()))
    for k, language in enumerate(languages):
        words = sorted(counts[language], key=lambda w: (len(w), w))
        weight = np.array([counts[language][w] for w in words], float)
        single = PieceModel([language], alphabet, trie, np.zeros((trie.nodes, 1)), model.longest)
        start = np.where(sizes == 1, 1.0, 0.3)
        single.prob[finals, 0] = start / start.sum()
        for _ in range(rounds):
            expected = np.zeros(trie.nodes)
            at = 0
            while at < len(words):
                # words ascend in length, so the last of a batch is its longest
                size = max(1, min(4096, 400_000 // (len(words[min(at + 4095, len(words) - 1)]) + 8)))
                _expect(single, *single.encode(words[at : at + size]), weight[at : at + size], expected)
                at += size
            smooth = expected[finals] + 0.02
            single.prob[finals, 0] = smooth / smooth.sum()
        prob[:, k] = single.prob[:, 0]
    return model


def _expect(model: PieceModel, rows: np.ndarray, lengths: np.ndarray, weight: np.ndarray, expected: np.ndarray) -> None:
    """Add the expected piece counts of these words (forward and backward sums; in logarithms where words are long)."""
    n, width = rows.shape
    if width > _PLAIN:
        with np.errstate(divide="ignore"):
            p = np.log(model.prob[:, 0])
        nothing, one, add, times, out = -np.inf, 0.0, np.logaddexp, np.add, np.exp
    else:
        p, nothing, one, add, times, out = model.prob[:, 0], 0.0, 1.0, np.add, np.multiply, lambda x: x
    found = []
    alpha, beta = np.full((width + 1, n), nothing), np.full((width + 1, n), nothing)
    alpha[0] = one
    for i in range(width):
        for end, live, node in model.walks(rows, i):
            alpha[end, live] = add(alpha[end, live], times(alpha[i, live], p[node]))
            found.append((i, end, live, node))
    ends = np.arange(n)
    beta[lengths, ends] = one
    total = alpha[lengths, ends]
    total = -total if width > _PLAIN else 1.0 / np.maximum(total, 1e-300)
    for i, j, live, node in reversed(found):
        through = times(p[node], beta[j, live])
        beta[i, live] = add(beta[i, live], through)
        expected += np.bincount(node, out(times(times(alpha[i, live], through), total[live])) * weight[live], len(expected))


class Scorer:
    """Scores texts in one Python worker; remembers the words met first, in bounded space."""

    def __init__(self, model: PieceModel, remember: int = 200_000):
        self.model, self.remember = model, remember
        self.row: dict[str, int] = {}
        self.table = np.zeros((1, len(model.languages)))  # row 0: a token without letters

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        tokens = [(t or "").split() for t in texts]
        fresh = {w for words in tokens for w in words if w not in self.row}
        parts = {w: letter_words(w) for w in fresh}
        names = sorted({p for ps in parts.values() for p in ps})
        value = dict(zip(names, self.model.score(names), strict=True)) if names else {}
        zero = np.zeros(len(self.model.languages))
        base = len(self.table)
        extra = [sum((value[p] for p in ps), zero) for ps in parts.values()]
        table = np.vstack([self.table, *[np.array(extra)] * bool(extra)])
        row = self.row | {w: base + i for i, w in enumerate(parts)} if len(self.row) < 2000 else _Both(self.row, {w: base + i for i, w in enumerate(parts)})
        out = []
        for text, words in zip(texts, tokens, strict=True):
            if text is None or not self.model.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            get = row.__getitem__
            total = table[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0) if words else zero
            if not total.any():
                out.append((UNDETERMINED, 0.0))
                continue
            odds = np.exp(total - total.max())
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1.0 / odds.sum())))
        room = self.remember - len(self.row)
        if room > 0 and parts:
            kept = list(parts)[:room]
            self.row.update((w, base + i) for i, w in enumerate(kept))
            self.table = table[: base + len(kept)]
        return out


class _Both(dict):
    """The remembered words, and behind them those of this batch."""

    def __init__(self, known: dict[str, int], fresh: dict[str, int]):
        super().__init__(fresh)
        self.known = known

    def __getitem__(self, word: str) -> int:
        at = self.known.get(word)
        return super().__getitem__(word) if at is None else at


def _scorer(broadcast) -> Scorer:
    key, model = broadcast.value
    return resident(("langid", key), lambda: Scorer(model))


def word_counts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) over whole texts; each task sums in advance."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                for t, l in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for w in letter_words(t):
                        sums[l, w] = sums.get((l, w), 0) + 1
                if len(sums) > 200_000:
                    yield _rows(sums)
                    sums = {}
        yield _rows(sums)

    def _rows(sums):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["lang", "word", "n"])

    chosen = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, pieces: list[str], trains: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 400) -> PieceModel:
    """Fit on all words of about ``per_language`` rows a language, chosen by a hash of id and text.

    Rows with a null text or language do not train. Without any labelled row the model has no
    language and every prediction is "und".
    """
    labelled = docs.where(trains & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r["l"]: r["n"] for r in labelled.groupBy(F.col(lang).cast("string").alias("l")).agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for language, n in sizes.items():
        chosen = chosen | ((F.col(lang) == F.lit(language)) & share(F.xxhash64(doc_id, text), min(1.0, per_language / n)))
    counts: dict[str, dict[str, int]] = {}
    if sizes:
        for r in word_counts(labelled.where(chosen), text, lang).toLocalIterator():
            counts.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return fit(counts, pieces)


RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def predictor(spark, model: PieceModel):
    """A column function: text to (lang_pred, score)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, model))

    @F.arrow_udf(RESULT)
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(shared)
        for array in texts:
            got: list[tuple[str, float]] = []
            for at in range(0, len(array), _SLICE):
                got += scorer(array.slice(at, _SLICE).to_pylist())
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: PieceModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score of every row.

    Null texts and texts without a letter give "und" and 0. Repeated rows give repeated
    results, an empty table an empty one; other columns are not read. Equal likelihoods go
    to the language that sorts first.
    """
    predict = predictor(docs.sparkSession, model)
    return docs.select(F.col(doc_id).alias("doc_id"), predict(F.col(text)).alias("p")).select("doc_id", "p.lang_pred", "p.score")
