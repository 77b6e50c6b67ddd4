"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its learned vector (words that the sample holds often enough; a shared one
for others), its smoothed log odds in the sample, and the mean of its letter pairs' hashed
vectors. Gated units read a window of words in both directions, attention pools their
states, and a logistic layer scores the window. All overlapping windows of a text are
scored and the highest gives the text's score.

Fitting reads whole texts of at most about ``sample`` labelled rows of each class, chosen by a
hash of the id. Word vectors, letter-pair vectors and gates are learned together.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import resident, small_batches
from .quality import labelled

WINDOW, STRIDE = 48, 32
H, WORD_DIM, PAIR_DIM, PAIRS = 8, 6, 6, 2048
_TRIM = re.compile(r"^\W+|\W+$")
f32 = np.float32


def tokens(text: str | None) -> list[str]:
    """Lower-case words between blanks, of any length."""
    return (text or "").lower().split()


def windows(n: int) -> list[int]:
    """Starts of the windows over n words; the last ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def letter_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words' letter pairs, blanks around each word included, and where each word's begin."""
    spelled = [f" {w} " for w in words]
    lengths = np.fromiter(map(len, spelled), np.int64, len(words))
    flat = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    hashed = (flat[:-1] * 1_000_003 + flat[1:] * 7919) % PAIRS
    ends = np.cumsum(lengths)
    keep = np.ones(len(hashed), bool)
    keep[ends[:-1] - 1] = False  # pairs across two words
    return hashed[keep], ends - lengths - np.arange(len(words))


def pair_means(table: np.ndarray, hashed: np.ndarray, starts: np.ndarray) -> np.ndarray:
    counts = np.diff(starts, append=len(hashed))
    return np.add.reduceat(table[hashed], starts, axis=0) / counts[:, None].astype(table.dtype)


@dataclass
class Network:
    vocabulary: dict[str, int]
    odds: np.ndarray
    p: dict[str, np.ndarray]

    def pair_sums(self, words: list[str]) -> np.ndarray:
        """Mean vector of each word's letter pairs."""
        hashed, starts = letter_pairs(words)
        return pair_means(self.p["pairs"], hashed, starts)

    def inputs(self, words: list[str]) -> np.ndarray:
        at = np.fromiter((self.vocabulary.get(_TRIM.sub("", w), 0) for w in words), np.int64, len(words))
        return np.concatenate([self.p["words"][at], self.odds[at][:, None], self.pair_sums(words)], axis=1).astype(f32)

    def projected(self, words: list[str]) -> np.ndarray:
        """The gates' share of each word, both directions: what a table over words can hold."""
        x = self.inputs(words)
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], axis=1).astype(f32)

    def run(self, gates: np.ndarray, at: np.ndarray, real: np.ndarray | None) -> np.ndarray:
        """Scores (log odds) of windows: at (windows, words) indexes rows of gates; real marks words that are no filling."""
        n, width = at.shape
        states = []
        for d, order in (("f", range(width)), ("b", range(width - 1, -1, -1))):
            own = gates[:, : 3 * H] if d == "f" else gates[:, 3 * H :]
            own = np.ascontiguousarray(own)
            u, h = self.p["U" + d], np.zeros((n, H), f32)
            urz, uc = np.ascontiguousarray(u[:, : 2 * H]), np.ascontiguousarray(u[:, 2 * H :])
            out = np.empty((width, n, H), f32)
            columns = np.ascontiguousarray(at.T)
            for t in order:
                g = own.take(columns[t], axis=0)
                rz = g[:, : 2 * H] + h @ urz
                np.tanh(rz, out=rz)  # gates are logistic: half of one plus a tanh; the half is in the weights
                rz += 1
                rz *= 0.5
                c = np.tanh(g[:, 2 * H :] + (rz[:, :H] * h) @ uc)
                c -= h
                c *= rz[:, H:]
                if real is not None:
                    c *= real[:, t, None]
                h = h + c
                out[t] = h
            states.append(out)
        both = np.concatenate(states, axis=2)
        attention = both @ self.p["v"]
        if real is not None:
            attention = np.where(real.T > 0, attention, -1e9)
        attention = np.exp(attention - attention.max(axis=0))
        attention /= attention.sum(axis=0)
        pooled = (both * attention[:, :, None]).sum(axis=0)
        return pooled @ self.p["w"] + self.p["c"][0]


def gradients(p: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean logistic loss of windows, its gradients by hand, and those of the inputs."""
    kind = x.dtype.type
    m = real.astype(kind)
    b, width, _ = x.shape
    grads: dict[str, np.ndarray] = {}
    trace, states = {}, []
    for d, seq in (("f", list(range(width))), ("b", list(range(width - 1, -1, -1)))):
        g = x @ p["W" + d] + p["b" + d]
        u, h, kept = p["U" + d], np.zeros((b, H), kind), []
        out = np.zeros((width, b, H), kind)
        for t in seq:
            rz = kind(0.5) * (np.tanh(g[:, t, : 2 * H] + h @ u[:, : 2 * H]) + kind(1))
            r, z = rz[:, :H], rz[:, H:]
            c = np.tanh(g[:, t, 2 * H :] + (r * h) @ u[:, 2 * H :])
            zm = z * m[:, t, None]
            kept.append((t, h, r, z, zm, c))
            h = h + zm * (c - h)
            out[t] = h
        trace[d] = kept
        states.append(out)
    both = np.concatenate(states, axis=2)
    a = np.where(m.T > 0, both @ p["v"], kind(-1e9))
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = (both * a[:, :, None]).sum(axis=0)
    logit = pooled @ p["w"] + p["c"][0]
    loss = float(np.mean(np.logaddexp(0, logit) - target * logit))
    err = ((1 / (1 + np.exp(-logit)) - target) / b).astype(kind)
    grads["w"] = pooled.T @ err
    grads["c"] = np.array([err.sum()], kind)
    dpool = err[:, None] * p["w"]
    da = (both * dpool[None]).sum(axis=2)
    ds = a * (da - (a * da).sum(axis=0))
    dboth = a[:, :, None] * dpool[None] + ds[:, :, None] * p["v"]
    grads["v"] = np.einsum("tb,tbh->h", ds, both)
    dx = np.zeros_like(x)
    for k, d in enumerate("fb"):
        u, dh, dg = p["U" + d], np.zeros((b, H), kind), np.zeros((b, width, 3 * H), kind)
        du = np.zeros_like(u)
        for t, h, r, z, zm, c in reversed(trace[d]):
            dh = dh + dboth[t][:, k * H : (k + 1) * H]
            dc = dh * zm * (1 - c * c)
            # a gate is half of one plus a tanh, so its slope is twice g (1 - g)
            dz = dh * (c - h) * m[:, t, None] * 2 * z * (1 - z)
            drh = dc @ u[:, 2 * H :].T
            dr = drh * h * 2 * r * (1 - r)
            dg[:, t] = np.concatenate([dr, dz, dc], axis=1)
            du[:, : 2 * H] += h.T @ dg[:, t, : 2 * H]
            du[:, 2 * H :] += (r * h).T @ dc
            dh = dh * (1 - zm) + drh * r + dg[:, t, : 2 * H] @ u[:, : 2 * H].T
        flat = dg.reshape(-1, 3 * H)
        grads["U" + d] = du
        grads["W" + d] = x.reshape(-1, x.shape[2]).T @ flat
        grads["b" + d] = flat.sum(axis=0)
        dx += (flat @ p["W" + d].T).reshape(dx.shape)
    return loss, grads, dx * m[:, :, None]


def _train(net: Network, spelled: list[str], odds: np.ndarray, known: np.ndarray, choose: Callable[[int], np.ndarray], target: np.ndarray, steps: int, rounds: int, seed: int) -> None:
    """Adam on the logistic loss: ``rounds`` rounds of ``steps`` batches of 64 windows.

    For each round ``choose`` gives a window of each text: its words as places in ``spelled``
    (-1 is filling), whose learned vectors are rows ``known`` of the word table. Words and
    letter pairs learn from what reaches their inputs.
    """
    p, rng = net.p, np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    hashed, starts = letter_pairs(spelled)
    counts = np.diff(starts, append=len(hashed))
    order: list[int] = []
    for step in range(1, steps * rounds + 1):
        if step % steps == 1 or steps == 1:
            at = choose((step - 1) // steps)
        if len(order) < min(64, len(target)):
            order = [*order, *rng.permutation(len(target)).tolist()]
        rows, order = order[:64], order[64:]
        places = at[rows]
        words, within = np.unique(np.maximum(places, 0), return_inverse=True)
        within = within.reshape(places.shape)
        size = counts[words]
        ends = np.cumsum(size)
        pairs = hashed[np.arange(ends[-1]) + np.repeat(starts[words] - ends + size, size)]
        vectors = np.concatenate([p["words"][known[words]], odds[words][:, None], pair_means(p["pairs"], pairs, ends - size)], axis=1).astype(f32)
        real = places >= 0
        x = vectors[within] * real[:, :, None].astype(f32)
        real[:, 0] |= ~real.any(axis=1)  # a text without words is a window of one blank
        _, grads, dx = gradients(p, x, real, target[rows])
        reached = np.zeros((len(words), x.shape[2]), f32)
        np.add.at(reached, within[places >= 0], dx[places >= 0])
        grads["words"], grads["pairs"] = np.zeros_like(p["words"]), np.zeros_like(p["pairs"])
        np.add.at(grads["words"], known[words], reached[:, :WORD_DIM])
        np.add.at(grads["pairs"], pairs, np.repeat(reached[:, WORD_DIM + 1 :] / size[:, None].astype(f32), size, axis=0))
        for k, grad in grads.items():
            m1, m2 = moments[k]
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            p[k] -= (0.01 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)).astype(p[k].dtype)


def fit(texts: list[str], y: list[int], steps: int = 70, rounds: int = 4, seed: int = 7, least: int = 4, unseen: float = 0.1) -> Network:
    """A network from texts and labels; without both classes it scores everything alike.

    A text scores as its highest window does, so that window is what learns (a text is a bag
    of windows): in the first round the window of the highest summed log odds, in each later
    one the window that the network itself, having scored all of them, puts highest. A word of
    fewer than ``least`` texts shares its vector, and a share ``unseen`` of the windows is read
    as if all words were such, so that letter pairs learn to tell words that the sample lacks.
    """
    docs = [tokens(t) for t in texts]
    df = (Counter(), Counter())
    for words, c in zip(docs, y, strict=True):
        df[c].update({_TRIM.sub("", w) for w in words})
    totals = [max(1, sum(1 for c in y if c == k)) for k in (0, 1)]
    names = sorted(w for w in df[0].keys() | df[1].keys() if df[0][w] + df[1][w] >= least)
    vocabulary = {w: i + 1 for i, w in enumerate(names)}
    # odds of a text of class 1 to hold the word, smoothed by the classes' sizes
    odds = np.array([0.0, *[np.log((df[1][w] + 0.5) / (totals[1] + 1)) - np.log((df[0][w] + 0.5) / (totals[0] + 1)) for w in names]], f32)
    seen = np.array([0, *[df[0][w] + df[1][w] for w in names]])
    odds *= (seen / (seen + 8.0)).astype(f32)
    rng = np.random.default_rng(seed)
    d = WORD_DIM + 1 + PAIR_DIM
    draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(f32)
    p = {"words": draw(len(vocabulary) + 1, WORD_DIM) * f32(0.2), "pairs": draw(PAIRS, PAIR_DIM), "v": draw(2 * H), "w": draw(2 * H), "c": np.zeros(1, f32)}
    for s in "fb":
        p |= {"W" + s: draw(d, 3 * H), "b" + s: np.zeros(3 * H, f32), "U" + s: draw(H, 3 * H)}
    net = Network(vocabulary, odds, p)
    if len(set(y)) < 2:
        p["c"][0] = np.log((totals[1] if 1 in y else 0.5) / (totals[0] if 0 in y else 0.5)) if y else 0.0
        p["w"][:] = 0
        return net
    spelled = list(dict.fromkeys(w for words in docs for w in words)) or [""]
    place = {w: i for i, w in enumerate(spelled)}
    known = np.array([vocabulary.get(_TRIM.sub("", w), 0) for w in spelled])
    numbered = [np.array([place[w] for w in words], np.int64) for words in docs]
    spans = [(n, s) for n, at in enumerate(numbered) for s in windows(len(at))]
    owner = np.array([n for n, _ in spans])
    every = np.full((len(spans), WINDOW), -1, np.int32)
    for row, (n, s) in zip(every, spans, strict=True):
        part = numbered[n][s : s + WINDOW]
        row[: len(part)] = part
    own = odds[known]
    # a second copy of every word, without a vector and odds of its own
    twice, none = spelled + spelled, np.zeros_like(known)

    def choose(turn: int) -> np.ndarray:
        """The highest window of each text."""
        if turn:
            gates = np.concatenate([net.projected(spelled), np.concatenate([p["bf"], p["bb"]])[None]])
            height = np.empty(len(every), f32)
            for lo in range(0, len(every), 2048):
                part = every[lo : lo + 2048]
                real = (part >= 0).astype(f32)
                real[:, 0] = 1
                height[lo : lo + 2048] = net.run(gates, part, real)
        else:
            height = np.where(every >= 0, own[every], 0).sum(axis=1)
        order = np.lexsort((-height, owner))
        top = every[order[np.flatnonzero(np.append(True, owner[order][1:] != owner[order][:-1]))]]
        blind = rng.random(len(top)) < unseen
        return np.where(blind[:, None] & (top >= 0), top + len(spelled), top)

    target = np.array(y, f32)
    each = max(steps, -(-len(target) // 64))
    _train(net, twice, np.concatenate([own, np.zeros_like(own)]), np.concatenate([known, none]), choose, target, each, rounds, seed)
    return net


def train(docs: DataFrame, labels: DataFrame, trains: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = 1200) -> Network:
    """Fit on about ``sample`` labelled rows of each class at most. Null labels and ids do not train."""
    chosen = labelled(docs.select(doc_id, F.col(text).alias("__text")), labels, label, trains, doc_id, {0: sample, 1: sample})
    rows = sorted((r["i"], r["y"], r["t"] or "") for r in chosen.select(F.col("__id").alias("i"), F.col("__label").alias("y"), F.col("__text").alias("t")).toLocalIterator())
    return fit([r[2] for r in rows], [r[1] for r in rows])


class Scorer:
    """Scores texts in one Python worker; words met first keep their row of gates, in bounded space."""

    def __init__(self, net: Network, remember: int = 250_000):
        self.net, self.remember = net, remember
        self.row: dict[str, int] = {}
        self.gates = np.zeros((4096, 6 * H), f32)  # rows of the remembered words, and behind them those of a batch

    def __call__(self, texts: list[str | None]) -> list[float]:
        docs = [tokens(t) for t in texts]
        row, base = self.row, len(self.row)
        new = sorted(dict.fromkeys(w for words in docs for w in words if w not in row), key=lambda w: len(w) > 64)
        fresh = {w: base + i for i, w in enumerate(new)}
        blank = base + len(new)
        if blank >= len(self.gates):
            self.gates = np.concatenate([self.gates[:base], np.zeros((2 * blank - base + 1, 6 * H), f32)])
        gates = self.gates
        for lo in range(0, len(new), 8192):
            gates[base + lo : base + lo + 8192][: len(new) - lo] = self.net.projected(new[lo : lo + 8192])
        gates[blank] = np.concatenate([self.net.p["bf"], self.net.p["bb"]])
        best = np.full(len(docs), -np.inf)
        full, owner, short = [], [], []
        for n, words in enumerate(docs):
            at = np.array([g if g is not None else fresh[w] for w, g in zip(words, map(row.get, words), strict=True)], np.int64)
            if len(at) < WINDOW:
                short.append((n, at))
                continue
            starts = windows(len(at))
            full.append(np.lib.stride_tricks.sliding_window_view(at, WINDOW)[starts])
            owner += [n] * len(starts)
        if full:
            whole, owners = np.concatenate(full), np.array(owner)
            for lo in range(0, len(whole), 2048):
                np.maximum.at(best, owners[lo : lo + 2048], self.net.run(gates, whole[lo : lo + 2048], None))
        short.sort(key=lambda s: len(s[1]))
        for lo in range(0, len(short), 256):
            part = short[lo : lo + 256]
            width = max(1, len(part[-1][1]))
            at, real = np.full((len(part), width), blank), np.zeros((len(part), width), f32)
            for i, (_, ids) in enumerate(part):
                at[i, : len(ids)] = ids
                real[i, : max(1, len(ids))] = 1
            best[[s[0] for s in part]] = self.net.run(gates, at, real)
        kept = new[: max(0, self.remember - base)]
        row.update((w, base + i) for i, w in enumerate(kept) if len(w) <= 64)  # long words are rare, and last
        return (1 / (1 + np.exp(-np.clip(best, -30, 30)))).tolist()


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row.

    Null and blank texts are scored as a window of one blank word. Texts and words of any
    length are read whole. Repeated rows score alike, an empty table gives no rows, other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, net))

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key, network = shared.value
        scorer = resident(("toxicity", key), lambda: Scorer(network))
        for array in texts:
            got: list[float] = []
            for at in range(0, len(array), 256):
                got += scorer(array.slice(at, 256).to_pylist())
            yield pa.array(got, pa.float64())

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("score"))
