"""Toxicity by a bidirectional gated recurrent network with attention pooling, over characters and words.

A word's input is a trained word vector (rare words share one) beside what a character network makes of its letters: a
bidirectional GRU and attention over the letters. A second bidirectional GRU with attention reads a window of words
and gives the window's probability. Training is plain numpy on a bounded sample of labelled rows: a document is toxic
unless all of its windows are clean (noisy or), so the network finds the windows itself. Scoring reads every word of
every text in windows that overlap by half; a document's score is that of its worst window.

Null and empty texts, and texts of white space only, have no window and score 0. Documents with labels that differ are
used once for each label; rows without a label or id, or with a label other than 0 and 1, aren't learned from. Of rows
that share a labelled id one text is learned from, the smallest, and none longer than `SAMPLE_CHARS`; all are scored, and
repeated rows and ties need no rule there. Without an example of either label every window scores the share of toxic
examples. Long unbroken strings are read in pieces of `PIECE` characters, texts of any length whole. An empty table gives
no rows. Kept columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_remainder, written

WINDOW, STRIDE = 32, 16
PIECE = 16
WORD_DIM, CHAR_DIM, CHAR_HIDDEN, WORD_HIDDEN, ATTENTION = 6, 8, 12, 8, 8
#: Bounds of the training sample: labelled documents of each label, characters of a text that is learned from, and of all.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS, SAMPLE_TOTAL = 700, 2000, 200_000, 64_000_000
#: Texts that are scored together: rows and characters.
TOGETHER, TOGETHER_CHARS = 1024, 2_000_000
#: Training: updates of either kind, windows of a document in them, and more windows, drawn, of toxic documents.
RANDOM_UPDATES, RANDOM_WINDOWS, WORST_UPDATES, WORST_WINDOWS, TOXIC_WINDOWS = 550, 10, 750, 2, 6
BATCH_WINDOWS, RATE, WORD_DROPOUT = 64, 0.01, 0.25
THRESHOLD = 0.3
EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…-_*"
CACHE_WORDS = 250_000


def words_of(text: str) -> list[str]:
    """Lower-case words without punctuation at their ends; pieces of long strings."""
    out = []
    for token in text.split():
        word = token.strip(EDGE).lower() or token
        if len(word) <= PIECE:
            out.append(word)
        else:
            out.extend(word[i : i + PIECE] for i in range(0, len(word), PIECE))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Gru:
    """Both directions of a gated recurrent layer; time comes first. Parameters live in a shared dict under a prefix."""

    def __init__(self, params: dict, name: str, inputs: int, hidden: int, rng=None):
        self.p, self.name, self.h = params, name, hidden
        if rng is not None:
            for d in "fb":
                params[f"{name}W{d}"] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 3 * hidden)).astype(np.float32)
                params[f"{name}U{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
                params[f"{name}b{d}"] = np.zeros(3 * hidden, np.float32)

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Both directions run together, the backward one over reversed time."""
        steps, n, _ = x.shape
        h, p, name = self.h, self.p, self.name
        gates = np.stack([x @ p[f"{name}Wf"] + p[f"{name}bf"], (x @ p[f"{name}Wb"] + p[f"{name}bb"])[::-1]])
        masks = np.stack([mask, mask[::-1]])[..., None]
        u = np.stack([p[f"{name}Uf"], p[f"{name}Ub"]])
        states = np.zeros((steps + 1, 2, n, h), x.dtype)
        kept = np.empty((steps, 4, 2, n, h), x.dtype)  # z, r, new, what the state gives to new
        for t in range(steps):
            state = states[t]
            recurrent = state @ u
            zr = sigmoid(gates[:, t, :, : 2 * h] + recurrent[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            new = np.tanh(gates[:, t, :, 2 * h :] + r * recurrent[..., 2 * h :])
            kept[t, 0], kept[t, 1], kept[t, 2], kept[t, 3] = z, r, new, recurrent[..., 2 * h :]
            states[t + 1] = state + masks[:, t] * (1 - z) * (new - state)
        out = np.concatenate([states[1:, 0], states[1:, 1][::-1]], axis=2)
        return out, (x, masks, u, states, kept)

    def backward(self, dout: np.ndarray, cache: tuple, grads: dict) -> np.ndarray:
        x, masks, u, states, kept = cache
        steps, n, inputs = x.shape
        h, p, name = self.h, self.p, self.name
        douts = np.stack([dout[..., :h], dout[..., h:][::-1]])
        dgates, drec = np.empty((2, steps, n, 3 * h), x.dtype), np.empty((2, steps, n, 3 * h), x.dtype)
        turned, dstate = np.swapaxes(u, 1, 2), np.zeros((2, n, h), x.dtype)
        for t in range(steps - 1, -1, -1):
            z, r, new, rec_n = kept[t]
            total = dstate + douts[:, t]
            dh = total * masks[:, t]
            dnew = dh * (1 - z)
            dz = dnew * (states[t] - new) * z
            dnew = dnew * (1 - new * new)
            dgates[:, t, :, :h] = drec[:, t, :, :h] = dz
            dgates[:, t, :, h : 2 * h] = drec[:, t, :, h : 2 * h] = dnew * rec_n * r * (1 - r)
            dgates[:, t, :, 2 * h :] = dnew
            drec[:, t, :, 2 * h :] = dnew * r
            dstate = total - dh * (1 - z) + drec[:, t] @ turned
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            flat = (dgates[0] if k == 0 else dgates[1][::-1]).reshape(-1, 3 * h)
            grads[f"{name}U{d}"] = states[:-1, k].reshape(-1, h).T @ drec[k].reshape(-1, 3 * h)
            grads[f"{name}W{d}"] = x.reshape(-1, inputs).T @ flat
            grads[f"{name}b{d}"] = flat.sum(0)
            dx += (flat @ p[f"{name}W{d}"].T).reshape(x.shape)
        return dx


class Attention:
    """A weighted mean over time, the weights by a small scorer."""

    def __init__(self, params: dict, name: str, inputs: int, rng=None):
        self.p, self.name = params, name
        if rng is not None:
            params[f"{name}W"] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, ATTENTION)).astype(np.float32)
            params[f"{name}v"] = rng.normal(0, 0.3, ATTENTION).astype(np.float32)

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        hidden = np.tanh(x @ self.p[f"{self.name}W"])
        e = hidden @ self.p[f"{self.name}v"]
        e = np.where(mask > 0, e, -1e9)
        a = np.exp(e - e.max(0)) * mask
        a /= np.maximum(a.sum(0), 1e-9)
        return np.einsum("tn,tnd->nd", a, x), (x, hidden, a)

    def backward(self, dout: np.ndarray, cache: tuple, grads: dict) -> np.ndarray:
        x, hidden, a = cache
        da = np.einsum("nd,tnd->tn", dout, x)
        de = a * (da - (a * da).sum(0))
        grads[f"{self.name}v"] = np.einsum("tn,tnd->d", de, hidden)
        dhidden = de[:, :, None] * self.p[f"{self.name}v"] * (1 - hidden * hidden)
        grads[f"{self.name}W"] = x.reshape(-1, x.shape[2]).T @ dhidden.reshape(-1, ATTENTION)
        return a[:, :, None] * dout + dhidden @ self.p[f"{self.name}W"].T


def scatter_sum(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out = np.zeros((n, values.shape[1]), np.float32)
    out[ordered[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Network:
    """Parameters, vocabulary and both passes. Pickles as small arrays and dicts."""

    def __init__(self, words: dict[str, int], chars: dict[str, int], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.words, self.chars = words, chars  # 0: unknown word; 0: no letter, 1: unknown letter
        p: dict[str, np.ndarray] = {}
        p["Ew"] = rng.normal(0, 0.1, (len(words) + 1, WORD_DIM)).astype(np.float32)
        p["Ec"] = rng.normal(0, 0.5, (len(chars) + 2, CHAR_DIM)).astype(np.float32)
        Gru(p, "c", CHAR_DIM, CHAR_HIDDEN, rng)
        Attention(p, "ca", 2 * CHAR_HIDDEN, rng)
        Gru(p, "w", WORD_DIM + 2 * CHAR_HIDDEN, WORD_HIDDEN, rng)
        Attention(p, "wa", 2 * WORD_HIDDEN, rng)
        p["o"] = rng.normal(0, 0.3, 2 * WORD_HIDDEN).astype(np.float32)
        p["ob"] = np.array([-2.0], np.float32)
        self.p = p
        self._layers()

    def _layers(self) -> None:
        p = self.p
        self.char_gru, self.char_att = Gru(p, "c", CHAR_DIM, CHAR_HIDDEN), Attention(p, "ca", 2 * CHAR_HIDDEN)
        self.word_gru, self.word_att = Gru(p, "w", WORD_DIM + 2 * CHAR_HIDDEN, WORD_HIDDEN), Attention(p, "wa", 2 * WORD_HIDDEN)

    def letters(self, words: list[str], width: int) -> np.ndarray:
        """Letter numbers, time first, 0 after the end."""
        out = np.zeros((len(words), width), np.int32)
        get = self.chars.get
        for i, w in enumerate(words):
            out[i, : len(w)] = [get(c, 1) for c in w]
        return out.T

    def by_length(self, words: list[str]) -> list[tuple[np.ndarray, int]]:
        """Words in a few groups of similar length, so that little is padding."""
        lengths = np.array([len(w) for w in words])
        edges = [0, 6, 10, PIECE]
        return [(at, high) for low, high in zip(edges, edges[1:], strict=False) if len(at := np.flatnonzero((lengths > low) & (lengths <= high)))]

    def char_vectors(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), 2 * CHAR_HIDDEN), np.float32)
        for group, width in self.by_length(words):
            for low in range(0, len(group), 4096):
                at = group[low : low + 4096]
                letters = self.letters([words[i] for i in at], width)
                mask = (letters > 0).astype(np.float32)
                hidden, _ = self.char_gru.forward(self.p["Ec"][letters], mask)
                out[at] = self.char_att.forward(hidden, mask)[0]
        return out

    def step(self, windows: np.ndarray, words: list[str], owner: np.ndarray, label: np.ndarray, unknown: np.ndarray | None = None, weight: float = 1.0) -> tuple[float, dict]:
        """Loss and gradients of a batch: windows of positions in `words` (-1: none), each of a document with a label.

        unknown: words to take as rare ones, so that their letters must tell.
        """
        p, grads = self.p, {}
        ids = np.array([self.words.get(w, 0) for w in words])
        if unknown is not None:
            ids[unknown] = 0
        parts, chars = [], np.zeros((len(words), 2 * CHAR_HIDDEN), np.float32)
        for at, width in self.by_length(words):
            letters = self.letters([words[i] for i in at], width)
            mask = (letters > 0).astype(np.float32)
            hidden, kept = self.char_gru.forward(p["Ec"][letters], mask)
            chars[at], kept_att = self.char_att.forward(hidden, mask)
            parts.append((at, letters, kept, kept_att))
        rows = np.concatenate([p["Ew"][ids], chars], axis=1)
        index = windows.T
        mask = (index >= 0).astype(np.float32)
        x = rows[np.maximum(index, 0)] * mask[:, :, None]
        hidden, kept = self.word_gru.forward(x, mask)
        pooled, kept_att = self.word_att.forward(hidden, mask)
        logit = pooled @ p["o"] + p["ob"][0]
        prob = sigmoid(logit)
        log_clean = np.zeros(len(label), np.float64)
        np.add.at(log_clean, owner, np.log1p(-np.minimum(prob, 1 - 1e-6)).astype(np.float64))
        toxic = np.maximum(-np.expm1(log_clean), 1e-6)
        loss = float(-(np.where(label > 0, np.log(toxic), log_clean)).sum())
        dlogit = np.where(label[owner] > 0, -weight * prob * np.exp(log_clean[owner]) / toxic[owner], prob).astype(np.float32) / len(label)
        grads["o"], grads["ob"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
        dhidden = self.word_att.backward(dlogit[:, None] * p["o"], kept_att, grads)
        dx = self.word_gru.backward(dhidden, kept, grads) * mask[:, :, None]
        drows = scatter_sum(np.maximum(index, 0).reshape(-1), dx.reshape(-1, dx.shape[2]), len(words))
        grads["Ew"] = scatter_sum(ids, drows[:, :WORD_DIM], len(p["Ew"]))
        grads["Ec"] = np.zeros_like(p["Ec"])
        sums: dict[str, np.ndarray] = {}
        for at, letters, kept, kept_att in parts:
            own: dict[str, np.ndarray] = {}
            dh = self.char_att.backward(drows[at][:, WORD_DIM:], kept_att, own)
            dletters = self.char_gru.backward(dh, kept, own)
            grads["Ec"] += scatter_sum(letters.reshape(-1), dletters.reshape(-1, CHAR_DIM), len(p["Ec"]))
            for name, g in own.items():
                sums[name] = sums.get(name, 0) + g
        return loss, grads | sums


def window_starts(n: int) -> range:
    """Starts of overlapping windows that cover n words."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else range(0, min(n, 1))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """Some epochs over windows drawn at random, then some over the windows that the network finds worst."""
    rng = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    known = Counter(w for d in docs for w in set(d))
    letters = Counter(c for w in known for c in w)
    words = {w: i + 1 for i, w in enumerate(sorted(w for w, n in known.items() if n >= 4))}
    chars = {c: i + 2 for i, c in enumerate(sorted(c for c, n in letters.items() if n >= 4))}
    net = Network(words, chars)
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    if not 0 < sum(labels) < len(labels):  # nothing to tell apart
        net.p["o"][:] = 0
        net.p["ob"][0] = np.log(share / (1 - share))
        return net
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    examples = [(d, y) for d, y in zip(docs, labels, strict=True) if d]
    count, plans = 0, []
    for plan, updates, most, more in (("random", RANDOM_UPDATES, RANDOM_WINDOWS, 0), ("worst", WORST_UPDATES, WORST_WINDOWS, TOXIC_WINDOWS)):
        windows = sum(min(most + y * more, -(-len(d) // WINDOW)) for d, y in examples)
        plans += [plan] * max(1, round(updates * BATCH_WINDOWS / max(1, windows)))
    total = RANDOM_UPDATES + WORST_UPDATES
    weight = max(1.0, (len(labels) - sum(labels)) / sum(labels) / 3)  # of a toxic document, where few are
    for plan in plans:
        ranked = Scorer(net).ranked_windows([d for d, _ in examples]) if plan == "worst" else None
        batch: list[tuple[list[list[str]], int]] = []
        held = 0
        for i in [*rng.permutation(len(examples)).tolist(), -1]:
            if i >= 0:
                d, y = examples[i]
                if ranked is not None:
                    best, rest = ranked[i][:WORST_WINDOWS], ranked[i][WORST_WINDOWS:]
                    starts = best + (rng.permutation(rest)[:TOXIC_WINDOWS].tolist() if y else [])
                else:
                    starts = range(int(rng.integers(0, WINDOW // 2)) if len(d) > WINDOW else 0, len(d), WINDOW)
                    starts = rng.choice(starts, RANDOM_WINDOWS, replace=False).tolist() if len(starts) > RANDOM_WINDOWS else list(starts)
                cuts = [d[a : a + WINDOW] for a in starts]
                batch.append((cuts, y))
                held += len(cuts)
            if not batch or (i >= 0 and held < BATCH_WINDOWS):
                continue
            place: dict[str, int] = {}
            rows = np.full((held, WINDOW), -1, np.int64)
            owner, k = np.empty(held, np.int64), 0
            for j, (cuts, _) in enumerate(batch):
                for c in cuts:
                    rows[k, : len(c)] = [place.setdefault(w, len(place)) for w in c]
                    owner[k] = j
                    k += 1
            _, grads = net.step(rows, list(place), owner, np.array([y for _, y in batch]), rng.random(len(place)) < WORD_DROPOUT, weight)
            count += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = RATE * min(1, count / 20) * max(0.05, 1 - count / (total + 1)) * np.sqrt(1 - 0.999**count) / (1 - 0.9**count)
            for name, g in grads.items():
                g = g * min(1, 5 / (norm + 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                net.p[name] -= (rate * first[name] / (np.sqrt(second[name]) + 1e-7)).astype(np.float32)
            batch, held = [], 0
    return net


class Scorer:
    """Scores whole texts. What a word gives to the gates of both directions is kept for the words met before."""

    def __init__(self, net: Network):
        self.net, h = net, WORD_HIDDEN
        net._layers()
        p = net.p
        # gates of both directions side by side: z and r of both (halved, for sigmoid by tanh), then new of both
        def side(f, b):
            z, r, n = ([m[..., i * h : (i + 1) * h] for m in (f, b)] for i in range(3))
            return np.concatenate([0.5 * z[0], 0.5 * z[1], 0.5 * r[0], 0.5 * r[1], n[0], n[1]], axis=-1)

        wf, wb = p["wWf"], p["wWb"]
        self.w, self.b = side(wf, wb), side(p["wbf"], p["wbb"])
        zero = np.zeros_like(p["wUf"])
        self.u = np.concatenate([side(p["wUf"], zero), side(zero, p["wUb"])]).astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.gates = np.empty((4096, 6 * WORD_HIDDEN), np.float32)

    def learn(self, new: list[str]) -> None:
        """Inputs of words not met before, many at a time."""
        net = self.net
        ids = np.array([net.words.get(w, 0) for w in new])
        rows = np.concatenate([net.p["Ew"][ids], net.char_vectors(new)], axis=1) @ self.w + self.b
        at = len(self.place)
        while at + len(new) > len(self.gates):
            self.gates = np.concatenate([self.gates, np.empty_like(self.gates)])
        self.gates[at : at + len(new)] = rows
        self.place.update(zip(new, range(at, at + len(new)), strict=True))

    def window_scores(self, index: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each window; index: places of its words, anything after its length."""
        n, h = len(index), WORD_HIDDEN
        state = np.zeros((n, 2 * h), np.float32)
        out = np.empty((WINDOW, n, 2 * h), np.float32)
        gates = self.gates
        full = bool((lengths == WINDOW).all())
        x = np.empty((n, 6 * h), np.float32)
        view = x.reshape(n, 3, 2, h)
        for t in range(WINDOW):
            s = WINDOW - 1 - t
            other = gates[index[:, s]].reshape(n, 3, 2, h)
            view[:, :, 0] = gates[index[:, t]].reshape(n, 3, 2, h)[:, :, 0]
            view[:, :, 1] = other[:, :, 1]
            recurrent = state @ self.u
            zr = np.tanh(x[:, : 4 * h] + recurrent[:, : 4 * h])
            zr *= 0.5
            zr += 0.5
            new = np.tanh(x[:, 4 * h :] + zr[:, 2 * h :] * recurrent[:, 4 * h :])
            now = new + zr[:, : 2 * h] * (state - new)
            if not full:
                now[:, :h] = np.where((t < lengths)[:, None], now[:, :h], state[:, :h])
                now[:, h:] = np.where((s < lengths)[:, None], now[:, h:], state[:, h:])
            out[t, :, :h] = now[:, :h]
            out[s, :, h:] = now[:, h:]
            state = now
        mask = (np.arange(WINDOW)[:, None] < lengths).astype(np.float32)
        pooled, _ = self.net.word_att.forward(out, mask)
        return sigmoid(pooled @ self.net.p["o"] + self.net.p["ob"][0])

    def window_probabilities(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all overlapping windows: the document, the first word, the probability."""
        if len(self.place) > CACHE_WORDS:
            self.clear()
        new = {w for d in docs for w in d} - self.place.keys()
        if new:
            self.learn(sorted(new))
        counts = np.array([len(d) for d in docs], np.int64)
        flat = np.fromiter((i for d in docs for i in map(self.place.__getitem__, d)), np.int64, int(counts.sum()))
        flat = np.concatenate([flat, np.zeros(WINDOW, np.int64)])
        begin = np.cumsum(counts) - counts
        starts = [np.arange(r.start, r.stop, r.step, dtype=np.int64) for r in map(window_starts, counts.tolist())]
        inside = np.concatenate([*starts, np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        lengths = np.minimum(WINDOW, counts[owner] - inside)
        at = begin[owner] + inside
        probs = np.empty(len(at))
        for low in range(0, len(at), 2048):
            part = slice(low, low + 2048)
            probs[part] = self.window_scores(flat[at[part][:, None] + np.arange(WINDOW)], lengths[part])
        return owner, inside, probs

    def ranked_windows(self, docs: list[list[str]]) -> list[list[int]]:
        """Starts of each document's windows, worst first."""
        out: list[list[int]] = [[] for _ in docs]
        for low in range(0, len(docs), 256):
            owner, inside, probs = self.window_probabilities(docs[low : low + 256])
            for k in np.argsort(-probs, kind="stable").tolist():
                out[low + owner[k]].append(int(inside[k]))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        owner, _, probs = self.window_probabilities([words_of(t) if t else [] for t in texts])
        out = np.zeros(len(texts))
        np.maximum.at(out, owner, probs)
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: of each label so many ids at most, by a hash of the id, none held out.

    One text of each id and label is taken. Of these, in the order of a hash of the id, those come to the driver that fit
    into SAMPLE_TOTAL characters together.
    """
    usable = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), 4) != 2)).distinct()
    drawn = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, toxic), (0, clean))]
    picked = drawn[0].unionByName(drawn[1])  # at most toxic + clean rows
    texts = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    one = written(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    fitting, left = [], SAMPLE_TOTAL
    for r in one.select("doc_id", "toxic", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "toxic").collect():  # toxic + clean rows
        if r["n"] <= left:
            fitting.append((r["doc_id"], r["toxic"]))
            left -= r["n"]
    known = one.sparkSession.createDataFrame(fitting, one.select("doc_id", "toxic").schema)
    rows = one.join(F.broadcast(known), ["doc_id", "toxic"]).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"]))
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def in_portions(texts: list[str | None], rows: int, chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of so many rows and characters at most; a longer text is alone."""
    low = held = 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > low and (i - low >= rows or held + size > chars):
            yield low, i
            low, held = i, 0
        held += size
    if low < len(texts):
        yield low, len(texts)


def with_scores(docs: DataFrame, net: Network, keep: list[str], name: str = "score", text_col: str = "text") -> DataFrame:
    """The kept columns and the score of each whole text."""
    picked = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("_scored"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for low, high in in_portions(texts, TOGETHER, TOGETHER_CHARS):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scorer.scores(texts[low:high]), pa.float64())], names=schema.names)

    return picked.mapInArrow(run, schema).toDF(*keep, name)
