"""A linear-chain conditional random field over words, trained and run in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np

from stepweave.llm.langs import HAN, LANGUAGES, LEXICON

#: Rows of the hashed weight table: its size is fixed, whatever the texts.
BUCKETS = 1 << 15
#: Distinct words whose scores are remembered at a time.
CACHE = 200_000
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_INDEX = {k: i for i, k in enumerate(LANGUAGES)}


def features(word: str) -> list[int]:
    """Hashed affixes, character n-grams and lexicon entries of a word in lower case."""
    names = [f"w={word}"]
    if HAN.match(word):
        names.append("script=han")
    elif _CYRILLIC.match(word):
        names.append("script=cyrillic")
    names += [f"l={k}" for k, words in LEXICON.items() if word in words]
    names += [f"p{n}={word[:n]}" for n in (1, 2, 3) if len(word) > n]
    names += [f"s{n}={word[-n:]}" for n in (1, 2, 3, 4) if len(word) > n]
    edged = f"^{word}$"
    names += [f"g={edged[i:i + n]}" for n in (2, 3) for i in range(len(edged) - n + 1)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


@dataclass
class Crf:
    """Weights: features by language, and transitions inside a sentence ([0]) and over its border ([1])."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, len(LANGUAGES)), np.float32))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, len(LANGUAGES), len(LANGUAGES)), np.float32))

    def scorer(self):
        seen: dict[str, np.ndarray] = {}

        def score(word: str) -> np.ndarray:
            got = seen.get(word)
            if got is None:
                if len(seen) >= CACHE:
                    seen.clear()
                got = seen[word] = self.weights[features(word)].sum(0)
            return got

        return score


def _pad(lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lengths), int(lengths.max()), *rows.shape[1:]), rows.dtype)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = rows
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def forward_backward(scores: np.ndarray, border: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded sequences in ascending order of ``lengths``: log partition, forward and backward scores. ``border[b, t]`` is 1 where word t begins a sentence."""
    n, steps, _ = scores.shape
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    first = np.searchsorted(lengths, np.arange(steps), side="right")  # from here on the sequences have a word t
    for t in range(1, steps):
        k = first[t]
        ahead[k:, t] = _log_sum(ahead[k:, t - 1][:, :, None] + moves[border[k:, t]], 1) + scores[k:, t]
    for t in range(steps - 2, -1, -1):
        k = first[t + 1]
        back[k:, t] = _log_sum(moves[border[k:, t + 1]] + (scores[k:, t + 1] + back[k:, t + 1])[:, None, :], 2)
    return _log_sum(ahead[np.arange(n), lengths - 1], 1), ahead, back


def _summed(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by key from 0 to n - 1."""
    return np.stack([np.bincount(keys, rows[:, k], n) for k in range(rows.shape[1])], 1).astype(np.float32)


def train(texts: Sequence[Sequence[tuple[list[str], str]]], epochs: int = 6, batch: int = 128, rate: float = 0.3, seed: int = 7) -> Crf:
    """Texts are lists of (words of a sentence, its language); weights by AdaGrad on the conditional likelihood."""
    model, rng = Crf(), np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    data = []
    for text in texts:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for words, _ in text for w in words]
        labels = [_INDEX[lang] for words, lang in text for _ in words]
        starts = [int(i == 0) for words, _ in text for i in range(len(words))]
        if ids:
            data.append((np.array(ids), np.array(labels), np.array(starts)))
    if not data:
        return model
    flat = [np.array(features(w)) for w in vocabulary]
    sizes = np.array([len(x) for x in flat])
    square_w, square_m = np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1e-6)
    eye = np.eye(len(LANGUAGES), dtype=np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for k in range(0, len(order), batch):
            part = sorted((data[i] for i in order[k : k + batch]), key=lambda x: len(x[0]))
            lengths = np.array([len(x[0]) for x in part])
            ids, labels, starts = (_pad(lengths, np.concatenate([x[j] for x in part])) for j in range(3))
            # Only the words at hand are scored and move the weights.
            here, ids = np.unique(ids, return_inverse=True)
            ids = ids.reshape(labels.shape)
            own = np.concatenate([flat[w] for w in here])
            width = sizes[here]
            emission = np.add.reduceat(model.weights[own], np.concatenate([[0], np.cumsum(width)[:-1]]), axis=0)
            scores = emission[ids]
            total, ahead, back = forward_backward(scores, starts, lengths, model.moves)
            real = np.arange(ids.shape[1])[None, :] < lengths[:, None]
            marginal = np.exp(ahead + back - total[:, None, None])
            wrong = (eye[labels] - marginal)[real]
            by_word = _summed(ids[real], wrong, len(here))
            grad = _summed(own, by_word[np.repeat(np.arange(len(here)), width)], BUCKETS)
            move = np.zeros_like(model.moves)
            first = np.searchsorted(lengths, np.arange(ids.shape[1]), side="right")
            for t in range(1, ids.shape[1]):
                live = slice(first[t], None)
                pair = np.exp(ahead[live, t - 1][:, :, None] + model.moves[starts[live, t]] + (scores[live, t] + back[live, t])[:, None, :] - total[live][:, None, None])
                seen = eye[labels[live, t - 1]][:, :, None] * eye[labels[live, t]][:, None, :] - pair
                for b in (0, 1):
                    move[b] += seen[starts[live, t] == b].sum(0)
            grad, move = grad / len(part) - 1e-5 * model.weights, move / len(part) - 1e-4 * model.moves
            square_w += grad**2
            square_m += move**2
            model.weights += rate * grad / np.sqrt(square_w)
            model.moves += rate * move / np.sqrt(square_m)
    return model


def label(model: Crf, score, texts: Iterable[list[list[str]]]) -> list[list[tuple[str, float, float]]]:
    """For each text (a list of sentences of words): each sentence's language, the mean probability of it over the words, and its lead over the next one in summed log odds."""
    texts = list(texts)
    out: list[list[tuple[str, float, float]]] = [[] for _ in texts]
    lengths = np.array([sum(map(len, t)) for t in texts])
    order = [i for i in np.argsort(lengths, kind="stable") if lengths[i]]
    while order:
        # Texts of like length together, so that one long text doesn't pad many short ones.
        top = int(lengths[order[-1]])
        take = max(1, min(1024, 2_000_000 // (top * len(LANGUAGES))))
        part, order = order[-take:], order[:-take]
        size = lengths[part]
        rows = np.array([score(w) for i in part for s in texts[i] for w in s], np.float32)
        spans = [len(s) for i in part for s in texts[i]]
        at = np.concatenate([[0], np.cumsum(spans)[:-1]])
        starts = np.zeros(len(rows), np.int64)
        starts[at] = 1
        total, ahead, back = forward_backward(_pad(size, rows), _pad(size, starts), size, model.moves)
        real = np.arange(ahead.shape[1])[None, :] < size[:, None]
        probability = np.exp(ahead + back - total[:, None, None])[real]
        mean, own = np.add.reduceat(probability, at, axis=0) / np.array(spans)[:, None], np.add.reduceat(rows, at, axis=0)
        best = mean.argmax(1)
        pick = np.arange(len(at))
        mine = own[pick, best]
        own[pick, best] = -np.inf
        judged = zip(best.tolist(), mean[pick, best].tolist(), (mine - own.max(1)).tolist())
        for i in part:
            out[i] = [(LANGUAGES[k], p, lead) for k, p, lead in (next(judged) for _ in texts[i])]
    return out
