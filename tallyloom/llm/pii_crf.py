"""A skip-chain conditional random field over token sequences, in numpy.

Neighbouring tokens share transition potentials. Tokens of a document that are equal or similar share skip potentials: equal words that are capitalised somewhere in the
document, words one letter apart, runs of three Chinese characters, numbers of equal digits, addresses of mail. A skip potential has a weight for each sort of likeness and
each label, gained when both ends bear that label. Beliefs come from loopy message passing: an exact forward-backward pass over the chain and messages over the skip
edges in turn, until no message moves.
All weights are trained together by gradient ascent (AdaGrad) on the likelihood, with the beliefs of the loopy passing in the gradient.
"""

from __future__ import annotations

import zlib

import numpy as np

LABELS = ("O", "email", "phone", "id_number", "address", "name")
K = len(LABELS)
#: Sorts of likeness between two tokens.
LIKENESS = ("word", "similar", "run", "number", "mail")
OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3, 4)
BITS = 18
SIZE = 1 << BITS
#: Pairs and triples of positions whose classes form a feature, and positions whose word forms one with the token's class.
CLASS_SETS = ((-1, 0), (0, 1), (-2, 0), (0, 2), (-1, 0, 1), (-2, -1, 0), (0, 1, 2), (-2, -1, 0, 1), (-1, 0, 1, 2), (-3, -2, -1, 0))
WORD_CLASS = (-4, -3, -2, -1, 1, 2, 3)


def _hash(s: str) -> int:
    return zlib.crc32(s.encode())


class Vocabulary:
    """Numbers the token types seen and keeps their feature hashes."""

    def __init__(self) -> None:
        self.ids: dict[tuple[str, str], int] = {}
        self.words: list[int] = [_hash("<pad>")]
        self.classes: list[int] = [_hash("<pad>")]
        self.parts: list[tuple[int, ...]] = [(_hash("w=<pad>"),) * 4]

    def add(self, form: str, kind: str) -> int:
        key = (form, kind)
        i = self.ids.get(key)
        if i is None:
            low = form.lower() if kind in _SPELT or kind.startswith("C_") else kind
            i = self.ids[key] = len(self.words)
            self.words.append(_hash(low))
            self.classes.append(_hash(kind))
            self.parts.append((_hash("w=" + low), _hash("s=" + low[-3:]), _hash("p=" + low[:3]), _hash("c=" + kind)))
        return i

    def sequence(self, forms: list[str], classes: list[str]) -> np.ndarray:
        return np.fromiter((self.add(f, c) for f, c in zip(forms, classes)), np.int64, len(forms))


#: Classes whose own letters are features.
_SPELT = {"LOWER", "TITLE", "UPPER", "STREET", "STREETES", "STREETDE", "INITIAL", "LETTER", "ZH", "ZHFAM", "ZHEND", "ZHUNIT", "THING", "ZHTHING"}


def _number(h: np.ndarray) -> np.ndarray:
    """Feature numbers of hashes."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) & np.uint64(SIZE - 1)).astype(np.int64)


def own_ids(parts: np.ndarray, offset: int) -> np.ndarray:
    """Feature numbers of single tokens, as seen from ``offset`` places away: one row per type."""
    salt = np.uint64((offset + 5) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return np.stack([_number(parts[:, j] * np.uint64(2 * j + 3) + salt) for j in (range(4) if abs(offset) <= 1 else (0, 3))], 1)


def joint_ids(words: np.ndarray, classes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Feature numbers of several tokens together, for a sequence of type numbers with four paddings at either end."""
    n = len(x) - 8
    w, c = words[x], classes[x]
    cut = lambda a, o: a[4 + o : 4 + o + n]
    cols = []
    for k, places in enumerate(CLASS_SETS):
        h = np.full(n, k + 101, np.uint64)
        for o in places:
            h = (h ^ cut(c, o)) * np.uint64(0x100000001B3)
        cols.append(h)
    own = cut(c, 0)
    for o in WORD_CLASS:
        cols.append(((np.uint64(o + 211) ^ cut(w, o)) * np.uint64(0x100000001B3) ^ own) * np.uint64(0x9E3779B97F4A7C15))
    return _number(np.stack(cols, 1))


_PAD = np.zeros(4, np.int64)


class SkipChain:
    """Weights of the field: per feature and label, transitions, and per likeness and label the skip weight."""

    def __init__(self, weights: np.ndarray | None = None, transitions: np.ndarray | None = None, skip: np.ndarray | None = None) -> None:
        self.weights = np.zeros((SIZE, K), np.float32) if weights is None else weights
        self.transitions = np.zeros((K, K), np.float32) if transitions is None else transitions
        self.skip = np.zeros((len(LIKENESS), K)) if skip is None else skip
        self.vocabulary = Vocabulary()
        self._arrays: tuple | None = None
        self._own: list[np.ndarray] | None = None
        self._fitted = True

    def state(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.weights, self.transitions, self.skip

    def _types(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = self.vocabulary
        if self._arrays is None or len(self._arrays[0]) < len(v.words):
            self._arrays = (np.array(v.words, np.uint64), np.array(v.classes, np.uint64), np.array(v.parts, np.uint64))
        return self._arrays

    def features(self, at: np.ndarray) -> np.ndarray:
        """All feature numbers (n, f) of a sequence of type numbers."""
        words, classes, parts = self._types()
        x = np.concatenate([_PAD, at, _PAD])
        n = len(at)
        own = [own_ids(parts[x[4 + o : 4 + o + n]], o) for o in OFFSETS]
        return np.concatenate([*own, joint_ids(words, classes, x)], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Summed weights (n, K) of a padded sequence. What single tokens add is kept by type, as types recur."""
        words, classes, parts = self._types()
        if self._own is None or len(self._own[0]) < len(words):
            have = 0 if self._own is None else len(self._own[0])
            new = [self.weights[own_ids(parts[have:], o)].sum(1) for o in OFFSETS]
            self._own = new if self._own is None else [np.concatenate(p) for p in zip(self._own, new)]
        n = len(x) - 8
        e = self.weights[joint_ids(words, classes, x)].sum(1)
        for o, table in zip(OFFSETS, self._own):
            e += table[x[4 + o : 4 + o + n]]
        return e

    # Training

    def fit(self, sequences: list[tuple[list[str], list[str], list[int]]], epochs: int = 3, batch: int = 48, rate: float = 0.1, decay: float = 0.05, seed: int = 7) -> None:
        """sequences: forms, classes and label numbers of each."""
        self._fitted = True
        data = sorted((d for d in sequences if d[0]), key=lambda d: len(d[0]))
        rng = np.random.default_rng(seed)
        sums = [np.full(w.shape, 1e-2, np.float32) for w in (self.weights, self.transitions, self.skip)]
        at = [self.vocabulary.sequence(f, c) for f, c, _ in data]
        prepared = []
        for i in range(0, len(data), batch):
            group = data[i : i + batch]
            feats = [self.features(x) for x in at[i : i + batch]]
            prepared.append((feats, [np.array(y, np.int64) for *_, y in group], _skip_edges([(f, c) for f, c, _ in group])))
        # What the chain has learnt by heart needs no help of like tokens, so the skip weights learn from batches that the chain doesn't learn from.
        apart = set(rng.choice(len(prepared), len(prepared) // 5, replace=False).tolist())
        mean, seen = [np.zeros(w.shape) for w in (self.weights, self.transitions)], 0
        for epoch in range(epochs):
            for k, b in enumerate(rng.permutation(len(prepared))):
                self._step(*prepared[b], *sums, rate, decay, int(b) in apart)
                if epoch == epochs - 1 and k % 8 == 0:
                    mean[0] += self.weights
                    mean[1] += self.transitions
                    seen += 1
        # The mean over the last epoch swings less with the order of the texts than the last weights do.
        if seen:
            self.weights, self.transitions = (mean[0] / seen).astype(np.float32), (mean[1] / seen).astype(np.float32)

    def _step(self, feats, labels, edges, grad2_w, grad2_t, grad2_s, rate, decay, apart) -> None:
        lengths = [len(y) for y in labels]
        top, n = max(lengths), len(labels)
        e = np.zeros((n, top, K))
        mask = np.zeros((n, top), bool)
        gold = np.zeros((n, top), np.int64)
        for i, (f, y) in enumerate(zip(feats, labels)):
            e[i, : lengths[i]] = self.weights[f].sum(1)
            mask[i, : lengths[i]] = True
            gold[i, : lengths[i]] = y
        transitions = self.transitions.astype(float)
        left, right, sort = edges
        messages, agree = None, None
        if len(left):
            _, messages, agree = _loopy(e, mask, transitions, edges, self.skip, most_rounds=8)
            e = e.copy()
            np.add.at(e, (left[:, 0], left[:, 1]), messages[0])
            np.add.at(e, (right[:, 0], right[:, 1]), messages[1])
        belief, pair = _chain(e, mask, transitions, pairs=True)
        if apart:
            self._step_skip(gold, edges, agree, grad2_s)
            return
        gt = -pair
        flat_f, flat_g = [], []
        for i, (f, y) in enumerate(zip(feats, labels)):
            g = -belief[i, : lengths[i]]
            g[np.arange(lengths[i]), y] += 1
            np.add.at(gt, (y[:-1], y[1:]), 1)
            flat_f.append(f)
            flat_g.append(g)
        f = np.concatenate(flat_f)
        g = np.concatenate(flat_g).astype(np.float32)
        live = np.abs(g).max(1) > 1e-3
        f, g = f[live], g[live]
        if len(f):
            flat = f.ravel()
            ids = np.flatnonzero(np.bincount(flat, minlength=SIZE))
            total = np.empty((len(ids), K), np.float32)
            for k in range(K):
                total[:, k] = np.bincount(flat, np.repeat(g[:, k], f.shape[1]), SIZE)[ids]
            total -= decay * self.weights[ids]
            grad2_w[ids] += total**2
            self.weights[ids] += rate * total / np.sqrt(grad2_w[ids])
        grad2_t += (gt**2).astype(np.float32)
        self.transitions += (rate * gt / np.sqrt(grad2_t)).astype(np.float32)

    def _step_skip(self, gold: np.ndarray, edges: tuple, agree: np.ndarray | None, grad2_s: np.ndarray) -> None:
        left, right, sort = edges
        if not len(left):
            return
        gs = -1e-2 * self.skip
        np.add.at(gs, sort, -agree)
        yl, yr = gold[left[:, 0], left[:, 1]], gold[right[:, 0], right[:, 1]]
        same = yl == yr
        np.add.at(gs, (sort[same], yl[same]), 1.0)
        grad2_s += (gs**2).astype(np.float32)
        self.skip = self.skip + 0.25 * gs / np.sqrt(grad2_s)

    # Inference

    def beliefs(self, documents: list[tuple[list[str], list[str]]], skip: np.ndarray | None = None) -> list[np.ndarray]:
        """Label probabilities (n, K) of the tokens of each document."""
        skip = self.skip if skip is None else skip
        v = self.vocabulary
        if len(v.words) > 150_000 or self._fitted:  # weights may have changed, and memory has an end
            self.vocabulary, self._arrays, self._own, self._fitted = Vocabulary(), None, None, False
            v = self.vocabulary
        at = [v.sequence(f, c) for f, c in documents]
        out: list[np.ndarray | None] = [None] * len(documents)
        order = sorted(range(len(documents)), key=lambda i: len(at[i]))
        transitions = self.transitions.astype(float)
        start = 0
        while start < len(order):
            # As many documents as stay near 200,000 padded tokens; a single long one goes alone.
            end = start + 1
            while end < len(order) and (end + 1 - start) * len(at[order[end]]) <= 200_000:
                end += 1
            group = order[start:end]
            start = end
            lengths = [len(at[i]) for i in group]
            top = max(lengths)
            if top == 0:
                for i in group:
                    out[i] = np.zeros((0, K))
                continue
            e = np.zeros((len(group), top, K))
            mask = np.zeros((len(group), top), bool)
            for r, i in enumerate(group):
                x = np.concatenate([_PAD, at[i], _PAD])
                for a in range(0, lengths[r], 20_000):  # very long texts in slices, to bound memory
                    part = self.scores(x[a : a + 20_008])
                    e[r, a : a + len(part)] = part
                mask[r, : lengths[r]] = True
            belief, _, _ = _loopy(e, mask, transitions, _skip_edges([documents[i] for i in group]), skip)
            for r, i in enumerate(group):
                out[i] = belief[r, : lengths[r]]
        return out


def _loopy(e: np.ndarray, mask: np.ndarray, transitions: np.ndarray, edges: tuple, skip: np.ndarray, tolerance: float = 1e-3, most_rounds: int = 200) -> tuple[np.ndarray, tuple, np.ndarray]:
    """Beliefs of a batch of documents by chain passes and messages over all skip edges in turn, until no message of a document moves by tolerance; then its messages stay. Also the
    messages to either end of each edge, and how surely both ends of it bear each label.

    Where messages go round for ever, damping brings them to rest; most_rounds is a stop for the rest, far beyond what texts need.
    """
    left, right, sort = edges
    belief, _ = _chain(e, mask, transitions)
    to_left, to_right = np.zeros((len(left), K)), np.zeros((len(left), K))
    gain = np.expm1(skip[sort])
    active = np.arange(len(left))
    for round_ in range(most_rounds):
        if not len(active):
            break
        # Only documents whose messages still move are passed over.
        rows, at_row = np.unique(left[active, 0], return_inverse=True)
        at_row = at_row.ravel()
        top = int(mask[rows].sum(1).max())
        lc, rc = left[active, 1], right[active, 1]
        log_belief = np.log(belief[rows, :top] + 1e-30)
        new_right = _message(log_belief[at_row, lc] - to_left[active], gain[active])
        new_left = _message(log_belief[at_row, rc] - to_right[active], gain[active])
        keep = 0.0 if round_ < 3 else 0.5
        new_right = keep * to_right[active] + (1 - keep) * new_right
        new_left = keep * to_left[active] + (1 - keep) * new_left
        moved = np.maximum(np.abs(new_right - to_right[active]).max(1), np.abs(new_left - to_left[active]).max(1))
        to_right[active], to_left[active] = new_right, new_left
        now = e[rows, :top].copy()
        np.add.at(now, (at_row, lc), new_left)
        np.add.at(now, (at_row, rc), new_right)
        belief[rows, :top] = _chain(now, mask[rows, :top], transitions)[0]
        most = np.zeros(len(rows))
        np.maximum.at(most, at_row, moved)
        active = active[most[at_row] > tolerance]
    agree = np.zeros((len(left), K))
    if len(left):
        p = _normal(np.log(belief[left[:, 0], left[:, 1]] + 1e-30) - to_left)
        q = _normal(np.log(belief[right[:, 0], right[:, 1]] + 1e-30) - to_right)
        both = p * q
        agree = both * (gain + 1) / (1 + (both * gain).sum(1, keepdims=True))
    return belief, (to_left, to_right), agree


def _normal(log_p: np.ndarray) -> np.ndarray:
    p = np.exp(log_p - log_p.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _message(cavity: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Log message over an edge whose ends gain by equal labels."""
    return np.log(np.maximum(1.0 + gain * _normal(cavity), 1e-6))


def _skip_edges(group: list[tuple[list[str], list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (document, token) of successive like tokens, and the number of their likeness in LIKENESS."""
    left, right, sort = [], [], []
    for r, (forms, classes) in enumerate(group):
        last: dict[str, int] = {}
        high = {_stem(f) for f, c in zip(forms, classes) if c in ("TITLE", "UPPER") and len(f) > 1}
        runs: dict[str, int] = {}
        joined = -1
        words: dict[str, int] = {}
        for i, (f, c) in enumerate(zip(forms, classes)):
            if "㐀" <= f[0] <= "鿿":
                run = "".join(forms[i : i + 3])
                if len(run) == 3 and all("㐀" <= ch <= "鿿" for ch in run):
                    j = runs.get(run)
                    if j is not None:
                        for k in range(max(0, joined - i + 1), 3):  # each place once, although runs overlap
                            left.append((r, j + k))
                            right.append((r, i + k))
                            sort.append(2)
                        joined = i + 2
                    runs[run] = i
                continue
            kind = 0
            if c in ("TITLE", "UPPER", "LOWER"):
                key = _stem(f) if len(f) > 1 else ""
                if key not in high:
                    key = ""
                elif key not in words:
                    words[key] = i
            elif f[-1:].isdigit() or f[:1].isdigit():
                digits = "".join(ch for ch in f if ch.isdigit())
                key, kind = (digits if len(digits) > 4 else ""), 3
            else:
                key, kind = (f.lower() if c == "EMAIL" else ""), 4
            if key:
                j = last.get(key)
                if j is not None:
                    left.append((r, j))
                    right.append((r, i))
                    sort.append(kind)
                last[key] = i
        # Words one letter apart meet in what is left of them without a letter; the first places of both are linked.
        rests: dict[str, int] = {}
        linked: set[tuple[int, int]] = set()
        for w, i in words.items():
            if len(w) > 4:
                for rest in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
                    j = rests.setdefault(rest, i)
                    if j != i and (j, i) not in linked:
                        linked.add((j, i))
                        left.append((r, j))
                        right.append((r, i))
                        sort.append(1)
    return np.array(left, np.int64).reshape(-1, 2), np.array(right, np.int64).reshape(-1, 2), np.array(sort, np.int64)


def _stem(form: str) -> str:
    """A word in small letters without the ending of a possessive."""
    low = form.lower()
    return low[:-2] if low.endswith(("'s", "’s")) else low


#: Steps of the recursion from scaling to scaling.
_SCALE = 4


def _chain(e: np.ndarray, mask: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Beliefs of a batch of chains by the forward-backward recursion, and the summed pair beliefs. Padding is at the end."""
    n, top, _ = e.shape
    a = np.exp(transitions)
    # Time goes first in memory, as each step reads one time of all chains.
    x = np.exp(e - e.max(2, keepdims=True)).transpose(1, 0, 2).copy()
    live = mask.T.copy()
    x[~live] = 1.0
    alpha = np.empty_like(x)
    beta = np.empty_like(x)
    alpha[0] = x[0] / x[0].sum(1, keepdims=True)
    # Scaling now and then is enough: a step changes the scale by the transitions' range at most.
    for t in range(1, top):
        m = alpha[t - 1] @ a
        m *= x[t]
        if t % _SCALE == 0:
            m /= m.sum(1, keepdims=True)
        alpha[t] = m
    beta[top - 1] = 1.0
    back = a.T.copy()
    ends = ~live.all(1)
    for t in range(top - 2, -1, -1):
        m = (beta[t + 1] * x[t + 1]) @ back
        if t % _SCALE == 0:
            m /= m.sum(1, keepdims=True)
        if ends[t + 1]:
            m[~live[t + 1]] = 1.0
        beta[t] = m
    belief = alpha * beta
    belief /= belief.sum(2, keepdims=True)
    total = None
    if pairs:
        left = alpha[:-1][live[1:]]
        right = (x[1:] * beta[1:])[live[1:]]
        # Each pair's sum is left' a right, so the pairs add up in one product.
        total = a * ((left / np.einsum("ik,kl,il->i", left, a, right)[:, None]).T @ right)
    return belief.transpose(1, 0, 2), total
