"""A small causal self-attention model over subword ids, trained and applied in numpy.

Ids are leaves of a Huffman tree by their counts over the whole training corpus; the probability of an id is the
product of the turns on its path, each a logistic function of the context's vector, so every turn depends on the
ids before. The commonest ids have leaves of their own; the others share the last leaves by their counts.

Texts are covered by overlapping windows: each has WINDOW inputs, and the targets of the last STRIDE of them count.
So every id is scored, and trained on, once, with at least WINDOW - STRIDE ids before it where the text has them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: Leaves, those of one id among them; width, hidden width, window, and the step between windows.
LEAVES, OWN = 4096, 3584
#: Turns of a path that are worked out for all nodes at once; most paths have few more.
TOP = 6
WIDTH, HIDDEN, WINDOW, STRIDE = 16, 32, 32, 16
_F = np.float32
_FRESH = WINDOW - STRIDE  # the first place of a window whose target counts


def leaves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf of each id, log10 of its share of the leaf, and the leaves' weights; every id gets a share."""
    weight = counts + 0.05
    order = np.argsort(-weight, kind="stable")
    leaf = np.empty(len(counts), np.int32)
    leaf[order[:OWN]] = np.arange(len(order[:OWN]))
    rest = order[OWN:]
    if len(rest):
        mass = np.cumsum(weight[rest])
        leaf[rest] = OWN + np.minimum(LEAVES - OWN - 1, (mass / mass[-1] * (LEAVES - OWN) * (1 - 1e-12)).astype(np.int64))
    total = np.bincount(leaf, weight, LEAVES)
    return leaf, np.log10(weight / total[leaf]), total


class Tree:
    """Paths of leaves: turn i of leaf k is at ``node[start[k] + i]``, to the right where ``sign`` is 1, else -1.

    Paths are written from the leaf up. The TOP turns next to the root also stand in tables, a row a leaf: ``column``
    numbers the nodes ``top`` that they are at, with len(top) where a path is shorter. ``more`` turns of each are below.
    """

    def __init__(self, weight: np.ndarray):
        weight = np.maximum(weight, 1e-6)
        heap = [(w, k) for k, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        n = len(weight)
        up, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
        self.bias = np.zeros(n - 1, _F)
        for inner in range(n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[[i, j]], side[i], side[j] = n + inner, -1, 1
            self.bias[inner] = np.log(b / a)
            heapq.heappush(heap, (a + b, n + inner))
        at, paths = np.arange(n), []
        while (going := at < 2 * n - 2).any():
            paths.append((np.flatnonzero(going), up[at[going]] - n, side[at[going]]))
            at = np.where(going, up[at], at)
        k = np.concatenate([p[0] for p in paths])
        order = np.argsort(k, kind="stable")
        self.node = np.concatenate([p[1] for p in paths])[order].astype(np.int32)
        self.sign = np.concatenate([p[2] for p in paths])[order].astype(_F)
        self.size = np.bincount(k, minlength=n)
        self.start = np.cumsum(self.size) - self.size
        turn = np.repeat(self.start + self.size, self.size) - 1 - np.arange(len(k))  # paths are written from the leaf up
        early = np.flatnonzero(turn < TOP)
        self.top, number = np.unique(self.node[early], return_inverse=True)
        self.column, self.turn = np.full((n, TOP), len(self.top)), np.ones((n, TOP), _F)
        self.column[k[order][early], turn[early]] = number
        self.turn[k[order][early], turn[early]] = self.sign[early]
        self.more = np.maximum(self.size - TOP, 0)


def windows(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first target of each window, for texts of some sizes."""
    n = -(-size // STRIDE)
    text = np.repeat(np.arange(len(size)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


class Attention:
    """One block: leaf and place embeddings, causal self-attention, a hidden layer, turns in the tree."""

    def __init__(self, weight: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)

        def draw(*shape: int, scale: float = 1.0) -> np.ndarray:
            return (rng.standard_normal(shape) * scale / np.sqrt(shape[0])).astype(_F)

        self.tree = Tree(weight)
        n = len(weight)
        self.none = n  # input before a text begins
        self.p = {
            "e": (rng.standard_normal((n + 1, WIDTH)) * 0.3).astype(_F), "at": draw(WINDOW, WIDTH), "q": draw(WIDTH, WIDTH), "k": draw(WIDTH, WIDTH), "v": draw(WIDTH, WIDTH), "o": draw(WIDTH, WIDTH),
            "h": draw(WIDTH, HIDDEN), "hb": np.zeros(HIDDEN, _F), "u": draw(HIDDEN, WIDTH), "n": np.zeros((n - 1, WIDTH), _F), "nb": self.tree.bias.copy(),
        }

    def inputs(self, text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Batches of windows over the texts text[start:stop] of leaves: inputs, which of them are there, places of the
        targets in ``text``, and which targets are there."""
        doc, first = windows(stop - start)
        for i in range(0, len(doc), 256):
            begin, d = first[i : i + 256, None], doc[i : i + 256]
            place = begin + np.arange(WINDOW) - _FRESH  # of the target beside each input
            there = (place >= 0) & (place < (stop - start)[d, None])
            at = np.minimum(start[d, None] + np.maximum(place, 0), len(text) - 1)
            yield np.where(place > 0, text[np.maximum(at - 1, 0)], self.none), there, at[:, _FRESH:], there[:, _FRESH:]

    def forward(self, x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Context vectors of the last STRIDE places of windows (windows, WINDOW).

        Queries meet keys, and values the output, by the products of their matrices: inputs need no keys or values of their own.
        """
        p, m = self.p, len(x)
        z = p["e"].take(x, 0)
        z += p["at"]
        late = np.ascontiguousarray(z[:, _FRESH:]).reshape(-1, WIDTH)
        qk, vo = (p["q"] @ p["k"].T) * _F(WIDTH**-0.5), p["v"] @ p["o"]
        q = (late @ qk).reshape(m, STRIDE, WIDTH)
        s = q @ z.transpose(0, 2, 1)
        if max(s.max(initial=0), -s.min(initial=0)) > 40:  # beyond that, exponentials are taken from the largest that is seen
            s -= np.where(self._seen(there), s, _F(-np.inf)).max(2, keepdims=True)
            np.clip(s, -30, 0, out=s)  # tiny numbers are slow to work with
        np.exp(s, out=s)
        # a place sees itself and what is before it; its own input is always seen
        s *= _PAST if there[:, :_FRESH].all() else self._seen(there)
        s *= 1 / (s.reshape(-1, WINDOW) @ np.ones(WINDOW, _F)).reshape(m, STRIDE, 1)
        c = (s @ z).reshape(-1, WIDTH)
        y = c @ vo
        y += late
        h = y @ p["h"]
        h += p["hb"]
        np.maximum(h, 0, out=h)
        r = h @ p["u"]
        r += y
        return r, (z, late, qk, vo, q, s, c, y, h)

    @staticmethod
    def _seen(there: np.ndarray) -> np.ndarray:
        """Which inputs each of the last STRIDE places sees."""
        return _PAST.astype(bool) & (there | (np.arange(WINDOW) >= _FRESH))[:, None]

    def first_turns(self, r: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """The TOP turns next to the root on the way to each target: weights of the top nodes, where turns are among rows times nodes, signs,
        signed logits. A turn that a path lacks has probability one."""
        of = np.vstack([self.p["n"][self.tree.top], np.zeros((1, WIDTH), _F)])
        logits = r @ of.T
        logits += np.append(self.p["nb"][self.tree.top], _F(60))
        at = self.tree.column.take(target, 0)
        at += np.arange(len(target))[:, None] * len(of)
        sign = self.tree.turn.take(target, 0)
        t = logits.ravel().take(at)
        t *= sign
        return of, at, sign, np.clip(t, -60, 60, out=t)

    def turns(self, r: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """The turns below those, of the targets that have more: which those are, nodes, signs, where they begin, vectors
        of nodes and rows, signed logits."""
        some = np.flatnonzero(self.tree.more.take(target))
        target = target[some]
        size = self.tree.more[target]
        stop = np.cumsum(size)
        first = stop - size
        row = np.repeat(np.arange(len(target)), size)
        at = np.arange(stop[-1] if len(stop) else 0) + (self.tree.start[target] - first)[row]
        node, sign = self.tree.node[at], self.tree.sign[at]
        of, mine = self.p["n"].take(node, 0), r.take(some[row], 0)
        t = np.einsum("pd,pd->p", of, mine)
        t += self.p["nb"][node]
        t *= sign
        return some, node, sign, first, of, mine, np.clip(t, -60, 60, out=t)

    def loss(self, x: np.ndarray, there: np.ndarray, target: np.ndarray, counts: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy in nats of the targets that count, and its gradients."""
        p = self.p
        r, (z, late, qk, vo, q, s, c, y, h) = self.forward(x, there)
        rows = np.flatnonzero(counts)
        scored, goal, n = r.take(rows, 0), target.ravel().take(rows), _F(max(1, len(rows)))
        top, at, sign, t = self.first_turns(scored, goal)
        odds = np.exp(-t)
        value = np.log(1 + odds).sum(dtype=np.float64)
        g: dict[str, np.ndarray] = {}
        d = np.zeros((len(rows), len(top)), _F)
        d.ravel()[at] = -sign * odds / (1 + odds) / n
        some, node, sign, first, of, mine, t = self.turns(scored, goal)
        odds = np.exp(-t)
        value += np.log(1 + odds).sum(dtype=np.float64)
        deep = -sign * odds / (1 + odds) / n
        mine *= deep[:, None]
        of *= deep[:, None]
        g["n"] = _scatter(node, mine, len(p["n"]))
        g["nb"] = np.bincount(node, deep, len(p["nb"])).astype(_F)
        g["n"][self.tree.top] += (d.T @ scored)[:-1]
        g["nb"][self.tree.top] += (np.ones(len(rows), _F) @ d)[:-1]
        own = d @ top
        own[some] += _by_run(of, first)
        dr = np.zeros_like(r)
        dr[rows] = own
        g["u"] = h.T @ dr
        dh = dr @ p["u"].T
        dh *= h > 0
        g["h"], g["hb"] = y.T @ dh, np.ones(len(dh), _F) @ dh
        dy = dh @ p["h"].T
        dy += dr
        dvo = c.T @ dy
        g["v"], g["o"] = dvo @ p["o"].T, p["v"].T @ dvo
        dc = (dy @ vo.T).reshape(q.shape)
        ds = dc @ z.transpose(0, 2, 1)
        ds -= np.einsum("pd,pd->p", dc.reshape(-1, WIDTH), c).reshape(len(q), STRIDE, 1)
        ds *= s
        dq = (ds @ z).reshape(-1, WIDTH)
        dqk = late.T @ dq * _F(WIDTH**-0.5)
        g["q"], g["k"] = dqk @ p["k"], dqk.T @ p["q"]
        dy += dq @ qk.T
        dz = s.transpose(0, 2, 1) @ dc
        dz += ds.transpose(0, 2, 1) @ q
        dz[:, _FRESH:] += dy.reshape(q.shape)
        g["at"] = dz.sum(0)
        g["e"] = _scatter(x.ravel(), dz.reshape(-1, WIDTH), len(p["e"]))
        return float(value / n), g

    def train(self, batches: Iterator[tuple[np.ndarray, ...]], steps: int, rate: float) -> None:
        """A step of Adam for each batch (inputs, there, targets, which count); the rate falls over ``steps``."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step, batch in enumerate(batches, 1):
            _, grad = self.loss(*batch)
            now = rate * min(1.0, step / 50) * max(0.02, 1 - step / (steps + 1)) ** 0.5
            now *= (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
            for name, g in grad.items():
                a, b = first[name], second[name]
                a += _F(0.1) * (g - a)
                g *= g
                g -= b
                g *= _F(0.01)
                b += g
                np.sqrt(b, out=g)
                g += _F(1e-8)
                np.divide(a, g, out=g)
                g *= _F(now)
                self.p[name] -= g

    def log10(self, text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """log10 probability of each leaf of the texts text[start:stop], which make up ``text``."""
        out, one = np.zeros(len(text), _F), np.ones(TOP, _F)
        for x, there, at, counts in self.inputs(text, start, stop):
            r, _ = self.forward(x, there)
            rows = np.flatnonzero(counts)
            where = at.ravel().take(rows)
            scored, goal = r.take(rows, 0), text.take(where)
            own = np.log(1 + np.exp(-self.first_turns(scored, goal)[-1])) @ one
            some, _, _, first, _, _, t = self.turns(scored, goal)
            if len(some):
                own[some] += np.add.reduceat(np.log1p(np.exp(-t)), first)
            out[where] = own
        return out * _F(-1 / np.log(10))


_PAST = (np.arange(WINDOW) <= np.arange(STRIDE)[:, None] + _FRESH).astype(_F)


def _by_run(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of rows that begin at ``first``; runs are few rows long."""
    size = np.diff(np.append(first, len(rows)))
    out = rows.take(first, 0)
    for i in range(1, int(size.max(initial=0))):
        longer = np.flatnonzero(size > i)
        out[longer] += rows.take(first[longer] + i, 0)
    return out


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by place, of n places."""
    out = np.zeros((n, rows.shape[1]), _F)
    order = np.argsort(at.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")  # short integers sort by digits
    at = at.take(order)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    if len(first):
        out[at[first]] = np.add.reduceat(rows.take(order, 0), first)
    return out
