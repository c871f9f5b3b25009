"""A byte-level convolutional network in numpy: training on the driver, scoring of Arrow batches.

Filters of several widths slide over the raw UTF-8 bytes. A filter of width w is w tables of 256
weights, one for each place in the filter, so its response is a sum of w looked-up numbers. Responses
are max-pooled over windows of a fixed length, shifted, cut at zero, and a text's windows are averaged
and maximised before one linear layer. Windows look ahead past their end, so no response is lost
between two of them: every byte of a text counts, whatever its length.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a window.
WINDOW = 256
#: Even widths, for two neighbouring bytes are looked up at once.
WIDTHS = (2, 4, 6)
FILTERS = 16
AHEAD = max(WIDTHS) - 1
#: Windows that are scored at once.
BLOCK = 4096


class ByteCNN:
    """tables[w]: (w, 256, FILTERS); shift: of each filter; linear: (2 * features, classes)."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = {w: (rng.standard_normal((w, 256, FILTERS)) * 0.5 / np.sqrt(w)).astype(np.float32) for w in WIDTHS}
        n = FILTERS * len(WIDTHS)
        self.shift = np.full(n, -0.3, np.float32)
        self.linear = (rng.standard_normal((2 * n, classes)) * 0.05).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    # ------------------------------------------------------------- scoring
    def pairs(self) -> list[list[np.ndarray]]:
        """For each width the tables of two neighbouring bytes: 65,536 rows of FILTERS weights."""
        return [[(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65_536, FILTERS) for j in range(0, w, 2)] for w, t in self.tables.items()]

    def pooled(self, windows: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        """Features of windows (n, WINDOW + AHEAD): shifted maxima, cut at zero."""
        out = np.empty((len(windows), FILTERS * len(WIDTHS)), np.float32)
        for at in range(0, len(windows), BLOCK):
            x = np.ascontiguousarray(windows[at : at + BLOCK].T).astype(np.intp)
            two = x[:-1] * 256 + x[1:]
            n = two.shape[1]
            best = np.full((len(WIDTHS), n, FILTERS), -np.inf, np.float32)
            response, part = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.float32)
            for t in range(WINDOW):
                for k, tables in enumerate(pairs):
                    np.take(tables[0], two[t], axis=0, out=response, mode="clip")
                    for j in range(1, len(tables)):
                        np.take(tables[j], two[t + 2 * j], axis=0, out=part, mode="clip")
                        response += part
                    np.maximum(best[k], response, out=best[k])
            out[at : at + n] = best.transpose(1, 0, 2).reshape(n, -1)
        return np.maximum(out + self.shift, 0)

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.linear + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    # ------------------------------------------------------------- training
    def fit(self, windows: np.ndarray, doc: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.01, seed: int = 11, chunk: int = 1) -> None:
        """Adam on the cross entropy of what ``text_features`` gives with ``chunk``. doc: the text of each window, ascending; labels and weights: of texts."""
        rng = np.random.default_rng(seed)
        firsts = np.searchsorted(doc, np.arange(len(labels) + 1))
        params = [*self.tables.values(), self.shift, self.linear, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                chosen = np.sort(order[at : at + batch])
                rows = np.concatenate([np.arange(firsts[d], firsts[d + 1]) for d in chosen])
                own = np.repeat(np.arange(len(chosen)), np.diff(firsts)[chosen])
                gradients = self._gradients(windows[rows], own, labels[chosen], weights[chosen], chunk)
                step += 1
                pace = rate * (1 - 0.9 * epoch / epochs)
                for p, g, (m, v) in zip(params, gradients, moments, strict=True):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    p -= (pace / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, windows: np.ndarray, own: np.ndarray, labels: np.ndarray, weights: np.ndarray, chunk: int = 1) -> list[np.ndarray]:
        x = np.ascontiguousarray(windows.T).astype(np.intp)
        n = x.shape[1]
        values, places = [], []
        for w, table in self.tables.items():
            best, place = np.full((n, FILTERS), -np.inf, np.float32), np.zeros((n, FILTERS), np.int32)
            for t in range(WINDOW):
                response = table[0][x[t]]
                for j in range(1, w):
                    response += table[j][x[t + j]]
                np.copyto(place, t, where=response > best)
                np.maximum(best, response, out=best)
            # A chunk's maximum is that of its windows; it is learned from the window that has it.
            alone, at, window = best.copy(), place.copy(), np.repeat(np.arange(n)[:, None], FILTERS, axis=1)
            for k in range(1, min(chunk, n)):
                higher = (alone[k:] > best[:-k]) & (own[k:] == own[:-k])[:, None]
                np.copyto(best[:-k], alone[k:], where=higher)
                np.copyto(place[:-k], at[k:], where=higher)
                np.copyto(window[:-k], np.arange(k, n)[:, None], where=higher)
            values.append(best)
            places.append((place, window))
        raw = np.concatenate(values, axis=1) + self.shift
        active = np.maximum(raw, 0)
        firsts = np.searchsorted(own, np.arange(len(labels)))
        sizes = np.bincount(own, minlength=len(labels)).astype(np.float32)
        mean = np.add.reduceat(active, firsts, axis=0) / sizes[:, None]
        most = np.maximum.reduceat(active, firsts, axis=0)
        features = np.concatenate([mean, most], axis=1)
        p = self.probabilities(features)
        p[np.arange(len(labels)), labels] -= 1
        p *= (weights / weights.sum())[:, None]
        linear, bias = features.T @ p + 1e-4 * self.linear, p.sum(axis=0)
        back = p @ self.linear.T
        half = back.shape[1] // 2
        g = (back[:, :half] / sizes[:, None])[own]
        top = active == most[own]
        top &= active > 0
        share = np.add.reduceat(top.astype(np.float32), firsts, axis=0)
        g = g + top * (back[:, half:] / np.maximum(share, 1))[own]
        g = np.where(raw > 0, g, 0).astype(np.float32)
        out = []
        columns = np.arange(FILTERS)
        for k, (w, (place, window)) in enumerate(zip(self.tables, places, strict=True)):
            mine = g[:, k * FILTERS : (k + 1) * FILTERS]
            table = np.empty((w, 256, FILTERS), np.float32)
            for j in range(w):
                byte = x[place + j, window]
                table[j] = np.bincount((byte * FILTERS + columns).ravel(), weights=mine.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            out.append(table)
        return [*out, g.sum(axis=0), linear, bias]


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts, zero-padded, and the text of each; an empty text has one empty window."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // WINDOW))
    doc = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][doc] + number * WINDOW
    at = starts[:, None] + np.arange(WINDOW + AHEAD)
    inside = at < offsets[1:][doc][:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.minimum(at, len(data))], 0).astype(np.uint8), doc


def text_features(model: ByteCNN, pairs, data: np.ndarray, offsets: np.ndarray, chunk: int = 1) -> np.ndarray:
    """Mean and maximum over a text's chunks, each of ``chunk`` consecutive windows (overlapping if over 1)."""
    windows, doc = windows_of(data, offsets)
    pooled = model.pooled(windows, pairs)
    if chunk > 1 and len(doc) > 1:  # a chunk's maximum is that of its windows; the last chunks of a text are shorter
        together = pooled.copy()
        for k in range(1, chunk):
            same = doc[k:] == doc[:-k]
            together[:-k][same] = np.maximum(together[:-k][same], pooled[k:][same])
        pooled = together
    firsts = np.searchsorted(doc, np.arange(len(offsets) - 1))
    mean = np.add.reduceat(pooled, firsts, axis=0) / np.diff(np.append(firsts, len(doc)))[:, None]
    return np.concatenate([mean, np.maximum.reduceat(pooled, firsts, axis=0)], axis=1)
