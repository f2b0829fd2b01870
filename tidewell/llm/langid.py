"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Every byte of a text gets a distribution over the languages; a document's distribution is their mean.  Texts are read in
windows of ``WINDOW`` bytes, each with a state of its own in both directions, so that windows of many documents run side
by side.  Gates are hard sigmoids and candidates soft signs: piecewise rational functions, in training as in use.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.textmodel import held_out

WINDOW = 64
HIDDEN = 8
_SIDE = 4096  # windows that run side by side


class ByteGru:
    """Parameters: for each direction x (256, 3H) input table, u (H, 3H) recurrent; w (2H, C), b (C) output."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        f = np.float32
        self.p = {"w": rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(f), "b": np.zeros(len(langs), f)}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.5, (256, 3 * hidden)).astype(f)
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(f)
        self.rng = rng

    # -- training -------------------------------------------------------------------------------------------------

    def _forward(self, t: np.ndarray, d: str):
        """States over the steps of ``t`` (steps, n) and what backpropagation needs."""
        h_n, x, u = self.h, self.p["x" + d], self.p["u" + d]
        h = np.zeros((t.shape[1], h_n), np.float32)
        kept = []
        for row in t:
            a, hu = x[row], h @ u
            g = np.clip(0.25 * (a[:, : 2 * h_n] + hu[:, : 2 * h_n]) + 0.5, 0, 1)
            z, r, m = g[:, :h_n], g[:, h_n:], hu[:, 2 * h_n :]
            s = a[:, 2 * h_n :] + r * m
            c = s / (1 + np.abs(s))
            new = h + z * (c - h)
            kept.append((h, g, m, s, c))
            h = new
        return np.stack([h_ for h_, *_ in kept[1:]] + [h]), kept

    def _backward(self, t: np.ndarray, d: str, kept, dh_out: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        h_n, u = self.h, self.p["u" + d]
        gx, gu = np.zeros_like(self.p["x" + d]), np.zeros_like(u)
        dh = np.zeros_like(dh_out[0])
        for k in range(len(t) - 1, -1, -1):
            h, g, m, s, c = kept[k]
            dh = dh + dh_out[k]
            z, r = g[:, :h_n], g[:, h_n:]
            dc, dz = dh * z, dh * (c - h)
            ds = dc / (1 + np.abs(s)) ** 2
            dg = np.concatenate([dz, ds * m], 1) * (0.25 * ((g > 0) & (g < 1)))
            da = np.concatenate([dg, ds], 1)
            dhu = np.concatenate([dg, ds * r], 1)
            gu += h.T @ dhu
            order = np.argsort(t[k], kind="stable")
            rows, starts = np.unique(t[k][order], return_index=True)
            gx[rows] += np.add.reduceat(da[order], starts, axis=0)
            dh = dh * (1 - z) + dhu @ u.T
        grads["x" + d], grads["u" + d] = gx, gu

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 350, batch: int = 192, rate: float = 0.02) -> ByteGru:
        """Adam on cross-entropy at every position; ``windows`` (n, steps) bytes, ``labels`` positions in ``langs``."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = self.rng.integers(0, len(windows), batch)
            t, y = windows[pick].T, labels[pick]
            hf, kf = self._forward(t, "f")
            hb, kb = self._forward(t[::-1], "b")
            both = np.concatenate([hf, hb[::-1]], 2)
            z = both @ self.p["w"] + self.p["b"]
            z -= z.max(2, keepdims=True)
            p = np.exp(z)
            p /= p.sum(2, keepdims=True)
            p[:, np.arange(len(y)), y] -= 1
            p /= p.shape[0] * p.shape[1]
            grads = {"w": np.einsum("tnh,tnc->hc", both, p), "b": p.sum((0, 1))}
            back = p @ self.p["w"].T
            self._backward(t, "f", kf, back[:, :, : self.h], grads)
            self._backward(t[::-1], "b", kb, back[::-1, :, self.h :], grads)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 1 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    # -- use ------------------------------------------------------------------------------------------------------

    def _scaled(self, d: str) -> tuple[np.ndarray, np.ndarray]:
        """Tables with the gates' slope and offset folded in."""
        x, u, g = self.p["x" + d].copy(), self.p["u" + d].copy(), 2 * self.h
        x[:, :g] = 0.25 * x[:, :g] + 0.5
        u[:, :g] *= 0.25
        return np.ascontiguousarray(x), np.ascontiguousarray(u)

    def _states(self, t: np.ndarray, d: str, out: np.ndarray) -> None:
        """As ``_forward``, into ``out`` (steps, n, H), without allocations in the loop."""
        x, u = self._scaled(d)
        n, h_n = t.shape[1], self.h
        h, zero = np.zeros((n, h_n), np.float32), None
        a, hu = np.empty((n, 3 * h_n), np.float32), np.empty((n, 3 * h_n), np.float32)
        g, s, q = np.empty((n, 2 * h_n), np.float32), np.empty((n, h_n), np.float32), np.empty((n, h_n), np.float32)
        for k in range(len(t)):
            np.take(x, t[k], axis=0, out=a, mode="clip")
            np.matmul(h, u, out=hu)
            np.add(a[:, : 2 * h_n], hu[:, : 2 * h_n], out=g)
            np.minimum(g, 1, out=g)
            np.maximum(g, 0, out=g)
            np.multiply(g[:, h_n:], hu[:, 2 * h_n :], out=s)
            np.add(s, a[:, 2 * h_n :], out=s)
            np.abs(s, out=q)
            np.add(q, 1, out=q)
            np.divide(s, q, out=s)
            np.subtract(s, h, out=s)
            np.multiply(s, g[:, :h_n], out=s)
            np.add(h, s, out=out[k])
            h = out[k]

    def window_sums(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over the first ``lengths`` positions of each window of the positions' distributions: (n, C)."""
        out = np.zeros((len(windows), len(self.langs)), np.float32)
        for i in range(0, len(windows), _SIDE):
            part, size = windows[i : i + _SIDE], lengths[i : i + _SIDE]
            order = np.argsort(-size, kind="stable")  # padding lies in the last windows only
            part, size = part[order], size[order]
            steps, n = part.shape[1], len(part)
            t = np.ascontiguousarray(part.T).astype(np.intp)
            hf, hb = np.empty((steps, n, self.h), np.float32), np.empty((steps, n, self.h), np.float32)
            self._states(t, "f", hf)
            self._states(np.ascontiguousarray(t[::-1]), "b", hb)
            wf, wb, sums = np.ascontiguousarray(self.p["w"][: self.h]), np.ascontiguousarray(self.p["w"][self.h :]), np.zeros((n, len(self.langs)), np.float32)
            for k in range(steps):
                m = int(np.searchsorted(-size, -k, side="left"))  # windows longer than k
                if not m:
                    break
                z = hf[k, :m] @ wf
                z += hb[steps - 1 - k, :m] @ wb
                z += self.p["b"]
                np.minimum(z, 60, out=z)
                np.exp(z, out=z)
                z /= z @ np.ones((z.shape[1], 1), np.float32)
                sums[:m] += z
            out[i + order] = sums
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[int, float]]:
        """Position in ``langs`` and probability for each text; (-1, 0.0) for one without bytes."""
        sizes = np.array([len(t) for t in texts], np.int64)
        n_win = -(-sizes // WINDOW)
        flat = np.zeros(int(n_win.sum()) * WINDOW, np.uint8)
        starts = np.concatenate([[0], np.cumsum(n_win)])
        lengths = np.full(int(n_win.sum()), WINDOW, np.int64)
        for text, at, n in zip(texts, starts, n_win):
            if n:
                flat[at * WINDOW : at * WINDOW + len(text)] = np.frombuffer(text, np.uint8)
                lengths[at + n - 1] = len(text) - (n - 1) * WINDOW
        sums = self.window_sums(flat.reshape(-1, WINDOW), lengths)
        out = []
        for k, size in enumerate(sizes):
            if not size:
                out.append((-1, 0.0))
                continue
            p = sums[starts[k] : starts[k + 1]].sum(0, dtype=np.float64) / size
            best = int(p.argmax())
            out.append((best, float(min(1.0, max(0.0, p[best])))))
        return out


def train_language_id(docs: DataFrame, per_lang: int = 120, windows_per_doc: int = 8, max_docs: int = 4000, steps: int = 350, seed: int = 3) -> ByteGru | None:
    """A network learnt from at most ``per_lang`` documents of each language and ``max_docs`` in all.

    Only text and lang of documents outside the held-out fold are read.  Windows lie anywhere in the whole text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_t"), F.col("lang").cast("string").alias("_l"), held_out(F.col("doc_id")).alias("_h"))
    rows = rows.where("not _h and _t is not null and _l is not null and length(_t) > 0")
    rank = F.row_number().over(Window.partitionBy("_l").orderBy(F.xxhash64("_id"), "_id"))
    ids = rows.select("_id", "_l").withColumn("_n", rank).where(F.col("_n") <= per_lang).orderBy("_n", "_l").limit(max_docs)
    chosen = ids.select(F.col("_id").alias("_c")).distinct()
    sample = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_c")).select("_id", "_l", F.col("_t")).toArrow().to_pylist()  # max_docs ids bound the broadcast
    if not sample:
        return None
    sample.sort(key=lambda r: (r["_id"], r["_l"], r["_t"]))
    langs = sorted({r["_l"] for r in sample[:max_docs]})
    rng = np.random.default_rng(seed)
    by_lang: list[list[np.ndarray]] = [[] for _ in langs]
    for r in sample[:max_docs]:
        data = np.frombuffer(r["_t"].encode("utf-8", "replace"), np.uint8)
        if len(data) < WINDOW:
            data = np.resize(np.concatenate([data, [32]]), WINDOW)
        starts = rng.integers(0, len(data) - WINDOW + 1, windows_per_doc)
        by_lang[langs.index(r["_l"])] += [data[s : s + WINDOW] for s in starts]
    most = max(map(len, by_lang))
    windows = np.stack([w for ws in by_lang for w in (ws[i] for i in rng.integers(0, len(ws), most))])  # languages weigh the same
    return ByteGru(langs, seed=seed).fit(windows, np.repeat(np.arange(len(langs)), most), steps)


def language_id(docs: DataFrame, **training) -> DataFrame:
    """Predicts every whole text's language: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 if the text is null, empty or has no letter, or if there is nothing to learn from.  Rows map one
    to one, so repeated rows stay; an empty table gives no rows; other columns are ignored.  The network (some 60 kB) is
    broadcast; prediction is one pass without a shuffle.
    """
    model = train_language_id(docs, **training)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id"), F.when(F.col("text").cast("string").rlike(r"\p{L}"), F.col("text").cast("string")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        net = shared.value
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                texts = [(t.as_py() or "").encode("utf-8", "replace") if net else b"" for t in part.column(1)]
                found = net.predict(texts) if net else [(-1, 0.0)] * len(texts)
                names = [net.langs[k] if k >= 0 else "und" for k, _ in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
