"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``STEPS`` positions, and all
windows of a batch run through the network at once: one gated recurrent layer
reads forwards and one backwards, and a softmax over both states labels every
position. A document's probability of a language is the mean over all its
positions that carry a letter's bytes, so whole texts count.

Training is plain numpy: cross entropy of all positions, gradients by
backpropagation through time over the window, Adam. It uses at most
``TRAIN_ROWS`` labelled rows for each language, chosen by a hash, and of the
windows of their whole texts at most ``TRAIN_WINDOWS`` for each language, chosen
by a hash as well; every other step covers all rows. Rows are ranked in one
scan, of which a task keeps the first of each language, and fetched in another.

Cases: a null text, and one without letters, is ``und`` with score 0. A null
language teaches nothing. If no row teaches, every text is ``und``. Repeated
rows get equal results; other columns are ignored, and an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import tune, unused

STEPS = 96
HIDDEN = 8
TRAIN_ROWS = 240
TRAIN_WINDOWS = 1200
EPOCHS = 4
#: Gradient steps at least; small samples are read more often.
LEAST_STEPS = 150
BATCH = 128
WINDOWS = 2048
UNKNOWN = "und"


@dataclass
class Gru:
    """Weights of one direction: input table for each byte, recurrent matrix, recurrent bias of the candidate."""

    table: np.ndarray  # (257, 3H): reset, update, candidate; row 256 is padding
    rec: np.ndarray  # (H, 3H)
    bias: np.ndarray  # (H,)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru_forward(g: Gru, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (steps, n, H) of byte windows x (steps, n), and what backpropagation needs."""
    steps, n = x.shape
    h = np.zeros((n, g.rec.shape[0]), np.float32)
    size = h.shape[1]
    out = np.empty((steps, n, size), np.float32)
    kept = []
    for t in range(steps):
        a = g.table[x[t]]
        m = h @ g.rec
        gates = a[:, : 2 * size] + m[:, : 2 * size]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        r, z = gates[:, :size], gates[:, size:]
        q = m[:, 2 * size :] + g.bias
        c = np.tanh(a[:, 2 * size :] + r * q)
        new = c + z * (h - c)
        if keep:
            kept.append((h, r, z, c, q))
        out[t] = h = new
    return out, kept


def gru_states(g: Gru, x: np.ndarray) -> np.ndarray:
    """The states of gru_forward, faster: sigmoids as scaled tanh, one array for each gate."""
    steps, n = x.shape
    size = g.rec.shape[0]
    half = np.float32(0.5)
    tables = [np.ascontiguousarray(g.table[:, i * size : (i + 1) * size]) * (half if i < 2 else 1) for i in range(3)]
    recs = [np.ascontiguousarray(g.rec[:, i * size : (i + 1) * size]) * half for i in range(3)]
    bias = g.bias * half
    out = np.empty((steps, n, size), np.float32)
    h = np.zeros((n, size), np.float32)
    r, z, c, m = (np.empty_like(h) for _ in range(4))
    for t in range(steps):
        own = x[t]
        for gate, i in ((r, 0), (z, 1)):
            np.take(tables[i], own, axis=0, out=gate, mode="clip")
            gate += np.dot(h, recs[i], out=m)
            np.tanh(gate, out=gate)
        np.dot(h, recs[2], out=m)
        m += bias
        r += 1
        r *= m
        np.take(tables[2], own, axis=0, out=c, mode="clip")
        c += r
        np.tanh(c, out=c)
        new = out[t]
        np.subtract(h, c, out=new)
        new *= z
        new += h
        new += c
        new *= half
        h = new
    return out


def gru_backward(g: Gru, x: np.ndarray, kept: list, d_out: np.ndarray) -> Gru:
    """Gradients of the weights, given those of the states, back through all steps."""
    size = g.rec.shape[0]
    grad = Gru(np.zeros_like(g.table), np.zeros_like(g.rec), np.zeros_like(g.bias))
    dh = np.zeros_like(d_out[0])
    for t in range(len(x) - 1, -1, -1):
        h, r, z, c, q = kept[t]
        dh = dh + d_out[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * q * r * (1 - r)
        dq = dc * r
        da = np.concatenate([dr, dz, dc], 1)
        dm = np.concatenate([dr, dz, dq], 1)
        np.add.at(grad.table, x[t], da)
        grad.rec += h.T @ dm
        grad.bias += dq.sum(0)
        dh = dh * z + dm @ g.rec.T
    assert size == g.bias.shape[0]
    return grad


class ByteLanguageModel:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        one = lambda: Gru((rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32), small(hidden, 3 * hidden), np.zeros(hidden, np.float32))
        self.fore, self.back = one(), one()
        self.out = small(2 * hidden, len(langs))
        self.out_bias = np.zeros(len(langs), np.float32)

    def _params(self) -> list[np.ndarray]:
        return [*vars(self.fore).values(), *vars(self.back).values(), self.out, self.out_bias]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (steps, n, languages) of byte windows x (steps, n)."""
        s = self._scores(x)
        return s / s.sum(2, keepdims=True)

    def _scores(self, x: np.ndarray) -> np.ndarray:
        """Exponentials of the label scores; states lie in (-1, 1), so none overflows."""
        f, b = gru_states(self.fore, x), gru_states(self.back, x[::-1])
        half = f.shape[2]
        flat = f.reshape(-1, half) @ self.out[:half]
        flat += (b[::-1].reshape(-1, half)) @ self.out[half:]
        flat += self.out_bias
        np.exp(flat, out=flat)
        return flat.reshape(*x.shape, -1)

    def pooled(self, x: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """(n, languages) sums of the label probabilities over positions with a letter."""
        e = self._scores(x)
        share = letter / (e.reshape(-1, e.shape[2]) @ np.ones(e.shape[2], np.float32)).reshape(x.shape)
        return np.einsum("snl,sn->nl", e, share)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over real positions and its gradients."""
        f, kf = gru_forward(self.fore, x, True)
        b, kb = gru_forward(self.back, x[::-1], True)
        both = np.concatenate([f, b[::-1]], 2)
        s = both @ self.out + self.out_bias
        s -= s.max(2, keepdims=True)
        p = np.exp(s)
        p /= p.sum(2, keepdims=True)
        real = (x < 256).astype(np.float32)[:, :, None]
        n = max(1.0, real.sum())
        right = np.take_along_axis(p, np.broadcast_to(label[None, :, None], (*x.shape, 1)), 2)
        loss = float(-(np.log(right + 1e-9) * real).sum() / n)
        d = p
        np.put_along_axis(d, np.broadcast_to(label[None, :, None], (*x.shape, 1)), right - 1, 2)
        d = (d * (real / n)).astype(np.float32)
        half = f.shape[2]
        back = d @ self.out.T
        gf = gru_backward(self.fore, x, kf, back[:, :, :half])
        gb = gru_backward(self.back, x[::-1], kb, np.ascontiguousarray(back[::-1, :, half:]))
        flat = both.reshape(-1, 2 * half)
        return loss, [*vars(gf).values(), *vars(gb).values(), flat.T @ d.reshape(-1, d.shape[2]), d.sum((0, 1))]

    def fit(self, windows: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 6) -> None:
        """Adam over shuffled batches of windows (n, steps)."""
        rng = np.random.default_rng(seed)
        epochs = max(epochs, -(-LEAST_STEPS // -(-len(windows) // BATCH)))
        params = self._params()
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, total = 0, max(1, epochs * -(-len(windows) // BATCH))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                _, grads = self.gradients(np.ascontiguousarray(windows[own].T), label[own])
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                lr = rate * (1 - step / (total + 1))
                for p, g, a, b in zip(params, grads, m, v):
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(n, languages) pooled probabilities of whole texts."""
        sizes = np.array([len(t) for t in texts])
        n_win = -(-sizes // STEPS)
        owner = np.repeat(np.arange(len(texts)), n_win)
        out = np.zeros((len(texts), len(self.langs)))
        weight = np.zeros(len(texts))
        joined = np.frombuffer(b"".join(t.ljust(int(k) * STEPS, b"\0") for t, k in zip(texts, n_win)), np.uint8).reshape(-1, STEPS)
        for at in range(0, len(joined), WINDOWS):
            x = joined[at : at + WINDOWS]
            own = owner[at : at + WINDOWS]
            x = np.where(x == 0, np.int64(256), x).T
            x = np.ascontiguousarray(x)
            low = x | 32
            letter = (((low >= 97) & (low <= 122)) | (x >= 128)) & (x < 256)
            np.add.at(out, own, self.pooled(x, letter.astype(np.float32)))
            np.add.at(weight, own, letter.sum(0))
        return out / np.maximum(weight, 1)[:, None]


def train(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", rows_each: int = TRAIN_ROWS, windows_each: int = TRAIN_WINDOWS) -> ByteLanguageModel | None:
    """Fit on at most ``windows_each`` windows of at most ``rows_each`` rows of each language; the driver holds those windows."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id_col), F.lit(3)).alias("h"), F.xxhash64(F.col(text)).alias("t"))
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    first = lambda n, *by: F.row_number().over(Window.partitionBy("lang").orderBy(*by)) <= n
    picked = usable.select("lang", "h", "t").withColumn("in", first(rows_each, "h", "t")).where("in").drop("in").distinct()
    texts = usable.join(F.broadcast(picked), ["lang", "h", "t"], "left_semi").dropDuplicates(["lang", "h", "t"])
    data = F.encode("text", "utf-8")
    starts = F.sequence(F.lit(0), F.length(data) - 1, F.lit(STEPS))
    cut = texts.select("lang", "h", "t", data.alias("data"), F.explode(starts).alias("at"))
    cut = cut.select("lang", "h", "t", "at", F.substring("data", F.col("at") + 1, F.lit(STEPS)).alias("w"))
    chosen = cut.withColumn("in", first(windows_each, F.xxhash64("h", "t", "at"), "h", "t", "at")).where("in").select("lang", "h", "t", "at", "w").collect()
    if not chosen:
        return None
    chosen.sort(key=lambda r: (r["lang"], r["h"], r["t"], r["at"]))
    langs = sorted({r["lang"] for r in chosen})
    windows = np.full((len(chosen), STEPS), 256, np.int16)
    for i, r in enumerate(chosen):
        windows[i, : len(r["w"])] = np.frombuffer(r["w"], np.uint8)
    model = ByteLanguageModel(langs)
    model.fit(windows, np.array([langs.index(r["lang"]) for r in chosen]))
    return model


def predict(docs: DataFrame, model: ByteLanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; prediction reads the text alone."""
    tune(docs.sparkSession)
    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    (flag,) = unused(docs, "known")
    rows = docs.select(*(F.col(f"`{c}`") for c in others), known.alias(flag))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in others) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array(own.langs, object)
        for b in batches:
            ok = b.column(flag).to_numpy(zero_copy_only=False)
            texts = b.column(others.index(text)).to_pylist()
            p = own.documents([t.encode() if k else b"" for t, k in zip(texts, ok)])
            best = p.argmax(1)
            lang = np.where(ok, names[best], UNKNOWN)
            score = np.where(ok, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            cols = b.columns[: len(others)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*others, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the rows that never teach: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
