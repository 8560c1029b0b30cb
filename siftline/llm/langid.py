"""Language identification by a bidirectional gated recurrent network over bytes.

The text's lower-cased UTF-8 bytes are cut into windows; the network runs over each window
in both directions and labels every byte; a document's probabilities are the mean over all its
bytes.  Texts are read whole, however long, a bounded number of windows at a time.

The network is trained here in numpy by back-propagation through time, on all bytes of ``SAMPLE``
documents of each language (expected; chosen by hash, none above ``SAMPLE_BYTES``), and the
``LANGUAGES`` most frequent languages are learned: these bound what the driver gathers.  Only text
and the stated language of training documents are read; language, source and key are never inputs
of a prediction.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every
text where no training document states a language; rows are predicted each by its own text, so
repeats and ties do not matter; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import common

MODULUS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Bytes of a window, units of each direction.
STEPS, UNITS = 64, 16
#: Bounds of the training sample: documents of a language, bytes of a document, languages, bytes in all.
SAMPLE, SAMPLE_BYTES, LANGUAGES, TOTAL_BYTES = 100, 1 << 18, 256, 64 << 20
EPOCHS, BATCH, RATE = 4, 128, 0.02
#: Windows run at once when predicting.
WINDOWS = 4096

OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def windows(data: bytes, steps: int = STEPS) -> np.ndarray:
    """All of ``data`` as rows of ``steps`` bytes, the last one filled up with zeros."""
    n = max(1, -(-len(data) // steps))
    return np.frombuffer(data + bytes(n * steps - len(data)), np.uint8).reshape(n, steps)


class Network:
    """Two gated recurrent layers, one each way, and a softmax at every position.

    Per direction: ``e`` (256, 3H) holds the input's part of update gate, reset gate and
    candidate for every byte, ``u`` (H, 3H) the state's.
    """

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.units = languages, units

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"w": draw(2 * units, len(languages), scale=0.3), "b": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.p |= {f"e{d}": draw(256, 3 * units, scale=0.3), f"u{d}": draw(units, 3 * units, scale=1 / units**0.5)}

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (steps, rows, H) of direction ``d`` over ``x`` (rows, steps)."""
        h_, e, u = self.units, self.p[f"e{d}"], self.p[f"u{d}"]
        # gates and candidate apart, so that every array is contiguous; 1 / (1 + exp(-x)) is (1 + tanh(x / 2)) / 2
        (ez, uz), (er, ur), (en, un) = ([np.ascontiguousarray(v[:, i * h_ : (i + 1) * h_]) * np.float32(k) for v in (e, u)] for i, k in enumerate((0.5, 0.5, 1)))
        n, steps = x.shape
        out = np.empty((steps, n, h_), np.float32)
        h = np.zeros((n, h_), np.float32)
        a, z, r, s, c = (np.empty_like(h) for _ in range(5))
        columns = np.ascontiguousarray(x.T)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            at = columns[t].astype(np.intp)
            if keep is not None:
                z, r, s, c = (np.empty_like(h) for _ in range(4))
            for gate, eg, ug in ((z, ez, uz), (r, er, ur)):
                np.matmul(h, ug, out=gate)
                gate += np.take(eg, at, axis=0, out=a, mode="clip")
                np.tanh(gate, out=gate)
                gate *= np.float32(0.5)
                gate += np.float32(0.5)
            np.matmul(h, un, out=s)
            np.multiply(s, r, out=c)
            c += np.take(en, at, axis=0, out=a, mode="clip")
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, h, z, r, s, c))
            # h' = c + z (h - c)
            new = out[t]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            h = new
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(rows, steps, languages): every position's label probabilities."""
        w, h = self.p["w"], self.units
        # languages first, so that sums over them go along whole rows
        logits = w[:h].T @ self._run(x, "f").reshape(-1, h).T
        logits += w[h:].T @ self._run(x, "b").reshape(-1, h).T
        logits += self.p["b"][:, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.reshape(-1, x.shape[1], len(x)).transpose(2, 1, 0)

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the masked positions and its gradients, through time."""
        p, h_ = self.p, self.units
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], axis=2)
        logits = states @ p["w"] + p["b"]
        logits -= logits.max(axis=-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=-1, keepdims=True)
        m = mask.T.astype(np.float32)
        total = max(1.0, float(m.sum()))
        rows = np.arange(len(y))
        loss = -float((np.log(prob[:, rows, y] + 1e-12) * m).sum()) / total
        d_logits = prob
        d_logits[:, rows, y] -= 1
        d_logits *= (m / total)[:, :, None]
        g = {"w": np.einsum("tnh,tnc->hc", states, d_logits), "b": d_logits.sum(axis=(0, 1))}
        d_states = d_logits @ p["w"].T
        for i, d in enumerate("fb"):
            u = p[f"u{d}"]
            ge, gu = np.zeros_like(p[f"e{d}"]), np.zeros_like(u)
            dh = np.zeros((len(x), h_), np.float32)
            for t, h, z, r, s, c in reversed(kept[d]):
                dh = dh + d_states[t, :, i * h_ : (i + 1) * h_]
                dz = dh * (h - c) * z * (1 - z)
                dc = dh * (1 - z) * (1 - c * c)
                dr = dc * s * r * (1 - r)
                ds = dc * r
                da = np.concatenate((dz, dr, dc), axis=1)
                np.add.at(ge, x[:, t], da)
                gu += h.T @ np.concatenate((dz, dr, ds), axis=1)
                dh = dh * z + np.concatenate((dz, dr, ds), axis=1) @ u.T
            g |= {f"e{d}": ge, f"u{d}": gu}
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> float:
        """Adam over shuffled batches; the last loss."""
        rng, steps, loss = np.random.default_rng(seed), 0, 0.0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        whole = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                at = order[lo : lo + batch]
                loss, g = self.gradients(x[at], y[at], mask[at])
                norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
                steps += 1
                now = rate * (1 - steps / (whole + 1))
                for k, v in g.items():
                    v = v * min(1.0, 1.0 / (norm + 1e-9))
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.01 * (v * v - second[k])
                    self.p[k] -= (now * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
        return loss


def sample(rows: DataFrame, per_language: int = SAMPLE, total_bytes: int = TOTAL_BYTES) -> list[tuple[str, str]]:
    """(text, language) of training documents, chosen by hash: of each language about ``per_language``,
    and about its even share of ``total_bytes`` at most, so that the driver holds no more than that."""
    rows = rows.withColumn("_bytes", F.octet_length("text")).filter(F.col("_bytes") <= SAMPLE_BYTES)
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("bytes")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return []
    even = total_bytes / len(sizes)
    share = F.create_map(*(F.lit(v) for r in sorted(sizes, key=lambda r: r.lang) for v in (r.lang, min(1.0, per_language / r.n, even / max(1, r.bytes)))))
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    got = rows.filter(u < F.element_at(share, F.col("lang"))).select("doc_id", "text", "lang").collect()
    return [(r.text, r.lang) for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text))]


def fit(rows: DataFrame, per_language: int = SAMPLE) -> Network | None:
    """A network trained on a sample of ``rows`` (doc_id, text, lang); None without any."""
    picked = [(t, k) for t, k in sample(rows, per_language) if has_letter(t)]
    if not picked:
        return None
    languages = sorted({k for _, k in picked})
    xs, ys = [], []
    for text, lang in picked:
        w = windows(text.lower().encode("utf-8", "replace"))
        xs.append(w)
        ys += [languages.index(lang)] * len(w)
    x = np.concatenate(xs)
    net = Network(languages)
    net.train(x, np.array(ys), x > 0)
    return net


def predict(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and pooled probability of each text."""
    pooled = np.zeros((len(texts), len(net.languages)))
    held: list[tuple[int, np.ndarray]] = []
    count = 0

    def flush() -> None:
        nonlocal count
        if held:
            x = np.concatenate([w for _, w in held])
            prob = net.probabilities(x) * (x > 0)[:, :, None]
            owner = np.concatenate([np.full(len(w), i) for i, w in held])
            np.add.at(pooled, owner, prob.sum(axis=1))
            held.clear()
            count = 0

    for i, text in enumerate(texts):
        if not has_letter(text):
            continue
        w = windows(text.lower().encode("utf-8", "replace").replace(b"\0", b" "))
        for lo in range(0, len(w), WINDOWS):
            if count + len(w[lo : lo + WINDOWS]) > WINDOWS:
                flush()
            held.append((i, w[lo : lo + WINDOWS]))
            count += len(w[lo : lo + WINDOWS])
    flush()
    out = []
    for row in pooled:
        total = row.sum()
        best = int(row.argmax())
        out.append((net.languages[best], min(1.0, float(row[best] / total))) if total else (UNKNOWN, 0.0))
    return out


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score`` for every row.

    The columns in ``carry``, by default all, stay, but those three names.
    """
    held = common.doc_hash(F.col(key), MODULUS) == HELD_OUT
    training = docs.filter(~held & F.col(lang).isNotNull() & F.col(text).isNotNull())
    net = fit(training.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")))
    own = [c for c in (docs.columns if carry is None else carry) if c not in ("held_out", "lang_pred", "score")]
    if net is None:
        return docs.select(*own, held.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(*dict.fromkeys([*own, text]), held.alias("held_out"))
    kept = [*own, "held_out"]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("langid")
        for batch in common.slices(batches, text):
            found = predict(net, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
