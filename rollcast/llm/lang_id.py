"""Language identification by a byte convolutional network trained in numpy.

A text is cut into fixed-length windows of bytes. Each window goes through a byte
embedding, filters of several widths, ReLU, max pooling over positions and a softmax;
the document's score for a language is the mean of its windows' probabilities, weighted
by their bytes. For inference the filters are folded with the embedding into one table
per pair of adjacent bytes, so a filter of width 2m costs m table look-ups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp as X
from .common import told_ids, tune, with_columns

WINDOW = 256  # bytes
WIDTHS = (2, 4, 6)
FILTERS = 16  # of each width
DIM = 8
#: The bound of the sample that the network learns from: documents, windows of each.
TRAIN_DOCS, TRAIN_WINDOWS = 6000, 2
EPOCHS, BATCH, RATE = 4, 128, 0.01
CHUNK = 128  # windows in one pass of inference


class ByteCNN:
    """Weights: embedding (256, DIM), filters {width: (width, DIM, FILTERS)}, softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.w = {"e": rng.normal(0, 0.5, (256, DIM))}
        for k in WIDTHS:
            self.w[f"f{k}"] = rng.normal(0, 1 / np.sqrt(k * DIM), (k, DIM, FILTERS))
            self.w[f"b{k}"] = np.zeros(FILTERS)
        self.w["o"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes)))
        self.w["c"] = np.zeros(len(classes))
        self.w["e"][0] = 0
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _grad(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        w, n = self.w, len(x)
        emb = w["e"][x]
        feats, tops = [], []
        for k in WIDTHS:
            r = sum(emb[:, j : x.shape[1] - k + 1 + j] @ w[f"f{k}"][j] for j in range(k))
            top = r.argmax(1)
            tops.append(top)
            feats.append(np.take_along_axis(r, top[:, None], 1)[:, 0] + w[f"b{k}"])
        raw = np.concatenate(feats, 1)
        h = np.maximum(raw, 0)
        z = h @ w["o"] + w["c"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = p.copy()
        d[np.arange(n), y] -= 1
        d *= (weight / weight.sum())[:, None]
        g = {"o": h.T @ d, "c": d.sum(0), "e": np.zeros_like(w["e"])}
        dh = (d @ w["o"].T) * (raw > 0)
        rows = np.arange(n)[:, None]
        for i, (k, top) in enumerate(zip(WIDTHS, tops)):
            dk = dh[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{k}"] = dk.sum(0)
            gf = np.zeros_like(w[f"f{k}"])
            for j in range(k):
                at = x[rows, top + j]
                gf[j] = np.einsum("nf,nfd->df", dk, w["e"][at])
                back = dk[:, :, None] * w[f"f{k}"][j].T[None]
                for m in range(DIM):
                    g["e"][:, m] += np.bincount(at.ravel(), back[:, :, m].ravel(), 256)
            g[f"f{k}"] = gf
        g["e"][0] = 0
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> "ByteCNN":
        """x: (n, WINDOW) bytes; y: class indices. Adam on softmax cross-entropy; classes
        weigh by the square root of their inverse frequency."""
        rng = np.random.default_rng(seed)
        weight = (1 / np.sqrt(np.bincount(y, minlength=len(self.classes)).clip(1)))[y].astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(u) for k, u in self.w.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                at = order[i : i + BATCH]
                step += 1
                for k, g in self._grad(x[at], y[at], weight[at]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def fold(self) -> list:
        """For each width, one (65536, FILTERS) table per pair of adjacent bytes."""
        out = []
        for k in WIDTHS:
            one = [self.w["e"] @ self.w[f"f{k}"][j] for j in range(k)]
            out.append([(one[j][:, None] + one[j + 1][None]).reshape(65536, FILTERS) for j in range(0, k, 2)])
        return out

    def probabilities(self, x: np.ndarray, tables: list) -> np.ndarray:
        """(n, classes) for windows x (n, WINDOW) of bytes."""
        out = np.zeros((len(x), len(self.classes)), np.float32)
        for i in range(0, len(x), CHUNK):
            t = np.ascontiguousarray(x[i : i + CHUNK].T).astype(np.intp)
            pair = t[:-1] * 256 + t[1:]
            feats = []
            for k, tabs in zip(WIDTHS, tables):
                n = WINDOW - k + 1
                r = np.take(tabs[0], pair[:n], axis=0)
                for j, tab in enumerate(tabs[1:], 1):
                    r += np.take(tab, pair[2 * j : 2 * j + n], axis=0)
                feats.append(r.max(0) + self.w[f"b{k}"])
            z = np.maximum(np.concatenate(feats, 1), 0) @ self.w["o"] + self.w["c"]
            p = np.exp(z - z.max(1, keepdims=True))
            out[i : i + CHUNK] = p / p.sum(1, keepdims=True)
        return out


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover each text whole, the last padded with zeros; the text each
    comes from; its bytes."""
    n = np.array([-(-len(t) // WINDOW) for t in texts])
    buf = np.frombuffer(b"".join(t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, n)), np.uint8).reshape(-1, WINDOW)
    doc = np.repeat(np.arange(len(texts)), n)
    size = np.full(len(doc), WINDOW)
    last = np.cumsum(n) - 1
    full = n > 0
    size[last[full]] = np.array([len(t) for t in texts])[full] - (n[full] - 1) * WINDOW
    return buf, doc, size


def train(spark: SparkSession, docs: DataFrame, use, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCNN | None:
    """The network, fitted on TRAIN_WINDOWS windows of each of TRAIN_DOCS documents at most:
    those with a language for which the condition `use` holds, of the smallest id
    hashes. Ids are of any type. Rows without an id or a text are not learned from; rows that
    repeat an id are.
    None if there is nothing to learn from."""
    use = use & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()
    known = docs.where(use).select(*told_ids(docs, id_col))
    ids = known.orderBy("order", "seed").limit(TRAIN_DOCS).select("id").toPandas()["id"].tolist()
    if not ids:
        return None
    picked = spark.createDataFrame([(i,) for i in sorted(set(ids))], "id string")
    rows = docs.where(use & F.col(text_col).isNotNull()).select(*told_ids(docs, id_col), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def cut(frames):
        for pdf in frames:
            for i, lang, text in zip(pdf["seed"], pdf["lang"], X.encode(pdf["text"])):
                n = -(-len(text) // WINDOW)
                for j in np.random.default_rng(int(i) & (2**63 - 1)).permutation(n)[:TRAIN_WINDOWS]:
                    yield pd.DataFrame({"id": [i], "lang": [lang], "w": [text[j * WINDOW : (j + 1) * WINDOW]]})

    got = rows.drop("order").mapInPandas(cut, "id long, lang string, w binary").toPandas().sort_values(["id", "w"])
    if got.empty:
        return None
    classes = sorted(set(got["lang"]))
    x = np.frombuffer(b"".join(bytes(w).ljust(WINDOW, b"\0") for w in got["w"]), np.uint8).reshape(-1, WINDOW)
    return ByteCNN(classes).fit(x, np.searchsorted(classes, got["lang"]))


def identify(docs: DataFrame, model: ByteCNN | None, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score. A text that is null, empty or has no letters is `und`
    with score 0, as is any text if there is no model. All of every text is read, a batch of
    2 MB of texts, or one longer text, at a time (some 20 bytes a byte of text). A row's
    result depends on its text alone, so repeated rows and rows without an id get theirs
    like any; of languages that tie the first by name wins. Columns of `docs` named
    lang_pred or score are replaced; all others pass through. An empty table gives no rows."""

    def make():
        tables = model.fold() if model else None

        def run(texts):
            live = np.array([isinstance(t, str) and any(map(str.isalpha, t)) for t in texts], bool) & (model is not None)
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            at = np.flatnonzero(live)
            raw = X.encode(texts[i] for i in at)
            for a, b in X.batches(raw):
                w, doc, size = windows(raw[a:b])
                p = model.probabilities(w, tables) * size[:, None]
                total = np.stack([np.bincount(doc, p[:, c], b - a) for c in range(p.shape[1])], 1)
                total /= total.sum(1, keepdims=True)
                best = total.argmax(1)
                lang[at[a:b]] = np.array(model.classes, object)[best]
                score[at[a:b]] = total[np.arange(b - a), best]
            return lang, score

        return run

    return with_columns(docs, [text_col], {"lang_pred": "string", "score": "double"}, make)


def held_out(id_col: str, folds: int, fold: int):
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(spark, docs, ~held_out("doc_id", 5, 0))
    found = identify(docs.select("doc_id", "text"), model).drop("text")
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
