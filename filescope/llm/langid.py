"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text is cut into segments of SEGMENT bytes. One GRU reads a segment forwards and one backwards; at each byte both
states give the languages' probabilities, so every position is labelled, and a document's probabilities are the mean
over all its positions. Training is backpropagation through time on the sum of the positions' cross entropy, by Adam,
over a sample whose size is bounded by parameters. A byte's input weights are looked up, so a step is one small matrix
product for all segments of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.llm.common import column, text_and_id, tidy, tune, utf8

SEGMENT = 128
HIDDEN = 8
#: Bounds of the training sample: documents of a language, and segments of a document. All languages are learned.
PER_LANG, SEGMENTS_PER_DOC = 256, 3
#: Steps of training, whatever the sample's size.
STEPS, BATCH, RATE, SEED = 320, 128, 0.02, 11
#: Segments that run through the network side by side.
WIDE = 1024
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as (n, SEGMENT), lengths): the whole text, the last segment padded with 0."""
    n = -(-len(data) // SEGMENT)
    out = np.frombuffer(data.ljust(n * SEGMENT, b"\0"), np.uint8).reshape(n, SEGMENT)
    size = np.full(n, SEGMENT)
    if n:
        size[-1] = len(data) - (n - 1) * SEGMENT
    return out, size


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign: like the hyperbolic tangent between -1 and 1, at a fifth of its cost. Its slope is (1 - |result|)^2."""
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * _squash(x) + 0.5


class BiGRU:
    """Parameters are a dict of arrays; `e0`, `e1` are the input weights of each byte, `u0`, `u1` the recurrent ones."""

    def __init__(self, langs: list[str], params: dict | None = None, hidden: int = HIDDEN) -> None:
        self.langs, self.hidden = langs, hidden
        if params is None:
            rng = np.random.default_rng(SEED)
            params = {"out": rng.normal(0, 0.3, (2 * hidden, len(langs))), "bias": np.zeros(len(langs))}
            for d in "01":
                params |= {f"e{d}": rng.normal(0, 0.3, (256, 3 * hidden)), f"u{d}": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), f"c{d}": np.zeros(hidden)}
        self.params = {k: v.astype(np.float32) for k, v in params.items()}

    def _states(self, x: np.ndarray, d: str, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each byte of x (time, batch), in x's order; backwards for d = "1"."""
        h3, p = self.hidden, self.params
        e, u, c = p[f"e{d}"], p[f"u{d}"], p[f"c{d}"]
        h = np.zeros((x.shape[1], h3), np.float32)
        out, tape = np.empty((*x.shape, h3), np.float32), []
        for t in range(len(x)) if d == "0" else reversed(range(len(x))):
            a, b = e[x[t]], h @ u
            gates = _gate(a[:, : 2 * h3] + b[:, : 2 * h3])
            z, r = gates[:, :h3], gates[:, h3:]
            cand = b[:, 2 * h3 :] + c
            n = _squash(a[:, 2 * h3 :] + r * cand)
            new = n + z * (h - n)
            if d == "1":  # the padding comes first
                new *= live[t]
            if keep:
                tape.append((t, h, z, r, n, cand))
            h = out[t] = new
        return out, tape

    def label(self, x: np.ndarray, size: np.ndarray, keep: bool = False):
        """Log-odds at each position (time, batch, langs) of segments (batch, time); and what training needs."""
        x = np.ascontiguousarray(x.T)
        live = (np.arange(len(x))[:, None] < size)[:, :, None].astype(np.float32)
        runs = [self._states(x, d, live, keep) for d in "01"]
        h = np.concatenate([r[0] for r in runs], axis=2)
        return h @ self.params["out"] + self.params["bias"], x, live, h, runs

    def _read(self, x: np.ndarray, d: str, live: np.ndarray, out: np.ndarray) -> None:
        """As _states, but without a tape, in place, and with a column for each segment: most time is spent here."""
        n, p = self.hidden, self.params
        e, u, c = (np.ascontiguousarray(p[k + d].T) for k in "euc")
        h = np.zeros((n, x.shape[1]), np.float32)
        a, b, size = (np.empty((3 * n, x.shape[1]), np.float32) for _ in "abs")
        gates, z, r, cand, new = a[: 2 * n], a[:n], a[n : 2 * n], b[2 * n :], a[2 * n :]
        for t in range(len(x)) if d == "0" else reversed(range(len(x))):
            np.take(e, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=b)
            gates += b[: 2 * n]
            np.abs(gates, out=size[: 2 * n])
            size[: 2 * n] += 1
            gates /= size[: 2 * n]
            gates *= 0.5
            gates += 0.5
            cand += c[:, None]
            cand *= r
            new += cand
            np.abs(new, out=cand)
            cand += 1
            new /= cand
            h -= new
            h *= z
            h += new
            if d == "1":
                h *= live[t]
            out[t] = h

    def pooled(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The sum over a segment's positions of the probabilities there, for each segment."""
        out = np.zeros((len(x), len(self.langs)))
        for i in range(0, len(x), WIDE):
            own = size[i : i + WIDE]
            part = np.ascontiguousarray(x[i : i + WIDE, : own.max()].T).astype(np.intp)
            live = (np.arange(len(part))[:, None] < own).astype(np.float32)
            states, score = np.empty((len(part), self.hidden, len(own)), np.float32), self.params["bias"][:, None]
            for d in "01":
                self._read(part, d, live, states)
                k = self.hidden * int(d)
                score = score + self.params["out"][k : k + self.hidden].T @ states
            score -= score.max(axis=1, keepdims=True)
            np.exp(score, out=score)
            score *= (live / score.sum(axis=1))[:, None]
            out[i : i + WIDE] = score.sum(axis=0).T
        return out

    def languages(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Each text's language and its mean probability over the text's bytes."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if self.langs and t and _LETTER.search(t)]
        if some:
            parts = [segments(utf8(texts[i])) for i in some]
            x, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            doc = np.repeat(np.arange(len(some)), [len(p[0]) for p in parts])
            order = np.argsort(-size, kind="stable")  # short ones run with short ones
            sums = np.zeros((len(some), len(self.langs)))
            np.add.at(sums, doc[order], self.pooled(x[order], size[order]))
            mean = sums / np.bincount(doc, size, len(some))[:, None]
            for i, best, p in zip(some, mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist(), strict=True):
                langs[i], scores[i] = self.langs[best], min(1.0, p)
        return langs, scores

    def gradient(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over all positions, and its gradient by backpropagation through time."""
        score, x, live, h, runs = self.label(x, size, keep=True)
        score = score - score.max(axis=2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=2, keepdims=True)
        total = live.sum()
        loss = float(-(np.log(np.maximum(p[:, np.arange(len(y)), y], 1e-9)) * live[:, :, 0]).sum() / total)
        p[:, np.arange(len(y)), y] -= 1
        p *= live / total
        g = {"out": np.einsum("tbh,tbl->hl", h, p, optimize=True), "bias": p.sum(axis=(0, 1))}
        back = p @ self.params["out"].T
        n = self.hidden
        for k, d in enumerate("01"):
            u = self.params[f"u{d}"]
            ge, gu, gc = np.zeros((256, 3 * n), np.float32), np.zeros_like(u), np.zeros(n, np.float32)
            dh = np.zeros((x.shape[1], n), np.float32)
            for t, before, z, r, cand_out, cand in reversed(runs[k][1]):
                dh = dh + back[t, :, k * n : (k + 1) * n]
                if d == "1":
                    dh = dh * live[t]
                dn = dh * (1 - z) * (1 - np.abs(cand_out)) ** 2
                slope = lambda gate: 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
                da = np.concatenate([dh * (before - cand_out) * slope(z), dn * cand * slope(r), dn], axis=1)
                db = da.copy()
                db[:, 2 * n :] *= r
                np.add.at(ge, x[t], da)
                gu += before.T @ db
                gc += db[:, 2 * n :].sum(axis=0)
                dh = dh * z + db @ u.T
            g |= {f"e{d}": ge, f"u{d}": gu, f"c{d}": gc}
        return loss, g


def fit(texts: list[tuple[str, str]], steps: int = STEPS) -> BiGRU:
    """A network from (text, lang). The same texts in any order give the same network."""
    langs = sorted({lang for _, lang in texts})
    rng = np.random.default_rng(SEED)
    x, size, y = [np.zeros((0, SEGMENT), np.uint8)], [np.zeros(0, np.int64)], []
    for text, lang in sorted(texts):
        own, n = segments(utf8(text))
        pick = rng.permutation(len(own))[:SEGMENTS_PER_DOC]
        x.append(own[pick])
        size.append(n[pick])
        y += [langs.index(lang)] * len(pick)
    net = BiGRU(langs)
    x, size, y = np.concatenate(x), np.concatenate(size), np.array(y, np.int64)
    if len(langs) < 2 or not len(x):
        return net
    m, v = ({k: np.zeros_like(p) for k, p in net.params.items()} for _ in "mv")
    step = 0
    while step < steps:
        order = rng.permutation(len(x))
        for i in range(0, min(len(x), (steps - step) * BATCH), BATCH):
            pick = order[i : i + BATCH]
            _, g = net.gradient(x[pick, : size[pick].max()], size[pick], y[pick])
            norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, a in g.items():
                a = a * min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a * a - v[k])
                net.params[k] -= (rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def training_sample(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """(text, lang) of at most `per_lang` labelled documents of `docs` (doc_id, text, lang) for each of the languages.

    For each language and each of `per_lang` hash buckets the document with the least hash: counts meet by partial
    aggregation, whatever share of rows a language has.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id", "text"))
    best = rows.groupBy("lang", F.pmod("h", F.lit(per_lang)).alias("bucket")).agg(F.min("h").alias("h"))
    want = [(r["lang"], r["h"]) for r in best.collect()]
    if not want:
        return []
    chosen = docs.sparkSession.createDataFrame(want, "lang string, h long")
    found = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "text").dropDuplicates(["lang", "h"])
    return [(r["text"], r["lang"]) for r in found.select("lang", _spread("text").alias("text")).collect()]


#: Characters of a training text that are brought to the driver: pieces from its start, middle and end.
PIECE = 600


def _spread(name: str):
    text, n = F.col(name), F.length(name)
    middle, end = (n / 2 - PIECE / 2).cast("int"), n - PIECE
    return F.when(n <= 3 * PIECE, text).otherwise(F.concat_ws(" ", text.substr(F.lit(1), F.lit(PIECE)), text.substr(middle, F.lit(PIECE)), text.substr(end, F.lit(PIECE))))


def predict(docs: DataFrame, net: BiGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the language whose mean probability over a text's bytes is highest, and that mean.

    Null texts and texts without a letter: `und`, score 0. A network that learned no language: `und` for all; only one:
    that one. Ties: the first by name. Repeated rows: a row each. Extra columns are not read.
    """
    tune(docs.sparkSession)
    state = (net.langs, net.params, net.hidden)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BiGRU(*state)
        for batch in batches:
            langs, scores = own.languages(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return text_and_id(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, net: BiGRU, text_col: str = "text", least: float = 0.0, langs: list[str] | None = None) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text has a language: not `und`, with a score of `least` or more.

    Only `langs`, if given. By default a text of any language that was learned stays, however mixed it is.
    """
    tune(docs.sparkSession)
    state = (net.langs, net.params, net.hidden)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BiGRU(*state)
        for batch in batches:
            found = zip(*own.languages(column(batch, text_col).to_pylist()), strict=True)
            yield batch.filter(pa.array([a != UNKNOWN and b >= least and (langs is None or a in langs) for a, b in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(doc_id="doc_id"):
    """crc32 of the id as text is 2 modulo 4; a null id counts as empty text, and isn't held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BiGRU:
    """A network from the labelled rows that aren't held out; see training_sample for the bounds."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return fit(training_sample(own.filter(~held_out())))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a network learned from the rows that aren't held out."""
    out = predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
