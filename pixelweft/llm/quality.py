"""Quality classifier: a factorisation machine over hashed words, structure and size.

The score of a text is ``w0 + sum(w x) + sum over pairs of <v_i, v_j> x_i x_j``. The pairs take
linear time by the sum-of-squares identity: half of ``(sum v x)^2 - sum (v x)^2``, by factor.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweft.llm.common import map_texts

#: Hashed words, structure statistics and the bins of each, factors.
WORDS, STATS, BINS, FACTORS = 1 << 15, 16, 24, 8
FEATURES = WORDS + STATS * BINS
#: Labelled rows that a fit takes at most.
SAMPLE = 6000
MEMORY = 150_000
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
KINDS = {1: b"!", 2: b"|", 3: b"$#%&*", 4: b"0123456789", 5: b".", 6: b",;:", 7: b"?\"'()[]{}<>", 8: b"@/\\_=+-", 9: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        b = zlib.crc32(word) % WORDS
        if len(self) < MEMORY and len(word) <= 48:
            self[word] = b
        return b


def _share(n: float, of: float) -> int:
    """Bin of a share: fine near 0."""
    return min(BINS - 1, int((n / of) ** 0.5 * BINS)) if of else 0


def _log(n: float) -> int:
    return min(BINS - 1, int(np.log2(1 + n) * 1.5))


def structure(raw: bytes, words: list[bytes]) -> list[int]:
    """The bin of each of the ``STATS`` statistics of a whole text."""
    n, lines = len(raw), raw.split(b"\n")
    counts = [n - len(raw.translate(None, kind)) for kind in KINDS.values()]
    distinct = len(set(words))
    return [
        _log(n),
        *(_share(c, n) for c in counts),
        _share(distinct, len(words)),
        _log(len(words)),
        _log(len(lines)),
        _share(len(set(lines)), len(lines)),
        min(BINS - 1, int(sum(map(len, words)) / max(1, len(words)) * 2)),
        _share(n - len(raw.translate(None, bytes(range(128, 256)))), n),
    ]


def features(texts: list[str | None], buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes and values of all texts, one after the other, and where each starts, and the end."""
    index, value, starts = [], [], [0]
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        words = raw.lower().split()
        found, n = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), return_counts=True)
        x = np.sqrt(n.astype(np.float32))
        stats = [WORDS + s * BINS + b for s, b in enumerate(structure(raw, words))]
        index.append(np.concatenate([found, np.array(stats)]))
        value.append(np.concatenate([x / max(1e-9, float(np.sqrt((x * x).sum()))), np.full(len(stats), 0.5, np.float32)]))
        starts.append(starts[-1] + len(index[-1]))
    return np.concatenate([np.zeros(0, np.int64), *index]), np.concatenate([np.zeros(0, np.float32), *value]).astype(np.float32), np.array(starts)


class Machine:
    def __init__(self, rng: np.random.Generator):
        self.w0, self.w = 0.0, np.zeros(FEATURES, np.float32)
        self.v = rng.normal(0, 0.05, (FEATURES, FACTORS)).astype(np.float32)

    def raw(self, index, value, starts):
        vx = self.v[index] * value[:, None]
        at = starts[:-1]
        s = np.add.reduceat(vx, at)
        return self.w0 + np.add.reduceat(self.w[index] * value, at) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), at)), vx, s

    def score(self, index, value, starts) -> np.ndarray:
        if len(starts) == 1:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(index, value, starts)[0].astype(np.float64), -30, 30)))


def fit_machine(index, value, starts, y, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss, Adagrad steps over shuffled batches."""
    rng = np.random.default_rng(seed)
    m = Machine(rng)
    y = np.asarray(y, np.float32)
    base = (y.sum() + 1) / (len(y) + 2)
    m.w0 = float(np.log(base / (1 - base)))
    if len(np.unique(y)) < 2:
        m.v[:] = 0
        return m
    gw, gv, g0 = np.full(FEATURES, 1e-3, np.float32), np.full((FEATURES, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            n = starts[rows + 1] - starts[rows]
            flat = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
            own = np.concatenate([[0], np.cumsum(n)])
            i, x = index[flat], value[flat]
            raw, vx, s = m.raw(i, x, own)
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
            gx = np.repeat(g, n) * x
            dv = gx[:, None] * (np.repeat(s, n, axis=0) - vx)
            at, where = np.unique(i, return_inverse=True)
            w = np.bincount(where, gx, len(at)).astype(np.float32) + decay * m.w[at]
            v = np.stack([np.bincount(where, dv[:, f], len(at)) for f in range(FACTORS)], 1).astype(np.float32) + decay * m.v[at]
            gw[at] += w * w
            gv[at] += v * v
            m.w[at] -= rate * w / np.sqrt(gw[at])
            m.v[at] -= rate * v / np.sqrt(gv[at])
            g0 += float(g.sum()) ** 2
            m.w0 -= rate * float(g.sum()) / g0**0.5
    return m


def held_out(doc_id: str = "doc_id"):
    """Rows that no fit may learn from: crc32 of the id, as text, divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine learnt from at most ``sample`` labelled rows outside the held-out fold.

    The rows with the smallest hashes of their ids are taken, so that the choice doesn't hang on
    the order of the tables. Null labels and ids are left out; an id with several labels takes the
    greatest. Without labels of both kinds every score is the share of label 1, 0.5 if there is none.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
        .where("id is not null and y in (0, 1)")
        .groupBy("id").agg(F.max("y").alias("y"))
        .where(~held_out("id"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), "id").limit(sample)

    def make():
        buckets = Buckets()

        def work(piece):
            i, x, starts = features(piece.column("t").to_pylist(), buckets)
            return [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(i, pa.int32())), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.float32()))]

        return work

    found = map_texts(rows, "t", ["id", "y"], make, [T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))]).toArrow()
    got = sorted(zip(found["id"].to_pylist(), found["y"].to_pylist(), found["i"].to_numpy(), found["x"].to_numpy(), strict=True), key=lambda r: r[:2])
    starts = np.cumsum([0, *(len(r[2]) for r in got)])
    index = np.concatenate([np.zeros(0, np.int64), *(r[2] for r in got)]).astype(np.int64)
    value = np.concatenate([np.zeros(0, np.float32), *(r[3] for r in got)]).astype(np.float32)
    return fit_machine(index, value, starts, [r[1] for r in got])


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``out``, from 0 to 1: how likely label 1 is.

    Only the whole text is looked at. Null texts score like empty ones. No shuffle; other columns
    pass through, and a column already named ``out`` is replaced.
    """

    def make():
        buckets = Buckets()
        return lambda piece: [pa.array(machine.score(*features(piece.column(text).to_pylist(), buckets)), pa.float64())]

    return map_texts(docs, text, keep or docs.columns, make, [T.StructField(out, T.DoubleType())])
