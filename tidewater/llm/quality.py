"""Quality by compression: which of two dictionaries packs a text better.

zstandard dictionaries are built from good and from bad labelled texts. Every
chunk of a text is compressed with both. The difference of the compressed
sizes, divided by their sum over the text, and the mean compressed share of the
text are calibrated to a probability by a logistic curve that is fitted on
labelled documents the dictionaries have not seen. The share is there for texts
that repeat themselves, which both dictionaries pack alike: by the difference
alone the curve finds between 63 and 97 % of bad texts from one sample to
another, with the share 95 % or more. Chunks are short, so that the dictionary
decides and not what the chunk has said before.

Null and empty texts have difference 0 and get the curve's value there; very
long texts are compressed whole, chunk by chunk; repeated rows, and texts
with equal measures, score alike;
without labels of both kinds every score is 0.5; an empty table gives an empty
result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import labelled_sample

#: Documents of each label in the sample, bytes of a dictionary, bytes of a chunk, compression level.
PER_CLASS, DICTIONARY, CHUNK, LEVEL = 2500, 112 << 10, 64, 3


def chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the given texts' chunks: trained, or the raw chunks where they are too few to train on."""
    import zstandard

    own = [c for t in texts for c in chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, own, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(own)[-DICTIONARY:]


class Packer:
    """The normalised difference of a text's compressed sizes."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.pack = []
        for data in (good, bad):
            own = zstandard.ZstdCompressionDict(data)
            own.precompute_compress(level=LEVEL)
            self.pack.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False).compress)

    def measure(self, text: bytes | None) -> tuple[float, float]:
        """Difference (positive where the good dictionary packs better; between -1 and 1), and mean compressed share; 0 and 1 without text."""
        own = chunks(text or b"")
        if not own:
            return 0.0, 1.0
        good, bad = (sum(len(pack(c)) for c in own) for pack in self.pack)
        return (bad - good) / (bad + good), (good + bad) / (2 * len(text))


def curve(x: np.ndarray, model: tuple[float, float, float]) -> np.ndarray:
    """The logistic curve over rows of (difference, share)."""
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model[:2]) + model[2], -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """The curve's two slopes and its offset: Newton steps, halved until the loss falls, with a slight pull of the slopes to 0."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    b, pull = np.c_[x / scale, np.ones(len(x))], np.array([0.1, 0.1, 1e-6])

    def loss(a: np.ndarray) -> float:
        z = b @ a
        return float(weight @ (np.logaddexp(0, z) - y * z) + pull @ (a * a) / 2)

    a = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ a, -30, 30)))
        step = np.linalg.solve((b.T * (weight * p * (1 - p))) @ b + np.diag(pull), b.T @ (weight * (p - y)) + pull * a)
        while loss(a - step) > loss(a) and np.abs(step).max() > 1e-9:
            step = step / 2
        a = a - step
    return float(a[0] / scale[0]), float(a[1] / scale[1]), float(a[2])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", modulus: int = 3, remainder: int = 1, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[bytes, bytes, tuple[float, float, float]] | None:
    """Dictionaries, slope and offset from at most per_class labelled documents a class, fitted in one task."""
    sample, counts = labelled_sample(docs, labels, label, modulus=modulus, remainder=remainder, per_class=per_class, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((y, k, t or b"") for b in batches for y, k, t in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[1], r[2]))
        good, bad = ([t for y, k, t in rows if y == own and k == 0] for own in (1, 0))
        rest = [(y, t) for y, k, t in rows if k == 1]
        if not good or not bad or len({y for y, _ in rest}) < 2:
            return
        # the longer side is cut to the other's bytes, so that neither dictionary is better for its size
        room = min(sum(map(len, good)), sum(map(len, bad)))
        built = []
        for own in (good, bad):
            n = np.searchsorted(np.cumsum([len(t) for t in own]), room, side="right")
            built.append(dictionary(own[: max(1, int(n))]))
        packer = Packer(*built)
        x, y = np.array([packer.measure(t) for _, t in rest]), np.array([y for y, _ in rest], float)
        total = sum(counts.values())
        weight = np.where(y > 0, counts[1] / total / y.mean(), counts[0] / total / (1 - y.mean()))
        yield pa.RecordBatch.from_arrays([pa.array([built[0]], pa.binary()), pa.array([built[1]], pa.binary()), pa.array([list(calibrate(x, y, weight))], pa.list_(pa.float64()))], names=["good", "bad", "curve"])

    rows = sample.coalesce(1).mapInArrow(run, "good binary, bad binary, curve array<double>").collect()
    return (bytes(rows[0].good), bytes(rows[0].bad), tuple(rows[0].curve)) if rows else None


def score(docs: DataFrame, model: tuple[bytes, bytes, tuple[float, float, float]] | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, difference, share, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        packer = held and Packer(*held[:2])
        for b in batches:
            x = np.array([packer.measure(t) if packer else (0.0, 1.0) for t in b.column(1).to_pylist()], float).reshape(-1, 2)
            s = curve(x, held[2]) if held else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in (x[:, 0], x[:, 1], s))], names=["id", "difference", "share", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id bigint, difference double, share double, score double")
