"""Language identification with string kernels.

The kernel of two texts is the number of n-grams (of one to three symbols) that both hold, over the root of the product of
how many each holds. Landmarks from the training rows give a Nyström approximation of it, on which kernel ridge regression
is solved once for each language against the rest. As the kernel is linear in the n-grams that are present, landmarks and
coefficients fold into one matrix, and a batch of texts is scored by one product with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.llm.batches import pieces

#: At most so many different labelled texts, shared evenly by the languages, are fitted; one a language at least.
SAMPLE_ROWS = 2000
LANDMARKS = 256
RIDGE = 1e-3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SYMBOLS = 144
#: Blank, a-z, and the bytes of UTF-8 beyond ASCII; all else is blank.
_SYMBOL = bytes(c - 96 if 97 <= c <= 122 else c - 101 if 128 <= c < 192 else c - 103 if 194 <= c < 245 else 0 for c in range(256))
_SIZE = _SYMBOLS + _SYMBOLS**2 + _SYMBOLS**3


def _grams(text: str) -> np.ndarray:
    """The numbers of all n-grams, as often as they occur, of the lower-cased text with one blank for all between words."""
    words = text.lower().encode().translate(_SYMBOL).split(b"\0")
    s = np.frombuffer(b"\0" + b"\0".join(w for w in words if w) + b"\0", "uint8").astype("int32")
    pairs = s[:-1] * _SYMBOLS + s[1:]
    return np.concatenate([s, pairs + _SYMBOLS, pairs[:-1] * _SYMBOLS + s[2:] + (_SYMBOLS + _SYMBOLS**2)])


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


class KernelClassifier:
    """One-versus-rest ridge regression on the Nyström features of labelled texts."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.languages = sorted(set(labels))
        sets = [np.unique(_grams(t)) for t in texts]
        chosen = [sets[i] for i in np.unique(np.linspace(0, len(sets) - 1, min(landmarks, len(sets))).astype(int))]
        vocabulary = np.unique(np.concatenate(chosen))
        self.index = np.full(_SIZE, len(vocabulary), dtype="int32")
        self.index[vocabulary] = np.arange(len(vocabulary))
        present = self._presence(sets)
        marks = self._presence(chosen)
        root = np.sqrt([len(x) for x in sets])
        marks_root = np.sqrt([len(x) for x in chosen])
        between = present @ marks.T / root[:, None] / marks_root
        among = marks @ marks.T / marks_root[:, None] / marks_root
        target = np.where(np.array(labels)[:, None] == np.array(self.languages), 1.0, -1.0)
        normal = between.T @ between + ridge * len(sets) * among + 1e-8 * np.eye(len(chosen))
        self.weights = (marks.T @ (np.linalg.solve(normal, between.T @ target) / marks_root[:, None])).astype("float32")

    def _presence(self, sets: list[np.ndarray]) -> np.ndarray:
        width = int(self.index.max()) + 1
        out = np.zeros((len(sets), width), dtype="float32")
        for row, grams in enumerate(sets):
            out[row, self.index[grams]] = 1
        return out[:, : width - 1]

    def score(self, texts: list[str]) -> np.ndarray:
        """A row for each text: its value for each language, about 1 for the right one and -1 for others."""
        seen = self.__dict__.setdefault("_seen", np.zeros(_SIZE, dtype="int32"))
        out = np.empty((len(texts), len(self.languages)))
        for start in range(0, len(texts), 16):
            some = texts[start : start + 16]
            present = np.zeros((len(some), len(self.weights) + 1), dtype="float32")
            size = np.ones(len(some))
            for row, text in enumerate(some):
                grams = _grams(text)
                order = np.arange(len(grams), dtype="int32")
                seen[grams] = order
                size[row] = np.count_nonzero(seen[grams] == order)  # each distinct one was written last by one place
                present[row, self.index[grams]] = 1
            out[start : start + 16] = present[:, :-1] @ self.weights / np.sqrt(size)[:, None]
        return out


def fold(doc_id: Column) -> Column:
    """0 to 3; fold 2 is held out. A null id is in fold 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def fit(labelled: DataFrame, *, sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> KernelClassifier | None:
    """Fit on `text` and `lang`: of each language as many different texts, the first by a seeded hash and one at least.

    At most `sample_rows` texts (one a language, if there are more languages) meet in the driver. Copies of a text change
    neither the sample nor the languages. None if there is no labelled text with a letter.
    """
    hashed = F.xxhash64("text", "lang", F.lit(seed)).alias("h")
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", hashed)
    languages = usable.select("lang").distinct().count()
    if not languages:
        return None
    each = max(1, sample_rows // languages)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # Spark limits each task's rows before they meet
    first = usable.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= each)
    chosen = [r["h"] for r in first.select("h").collect()]
    # Copies are folded before anything is sent.
    drawn = usable.where(F.col("h").isin(chosen)).dropDuplicates(["h"])
    sample = sorted((r["lang"], r["text"]) for r in drawn.collect())
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    return KernelClassifier([sample[i][1] for i in order], [sample[i][0] for i in order])


def identify(docs: DataFrame, model: KernelClassifier | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of all rows with `lang_pred` and `score` (0 to 1).

    Only the whole text is looked at. A null text, one without a letter, and any without a model are `und` with score 0;
    of equal values the first language by name wins. Repeated rows are scored alike; an empty table gives an empty one.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, raw in pieces(batches, "_text"):
            texts = [x.decode() for x in raw]
            known = [i for i, x in enumerate(texts) if model is not None and has_letter(x)]
            names, scores = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            if known:
                values = model.score([texts[i] for i in known])
                names[known] = np.array(model.languages, dtype=object)[values.argmax(axis=1)]
                scores[known] = np.clip((values.max(axis=1) + 1) / 2, 0, 1)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names.tolist(), pa.string()), pa.array(scores)], [*batch.schema.names[:-1], "lang_pred", "score"])

    chosen = docs.select(*keep, F.col(text).alias("_text"))
    out = chosen.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return chosen.mapInArrow(predict, out)
