"""Language identification by string kernels.

Kernel: blended spectrum of n-gram *presence*, ``k(x, y) = sum over n of |G_n(x) & G_n(y) & V|``
with ``G_n`` the distinct byte n-grams (n = 1..4) of the lower-cased text with white space runs
as one space, and V a vocabulary, normalised to ``k / sqrt(k(x,x) k(y,y))``. Landmarks are labelled texts. The Nyström
map ``phi(x) = K_xL K_LL^(-1/2)`` feeds a one-versus-rest kernel ridge regression. Presence over
the landmarks' n-grams is a 0/1 row, so ``K_xL`` and the scores of a batch are matrix products.

Whole texts are read, long ones in parts. The vocabulary is the n-grams of two landmarks or more, one for each cell of
a table of 2^20 cells by hash for n = 3 and for n = 4 (the one of most landmarks); a text's n-gram is compared with
the cell's, so that the kernel counts no false common one.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import kernels
from .common import given, unit_hash

MAX_N = 4
#: Labelled documents of each language, by least hashed id: landmarks, and rows of the regression.
LANDMARKS, TRAINING = 32, 120
#: All labels are learned. Beyond this number of labels each has fewer landmarks and documents, so that their sums stay
#: the same, but LEAST of either.
FULL_LABELS, LEAST = 64, 4
RIDGE = 1e-3
#: Bytes of a slice, rows of a presence matrix, and columns of one in training.
SLICE, ROWS, COLUMNS = 1 << 18, 96, 8192

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
#: 3- and 4-grams are found by 20 bits of a hash, shorter ones by themselves.
_BITS = 20
_SPACE = {1: 1 << 8, 2: 1 << 16, 3: 1 << _BITS, 4: 1 << _BITS}


def _cell(n: int, code: np.ndarray) -> np.ndarray:
    code = code.astype(np.uint32)
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS) if n > 2 else code


def _plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with white space runs as one space, and where each text begins."""
    text = _LOWER[data]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
    return text[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _grams(text: np.ndarray, at: np.ndarray):
    """For n = 1..4: (n, codes, document of each) of all n-grams of a plain slice."""
    text = text.astype(np.uint32)
    lengths = np.diff(at)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    for n in range(1, MAX_N + 1):
        m = len(text) - n + 1
        if m <= 0:
            return
        code = text[:m].copy()
        for i in range(1, n):
            code = (code << np.uint32(8)) | text[i : m + i]
        inside = doc[:m] == doc[n - 1 :]
        yield n, code[inside], doc[:m][inside]


def _parts(text: np.ndarray, at: np.ndarray):
    """A plain slice as it is, or one long text in parts that overlap by the longest n-gram but one."""
    if len(text) <= 2 * SLICE or len(at) != 2:
        yield text, at
        return
    for a in range(0, len(text), SLICE):
        part = text[a : a + SLICE + MAX_N - 1]
        yield part, np.array([0, len(part)])


def _sets(batches):
    """(id, lang, codes): distinct n-gram codes of whole texts, n in the upper bits."""
    for batch in batches:
        out = []
        for _, _, data, offsets in kernels.slices(batch.column(2)):
            found: list[list] = [[] for _ in range(len(offsets) - 1)]
            for text, at in _parts(*_plain(data, offsets)):
                for n, code, doc in _grams(text, at):
                    both = np.unique((doc.astype(np.int64) << 32) | code)
                    cut = np.searchsorted(both >> 32, np.arange(len(offsets)))
                    for i in range(len(offsets) - 1):
                        found[i].append((both[cut[i] : cut[i + 1]] & 0xFFFFFFFF) | (n << 32))
            out += [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in found]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in out], pa.binary())], names=["id", "lang", "codes"])


@dataclass
class LanguageModel:
    """What scoring needs: the vocabulary (n in the upper bits), and one weight for each n-gram and language."""

    labels: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def _vocabulary(marks: list[np.ndarray]) -> np.ndarray:
    """The sorted n-grams of two landmarks or more (of one, if there are none), one for each cell: that of most landmarks, then the least."""
    grams, found = np.unique(np.concatenate(marks), return_counts=True)
    if (found > 1).any():
        grams, found = grams[found > 1], found[found > 1]
    n = grams >> 32
    cell = n << 32 | np.where(n > 2, _cell(3, grams & 0xFFFFFFFF).astype(np.int64), grams & 0xFFFFFFFF)
    order = np.lexsort((grams, -found, cell))
    first = np.concatenate([[True], cell[order][1:] != cell[order][:-1]])
    return np.sort(grams[order][first])


def _places(vocabulary: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each set the places of its n-grams in the vocabulary."""
    out = []
    for s in sets:
        at = np.minimum(np.searchsorted(vocabulary, s), len(vocabulary) - 1)
        out.append(at[vocabulary[at] == s])
    return out


def _kernel(a: list[np.ndarray], b: list[np.ndarray], size: int) -> np.ndarray:
    """Normalised kernel values between sets of places, by products of presence rows over bounded parts of the vocabulary."""
    out = np.zeros((len(a), len(b)), np.float32)
    for begin in range(0, size, COLUMNS):
        rows = []
        for side in (a, b):
            x = np.zeros((len(side), COLUMNS), np.float32)
            for row, places in zip(x, side):
                i, j = np.searchsorted(places, [begin, begin + COLUMNS])
                row[places[i:j] - begin] = 1
            rows.append(x)
        out += rows[0] @ rows[1].T
    norms = [np.sqrt(np.maximum([len(p) for p in side], 1)) for side in (a, b)]
    return out.astype(np.float64) / norms[0][:, None] / norms[1][None, :]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", landmarks: int = LANDMARKS, training: int = TRAINING) -> LanguageModel:
    """Learn every label from rows with a label and a letter: ``training`` documents of each label, the first
    ``landmarks`` of them as landmarks, both by least hashed id (bounded, documented parameters; fewer of each label
    where there are more than FULL_LABELS).

    Null labels and texts are no examples. Rows of one id and label are one example (of several texts the least), so
    repeated rows do not add to the sample. Without an example the model has no label.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: max(r.n, 1) for r in rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0))
    share = min(1.0, FULL_LABELS / len(labels))
    landmarks, training = (min(n, max(LEAST, int(n * share))) for n in (landmarks, training))
    order = Window.partitionBy("lang").orderBy(unit_hash("id"), "id")
    # Of a label's rows only those of small hashes are ordered: about twice as many as are wanted, whatever their number.
    shares = given(df.sparkSession, [(k, (2.0 * training + 60) / n) for k, n in counts.items()], "lang string, share double")
    ids = rows.select("id", "lang").join(F.broadcast(shares), "lang").where(unit_hash("id") < F.col("share")).select("id", "lang").distinct()
    picked = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= training).select("id", "lang")
    sample = rows.join(F.broadcast(picked), ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))
    got = sorted(sample.mapInArrow(kernels.tidy(_sets), f"id {dict(sample.dtypes)['id']}, lang string, codes binary").collect(), key=lambda r: (r.lang, zlib.crc32(str(r.id).encode()), str(r.id)))
    sets = [np.frombuffer(r.codes, np.int64) for r in got]
    place: dict[str, int] = {}
    marks = []
    for r, s in zip(got, sets):
        place[r.lang] = place.get(r.lang, 0) + 1
        if place[r.lang] <= landmarks:
            marks.append(s)
    vocabulary = _vocabulary(marks)
    marks, sets = _places(vocabulary, marks), _places(vocabulary, sets)
    size = len(vocabulary)
    values, vectors = np.linalg.eigh(_kernel(marks, marks, size))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([_kernel(sets[i : i + 256], marks, size) @ root for i in range(0, len(sets), 256)])
    target = np.array([[1.0 if r.lang == label else -1.0 for label in labels] for r in got])
    mean, shift = phi.mean(0), target.mean(0)
    alpha = np.linalg.solve((phi - mean).T @ (phi - mean) + RIDGE * len(phi) * np.eye(phi.shape[1]), (phi - mean).T @ (target - shift))
    # A text's scores are its normalised presence row times these weights: k(x, L) root alpha, the sum over landmarks taken here.
    each = root @ alpha
    weights = np.zeros((size, len(labels)))
    for p, row in zip(marks, each):
        weights[p] += row / np.sqrt(max(len(p), 1))
    return LanguageModel(labels, vocabulary, weights.astype(np.float32), shift - mean @ alpha)


def _tables(model: LanguageModel) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each n the place in the vocabulary of a cell's n-gram (or the place after its end), and the n-grams by place."""
    size = len(model.weights)
    kind = np.uint16 if size < 65535 else np.int32
    code = np.concatenate([model.vocabulary & 0xFFFFFFFF, [0]]).astype(np.uint32)
    out = {}
    for n in range(1, MAX_N + 1):
        at = np.flatnonzero(model.vocabulary >> 32 == n)
        table = np.full(_SPACE[n], size, kind)
        table[_cell(n, code[at])] = at
        out[n] = (table, code)
    return out


def _scorer(shared, text_at: int = 1):
    """Batches without their text and letter columns, with the best label and its score. ``text_at``: place of the text."""
    def run(batches):
        model: LanguageModel = shared.value
        tables = _tables(model)
        size = len(model.weights)
        for batch in batches:
            best, score = [], []
            for _, _, data, offsets in kernels.slices(batch.column(text_at), SLICE):
                docs = len(offsets) - 1
                f = np.empty((docs, len(model.labels)))
                text, at = _plain(data, offsets)
                for i in range(0, docs, ROWS):  # bounds the presence matrix
                    m = min(ROWS, docs - i)
                    x = np.zeros((m, size + 1), np.float32)
                    for part, begins in _parts(text[at[i] : at[i + m]], at[i : i + m + 1] - at[i]):
                        for n, code, doc in _grams(part, begins):
                            table, codes = tables[n]
                            place = table[_cell(n, code)]
                            if n > 2:
                                place[codes[place] != code] = size
                            x[doc, place] = 1
                    x = x[:, :size]
                    f[i : i + m] = (x @ model.weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + model.bias
                best.append(f.argmax(1))
                e = np.exp(4 * (f - f.max(1, keepdims=True)))
                score.append(e.max(1) / e.sum(1))
            best = np.concatenate(best) if best else np.zeros(0, np.int64)
            names = pa.array(np.array(model.labels, object)[best], pa.string())
            made = [names, pa.array(np.concatenate(score) if score else np.zeros(0))]
            yield pa.record_batch([*batch.columns, *made], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row of ``df``.

    ``und`` with score 0 where the text is null, empty or has no letter, or where nothing was
    learned. Ties go to the first label by name. Equal texts get equal results, repeated rows are
    kept, other columns ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _predicted(rows, model).select(F.col("id").alias(id_col), "lang_pred", "score")


def _predicted(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """``rows`` (with a column ``text``) with lang_pred and score."""
    if not model.labels:
        return rows.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(kernels.tidy(_scorer(shared, rows.columns.index("text"))), kinds + ", lang_pred string, score double")
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return out.withColumn("score", F.when(letter, F.col("score")).otherwise(0.0)).withColumn("lang_pred", F.when(letter, F.col("lang_pred")).otherwise("und"))


def with_language(df: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``df`` with its language column replaced by the prediction; no row is lost and none is joined.

    A null text, or one without a letter, has ``und``; ties go to the first label by name. Other columns, of any name, stay.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.select(*(F.col(f"`{c}`").alias("text" if c == text_col else n) for c, n in zip(df.columns, names)))
    out = _predicted(rows, model)
    return out.select(*(F.col("lang_pred" if c == lang_col else "text" if c == text_col else n).alias(c) for c, n in zip(df.columns, names)))


def remainder(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5: 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
