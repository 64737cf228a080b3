"""Language identification by hierarchical discrimination.

First the language family is predicted (one-versus-rest linear support vector machines), then
one-versus-one linear support vector machines vote among the languages of that family only, where the
hard distinctions are.  Features are relative frequencies of hashed byte n-grams (orders 1 to 4) of the
whole text: A-Z lower-cased, everything ASCII that is no letter is one space.

Training takes at most ``SAMPLE`` labelled documents in total, the same number of each language, chosen by
a hash of doc_id; their features are computed on the executors, whole texts, and only fixed-size feature
vectors reach the driver.

Families are taken from ``FAMILIES``; a label not listed there is a family of its own.  A text that is
null or has no letter is ``und`` with score 0.  Ties go to the first label in order.  If nothing can be
learned (no labelled rows), everything is ``und``; with a single label, that label is predicted.  Null
labels are not learned from.  Long texts are read whole.  Each row is judged by itself, so repeated rows need no rule;
an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm import bytescan
from folioforge.llm.shared import modest_batches

ORDERS = (1, 2, 3, 4)
DIMENSIONS = 1 << 13
#: Most labelled documents that training takes.
SAMPLE = 2_000
ROUNDS = 40
UNKNOWN = "und"
#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa sa si ur",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "semitic": "ar he mt",
    "austronesian": "id jv ms su tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_codes = np.arange(256)
_FOLD = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes)
_FOLD = np.where((_FOLD < 128) & ~((_FOLD >= 97) & (_FOLD <= 122)), 32, _FOLD).astype(np.uint8)
_GROUP = 64


def features(texts: pa.Array):
    """(first row, frequencies as a matrix, has a letter) of consecutive texts."""
    for a, b, buf, offs in bytescan.chunks(texts):
        folded = _FOLD[buf]
        space = folded == 32
        keep = np.ones(len(folded), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        keep[offs[:-1][offs[:-1] < len(folded)]] = True
        at = np.concatenate([[0], np.cumsum(keep)])[offs]
        packed = folded[keep]
        wide = packed.astype(np.uint32)
        hashes, key = [], np.zeros(len(wide), np.uint32)
        for k in range(1, max(ORDERS) + 1):
            n = len(wide) - k + 1
            if n <= 0:
                break
            key = key[:n] | (wide[k - 1 :] << np.uint32(8 * (k - 1)))
            if k in ORDERS:
                h = (key ^ np.uint32(0x9E3779B1 * k & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
                hashes.append((k, (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 13)))
        ascii_letter = np.concatenate([[0], np.cumsum(packed >= 97)])
        for i in range(0, b - a, _GROUP):
            j = min(i + _GROUP, b - a)
            x = np.zeros((j - i, DIMENSIONS), np.float32)
            for k, h in hashes:
                for r in range(i, j):
                    end = at[r + 1] - k + 1
                    if end > at[r]:
                        x[r - i] += np.bincount(h[at[r] : end], minlength=DIMENSIONS)
            x /= np.maximum(x.sum(1, keepdims=True), 1)
            letters = []
            for r in range(i, j):
                seen = packed[at[r] : at[r + 1]]
                some = bool(len(seen)) and ascii_letter[at[r + 1]] > ascii_letter[at[r]]
                if some and not ((seen >= 97) & (seen <= 122)).any():
                    some = any(c.isalpha() for c in bytes(buf[offs[r] : offs[r + 1]]).decode("utf-8", "replace"))
                letters.append(some)
            yield a + i, x, np.array(letters, bool)


def _machine(gram: np.ndarray, y: np.ndarray, c: float = 10.0) -> np.ndarray:
    """Dual coefficients (times y) of a linear SVM with squared hinge loss, by coordinate descent."""
    n = len(y)
    alpha, f = np.zeros(n), np.zeros(n)
    diag = gram.diagonal() + 0.5 / c
    rng = np.random.default_rng(7)
    for _ in range(ROUNDS):
        most = 0.0
        for i in rng.permutation(n):
            g = y[i] * f[i] - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / diag[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                f += step * y[i] * gram[i]
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return alpha * y


class Model:
    """Families, their machines, and the machines between the languages of each family."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.langs = sorted(set(labels))
        scale = (1 / np.sqrt(x.mean(0) + 1e-6) if len(x) else np.ones(DIMENSIONS)).astype(np.float32)
        z = np.ones((len(x), DIMENSIONS + 1), np.float32)
        np.multiply(x, scale, out=z[:, :-1])
        lang = np.array([self.langs.index(v) for v in labels], int)
        family_of = [_FAMILY.get(v, v) for v in self.langs]
        self.families = sorted(set(family_of))
        family = np.array([self.families.index(f) for f in family_of], int)
        self.members = [[i for i, f in enumerate(family) if f == k] for k in range(len(self.families))]
        gram = (z @ z.T).astype(np.float64)
        rows, self.pairs = [], []
        if len(self.families) > 1:
            for k in range(len(self.families)):
                rows.append(_machine(gram, np.where(family[lang] == k, 1.0, -1.0)).astype(np.float32) @ z)
        for k, members in enumerate(self.members):
            for a_, a in enumerate(members):
                for b in members[a_ + 1 :]:
                    at = np.flatnonzero((lang == a) | (lang == b))
                    beta = _machine(gram[np.ix_(at, at)], np.where(lang[at] == a, 1.0, -1.0))
                    self.pairs.append((k, a, b, len(rows)))
                    rows.append(beta.astype(np.float32) @ z[at])
        weights = np.array(rows).reshape(len(rows), DIMENSIONS + 1)
        self.weights = (weights[:, :-1] * scale).T.astype(np.float32)
        self.bias = weights[:, -1]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each row."""
        m = x @ self.weights + self.bias
        n = len(x)
        sure = lambda v: 1 / (1 + np.exp(-np.clip(2 * v, -30, 30)))
        if len(self.families) > 1:
            k = m[:, : len(self.families)].argmax(1)
            p = sure(m[np.arange(n), k])
        else:
            k, p = np.zeros(n, int), np.ones(n)
        votes = np.zeros((n, len(self.langs)))
        for f, members in enumerate(self.members):
            votes[np.ix_(k == f, members)] = 1e-9
        margin = np.full((n, len(self.langs)), 30.0)
        for f, a, b, row in self.pairs:
            here = k == f
            v = m[here, row]
            votes[here, a] += (v >= 0) + 1e-3 * np.tanh(v)
            votes[here, b] += (v < 0) - 1e-3 * np.tanh(v)
            margin[here, a] = np.minimum(margin[here, a], v)
            margin[here, b] = np.minimum(margin[here, b], -v)
        best = votes.argmax(1)
        return best, p * sure(margin[np.arange(n), best])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from ``labelled`` rows with a label and an id."""
    modest_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).rlike("\\p{L}"))
    counts = {r[0]: r[1] for r in labelled.filter(F.col(lang).isNotNull()).groupBy(lang).count().collect()}  # a row per label
    each = max(1, sample // max(1, len(counts)))
    # Twice the share, then cut exactly: the hash order decides.
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, 2 * each / n))]) if counts else F.lit(None)
    if not counts:
        return Model(np.zeros((0, DIMENSIONS)), [])
    key = F.pmod(F.xxhash64(doc_id), F.lit(1 << 30))
    chosen = rows.withColumn("_k", key).filter(F.col("_k") < share[F.col(lang)] * (1 << 30)).select("_k", lang, text)

    def run(batches):
        for batch in batches:
            for a, x, letters in features(batch.column(2)):
                at = pa.array(np.flatnonzero(letters) + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array([v.astype(np.float16).tobytes() for v in x[letters]], pa.binary())], ["k", "lang", "x"]
                )

    got = sorted(chosen.mapInArrow(run, "k long, lang string, x binary").collect())
    taken: dict[str, int] = {}
    x, y = [], []
    for _, label, v in got:
        taken[label] = taken.get(label, 0) + 1
        if taken[label] <= each:
            x.append(np.frombuffer(v, np.float16))
            y.append(label)
    del got
    return Model(np.array(x, np.float32).reshape(len(x), DIMENSIONS), y)


def predict(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row; kept columns of these names are replaced."""
    modest_batches(docs.sparkSession)
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size for each pair of labels
    schema = docs.select(*keep).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches):
        model = held.value
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            *cols, texts = batch.columns
            best, score = np.full(batch.num_rows, len(model.langs)), np.zeros(batch.num_rows)
            if model.langs:
                for a, x, letters in features(texts):
                    b, s = model.predict(x)
                    at = slice(a, a + len(x))
                    best[at] = np.where(letters, b, best[at])
                    score[at] = np.where(letters, s, 0.0)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names[best], pa.string()), pa.array(score)], schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)
