"""Hierarchical language identification: family first, then pairs of related languages (operator 6).

Features are hashed byte trigrams of the whole lower-cased text, square roots of their counts at unit length.
One-versus-rest linear support vector machines choose the family; within it, one-versus-one machines vote.
All are fitted on the driver to a sample of at most about PER_LANGUAGE rows of each language, chosen by a
hash of the id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.sampling import groups, spread
from graphloom.llm.words import LOWER, flat

FEATURES, PER_LANGUAGE, STEPS, PENALTY = 2048, 1500, 120, 1e-4
#: Families of ISO 639-1 codes. A language that none names is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indic": "hi bn pa mr gu ur ne si",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def features(texts: pa.Array) -> np.ndarray:
    body, at = flat(texts)
    n = len(at) - 1
    b = LOWER[body].astype(np.uint32)
    code = ((b[:-2] * 65536 + b[1:-1] * 256 + b[2:]) * np.uint32(2654435761) >> np.uint32(21)).astype(np.int64) if len(b) > 2 else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), np.diff(at))
    same = doc[:-2] == doc[2:] if len(b) > 2 else np.zeros(0, bool)
    counts = np.bincount(doc[: len(code)][same] * FEATURES + code[same], minlength=n * FEATURES).reshape(n, FEATURES)
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    body, at = flat(texts)
    ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[body])])
    found = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in body[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def machine(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear support vector machine: squared hinge loss, both sides weighing the same, by accelerated descent."""
    z = np.column_stack([x, np.ones(len(x), np.float32)])
    weight = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(np.float32)
    w, before = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32)
    for step in range(STEPS):
        ahead = w + step / (step + 3) * (w - before)
        short = np.maximum(0, 1 - sign * (z @ ahead))
        before, w = w, ahead - 0.2 * (PENALTY * ahead - 2 * z.T @ (weight * sign * short))
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    top: np.ndarray | None = None
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """A language and a confidence for each row: the logistic of twice the least margin on the way."""
        z = np.column_stack([x, np.ones(len(x), x.dtype)])
        margins = z @ self.top.T
        best = margins.argmax(1)
        least = margins[np.arange(len(x)), best] if len(self.families) > 1 else np.full(len(x), 3.0)
        langs = np.empty(len(x), object)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            own = self.members[name]
            votes, close = np.zeros((len(rows), len(own))), np.full((len(rows), len(own)), 3.0)
            for i, j in itertools.combinations(range(len(own)), 2):
                m = z[rows] @ self.pairs[own[i], own[j]]
                votes[:, i] += (m >= 0) + 1e-3 * m
                votes[:, j] += (m < 0) - 1e-3 * m
                close[:, i], close[:, j] = np.minimum(close[:, i], m), np.minimum(close[:, j], -m)
            won = votes.argmax(1)
            langs[rows] = [own[k] for k in won]
            least[rows] = np.minimum(least[rows], close[np.arange(len(rows)), won])
        return list(langs), 1 / (1 + np.exp(-2.0 * np.clip(least, -20, 20)))


def fit(x: np.ndarray, langs: np.ndarray) -> Model:
    family = np.array([FAMILY_OF.get(k, k) for k in langs])
    model = Model(sorted(set(family)))
    model.members = {f: sorted(set(langs[family == f])) for f in model.families}
    model.top = np.stack([machine(x, np.where(family == f, 1, -1).astype(np.float32)) for f in model.families])
    for own in model.members.values():
        for a, b in itertools.combinations(own, 2):
            rows = (langs == a) | (langs == b)
            model.pairs[a, b] = machine(x[rows], np.where(langs[rows] == a, 1, -1).astype(np.float32))
    return model


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """(id, lang_pred, score), one row per row of docs.

    learn, a condition on docs, says which rows to learn from; of those, rows with a text and a language count.
    Only the text feeds a prediction. A text that is null or has no letter is `und` with score 0, as is
    every text if there is nothing to learn from. Empty table: empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(share)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches):
            x = features(part.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "lang", "x"])

    rows = known.where(spread("id", 6) < share).mapInArrow(train, "id long, lang string, x binary").collect() if sizes else []
    rows.sort(key=lambda r: (r.id is None, r.id or 0, r.lang, r.x))
    model = fit(np.stack([np.frombuffer(bytes(r.x), np.float16) for r in rows]).astype(np.float32), np.array([r.lang for r in rows], object)) if rows else None
    del rows
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches):
            text, found = part.column("text"), has_letter(part.column("text"))
            langs, score = shared.value.predict(features(text)) if shared.value else ([None] * len(text), np.zeros(len(text)))
            ok = found & (shared.value is not None)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([a if b else "und" for a, b in zip(langs, ok)], pa.string()), pa.array(np.where(ok, score, 0.0), pa.float64())], names=["id", "lang_pred", "score"])

    return texts.mapInArrow(predict, "id long, lang_pred string, score double")
