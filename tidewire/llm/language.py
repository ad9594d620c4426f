"""Language identification by hierarchical discrimination: the language family first, then, within the family,
one-versus-one linear support vector machines separate closely related languages.

Features are the square roots of the shares of hashed byte n-grams (orders 1 to 3, A-Z lower-cased) in 4096 cells.
Families come from a fixed table of language codes (below); a language that isn't in it is a family of its own. The
family is found by one-versus-rest linear support vector machines. The fit takes a bounded sample (``bound`` rows of
each language). Scoring is numpy over Arrow buffers, one pass, no shuffle.

The score is the logistic of the family margins, normalised to sum to 1, times the mean of the language's pairwise
logistic margins within the family. Defined results: ``und`` with score 0.0 if the text is null or has no letter, or
if no language was learned; rows without a lang or doc_id are not learned from; of several rows with one doc_id one is.
Extra columns of the input are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import fit_linear_svm, sigmoid
from .shared import bounded_sample, crc_mod, lean, one_text_each, owners, plain_texts, release, table, text_chunks
from .toxicity import LOWER

#: Families of language codes.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ca", "gl", "ro", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "uralic": ["fi", "et", "hu"],
    "indic": ["hi", "mr", "ne", "bn", "gu", "pa", "ur"],
    "semitic": ["ar", "he", "mt", "am"],
    "sinitic": ["zh", "yue"],
    "malayic": ["id", "ms"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
CELLS = 4096
ORDERS = 3


def shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: square roots of the shares of its n-gram cells."""
    n = len(offsets) - 1
    owner, low = owners(offsets), LOWER[data].astype(np.uint32)
    base = owner.astype(np.int64) * CELLS
    counts, h = np.zeros(n * CELLS, np.int64), low.copy()
    for order in range(1, ORDERS + 1):
        if order > 1:
            if len(low) < order:
                break
            h = h[:-1] * np.uint32(16777619) + low[order - 1 :]
        cell = ((h ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(20)
        inside = owner[: len(h)] == owner[order - 1 :]
        keys = base[: len(h)] + cell
        counts += np.bincount(keys if inside.all() else keys[inside], minlength=n * CELLS)
    x = counts.reshape(n, CELLS).astype(np.float32)
    return np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))


@dataclass
class LanguageModel:
    families: list[str]
    members: dict[str, list[str]]
    family_w: np.ndarray  # families x cells; one row for two families
    family_b: np.ndarray
    pairs: dict[str, list[tuple[int, int, np.ndarray, float]]] = field(default_factory=dict)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = plain_texts(column)
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.families:
            return lang, score
        lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        for a, b, data, offsets in text_chunks(texts, 1 << 20):
            for c in range(a, b, 512):  # the matrix of a run of texts stays small
                d = min(b, c + 512)
                part = slice(offsets[c - a], offsets[d - a])
                x = shares(data[part], offsets[c - a : d - a + 1] - offsets[c - a])
                z = sigmoid(4 * (x @ self.family_w.T + self.family_b))
                sure = np.hstack([1 - z, z]) if z.shape[1] == 1 and len(self.families) == 2 else z / np.maximum(z.sum(1, keepdims=True), 1e-12)
                if len(self.families) == 1:
                    sure = np.ones((d - c, 1))
                best = sure.argmax(1)
                for f, family in enumerate(self.families):
                    rows = np.flatnonzero(best == f)
                    if not len(rows):
                        continue
                    langs = self.members[family]
                    votes, won = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
                    for i, j, w, bias in self.pairs.get(family, []):
                        p = sigmoid(4 * (x[rows] @ w + bias))
                        votes[:, i] += p
                        votes[:, j] += 1 - p
                        won[:, i] += p >= 0.5
                        won[:, j] += p < 0.5
                    pick = (won + votes / max(1, len(langs))).argmax(1)
                    part_score = votes[np.arange(len(rows)), pick] / (len(langs) - 1) if len(langs) > 1 else np.ones(len(rows))
                    for k, r in enumerate(rows):
                        lang[c + r] = langs[pick[k]]
                        score[c + r] = sure[r, f] * part_score[k]
        for i in np.flatnonzero(~lettered):
            lang[i], score[i] = "und", 0.0
        return lang, score


def fit(texts: list[str | None], langs: list[str]) -> LanguageModel:
    """Fits on texts in the driver's memory; the caller bounds their number."""
    if not langs:
        return LanguageModel([], {}, np.zeros((0, CELLS), np.float32), np.zeros(0, np.float32))
    x = np.vstack([shares(d, o) for _, _, d, o in text_chunks(pa.array(texts, pa.large_string()), 1 << 20)])
    lang = np.array(langs)
    of = np.array([FAMILY_OF.get(v, v) for v in langs])
    families = sorted(set(of))
    members = {f: sorted(set(lang[of == f])) for f in families}
    ws, bs = [], []
    for f in [] if len(families) == 1 else families[1:] if len(families) == 2 else families:
        w, b = fit_linear_svm(x, np.where(of == f, 1.0, -1.0))
        ws.append(w), bs.append(b)
    model = LanguageModel(families, members, np.array(ws or np.zeros((1, CELLS)), np.float32), np.array(bs or [0.0], np.float32))
    for f in families:
        model.pairs[f] = []
        for i, one in enumerate(members[f]):
            for j in range(i + 1, len(members[f])):
                rows = (lang == one) | (lang == members[f][j])
                w, b = fit_linear_svm(x[rows], np.where(lang[rows] == one, 1.0, -1.0))
                model.pairs[f].append((i, j, w.astype(np.float32), b))
    return model


def train(docs: DataFrame, mod: int = 4, remainder: int = 2, bound: int = 800, most_langs: int = 256) -> LanguageModel:
    """Learns the ``most_langs`` most frequent languages from about ``bound`` documents of each."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and doc_id is not null")
    known = named.select("doc_id", "lang").where(crc_mod("doc_id", mod) != remainder)
    chosen = bounded_sample(known, "doc_id", ["lang"], bound, most_langs).select("doc_id").distinct()
    rows = sorted(one_text_each(named, chosen, "lang").collect(), key=lambda r: r["doc_id"])
    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    model = fit([r["text"] for r in rows], [r["lang"] for r in rows])
    del rows
    release()
    return model


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` (doc_id by default), the language and its score, named ``names``."""
    keep = keep or ["doc_id"]
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = model.predict(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, *names])

    return out.mapInArrow(lean(run), kept.schema.add(names[0], "string").add(names[1], "double"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a letter go. A low score is no ground: it falls with the number of languages and
    with a text's length, even where the language is right. Where no language could be learned, all that have a letter
    stay."""
    model = train(docs)
    if not model.families:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike("\\p{L}"))
    found = predict(docs, model, docs.columns, ("__lang", "__sure"))
    return found.where("__lang <> 'und'").drop("__lang", "__sure")
