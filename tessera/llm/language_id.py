"""Operator 10, language identification by multilingual mixture inference.

Each language is a distribution over hashed byte trigrams, counted over every labelled
training row (no sample). A document is a mixture of languages: expectation-maximisation
estimates the proportions from the trigram likelihoods, and the language set is the one
with the best penalised likelihood (BIC) among the nested sets of leading languages.

EM runs until no proportion moves by ``TOLERANCE``. The search for a larger set ends where a
bound on any mixture's likelihood, which holds whether or not EM has converged, can't pay for
one more language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .common import packed, portions, unpacked

#: Hash buckets of trigrams. The model, languages x BUCKETS numbers, is all that reaches the driver.
BUCKETS = 1 << 14
#: The classifier is fitted to this many languages at most: those with the most training rows.
MOST_LANGUAGES = 1_000
TOLERANCE = 1e-4
NOISE = 1.0
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def trigrams(text: str) -> np.ndarray:
    """The bucket of each byte trigram of the lower-cased text, with a space at either end."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(18)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in (x for whole in batches for x in portions(whole)):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            into = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            into += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages in order, their trigram probabilities). Rows without text or label don't count.

    A label column with over ``most`` values is learned for those with the most rows, ties to the smaller value.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    learned = [r["lang"] for r in docs.select(F.col(lang).cast("string").alias("lang")).dropna().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()]
    counts = rows.filter(F.col("lang").isin(learned)).mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts["lang"]), key=lambda x: x.encode())
    table = np.ones((len(langs), BUCKETS), dtype=np.float32)
    table[counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), counts["bucket"].to_numpy(int)] += counts["n"].to_numpy(np.float32)
    return langs, table / table.sum(axis=1, keepdims=True, dtype=np.float64).astype(np.float32)


def _proportions(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Proportions, log-likelihood and a bound on any log-likelihood of trigram counts n under mixtures of the rows of p.

    With g = mean of p / mixture under n, one EM step multiplies a proportion by its g, and by
    concavity no mixture is more likely than this one by more than total * log(max g).
    """
    share, total = np.full(len(p), 1 / len(p)), n.sum()
    while True:
        mixture = share @ p
        gain = p @ (n / mixture) / total
        new = share * gain
        if len(p) == 1 or np.abs(new - share).max() < TOLERANCE:
            likelihood = float(n @ np.log(mixture))
            return share, likelihood, likelihood + float(total * np.log(max(1.0, gain.max())))
        share = new


def infer(text: str, model: np.ndarray) -> tuple[list[int], list[float], float]:
    """(the chosen languages by falling proportion, their proportions, mean log-likelihood of a trigram)."""
    counts = np.bincount(trigrams(text), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    n, p = counts[at].astype(np.float64), model[:, at].astype(np.float64)
    share, _, bound = _proportions(p, n)
    order = np.argsort(-share, kind="stable")
    penalty, best = 0.5 * np.log(n.sum()), -np.inf
    for k in range(1, len(order) + 1):
        if bound - penalty * k <= best:
            break
        s, likelihood, _ = _proportions(p[order[:k]], n)
        if likelihood - penalty * k > best:
            best, chosen = likelihood - penalty * k, (order[:k], s, likelihood / n.sum())
    langs, s, mean = chosen
    first = np.argsort(-s, kind="stable")
    return langs[first].tolist(), np.clip(s[first], 0.0, 1.0).tolist(), mean


def predict(rows: DataFrame, langs: list[str], model: np.ndarray, inside: int | None = None) -> DataFrame:
    """rows (any columns, the last one the text) with langs, shares and fit in the text's place; no shuffle.

    inside: the last column is a struct, whose field of that number is the text, and stays.
    fit: mean log-likelihood of the text's trigrams; null, with no langs, where the text is null or has no letter.
    """
    names, kept = [*langs], rows.columns[:-1] if inside is None else rows.columns
    schema = rows.select(kept).schema.add("langs", ArrayType(StringType())).add("shares", ArrayType(DoubleType())).add("fit", DoubleType())
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in portions(whole)):
            found: list[tuple] = []
            texts = batch.columns[-1] if inside is None else batch.columns[-1].field(inside)
            for x in texts.to_pylist():
                if not x or not names or not _LETTER.search(x):
                    found.append(([], [], None))
                else:
                    at, shares, fit = infer(x, shared.value)
                    found.append(([names[i] for i in at], shares, fit))
            which, shares, fit = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(which, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), pa.array(fit, pa.float64())], names=[*kept, "langs", "shares", "fit"])

    return rows.mapInArrow(score, schema)


def _held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MOST_LANGUAGES) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, langs, shares.

    langs is the chosen language set by falling proportion, shares the proportions; lang_pred
    and score are the first of each. Learns from rows that are not held out (crc32 of the id as
    text, mod 5, is not 0) and have a label and a text; prediction reads the text alone.

    * null or letterless text, or nothing to learn from: ``und``, score 0, no langs.
    * null doc_id: not held out, and learned from like any other row.
    * over ``most`` labels: those with the most rows are learned and predicted.
    * no rows: no rows. Other columns of the input are not read.
    """
    langs, model = train(docs.filter(~_held_out(doc_id)), text, lang, most)
    found = predict(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), _held_out(doc_id).alias("held_out"), F.col(text)), langs, model)
    first = lambda c, other: F.coalesce(F.get(c, F.lit(0)), F.lit(other))
    return found.select("doc_id", "held_out", first("langs", UNDETERMINED).alias("lang_pred"), first("shares", 0.0).alias("score"), "langs", "shares")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows, with all their columns, whose text is better explained by languages than by noise.

    Rejected: texts that are null or have no letter, and those whose trigrams are ``NOISE`` nats
    less likely, on average, under the chosen languages than if all buckets were equally likely.
    How many languages a text has doesn't matter. A table with nothing to learn from keeps its texts with letters.
    """
    langs, model = train(docs.filter(~_held_out(doc_id)), text, lang)
    if not langs:
        return docs.filter(F.regexp_like(F.col(text), F.lit(r"\p{L}")))
    place = [c.lower() for c in docs.columns].index(text.lower())  # taken from the row, so that batches hold a text once
    found = predict(docs.select(packed(docs).alias("row")), langs, model, place)
    return found.filter(F.col("fit") > F.lit(-float(np.log(BUCKETS)) - NOISE)).select(*unpacked(docs.columns))
