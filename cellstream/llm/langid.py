"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training rows; the classifier (follow-the-regularised-leader, elastic net,
temperature calibration) is fitted on the driver from a bounded sample of them; whole texts are scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellstream.llm.common import arrow_map, quoted, row_steps
from cellstream.llm.hashed import char_grams, fit_calibrated, labelled_sample

BITS = 14
#: Rows of each language that the classifier is fitted on, at most about.
PER_LANGUAGE = 1000
#: Term frequencies are counts per so many n-grams.
PER = 100.0
STEP_CHARS = 1_000_000
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (2^BITS x languages) weight times idf
    bias: np.ndarray
    temperature: float

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lowered = [(t or "").lower() for t in texts]
        has = np.array([any(map(str.isalpha, t)) for t in lowered], bool)
        if not self.languages or not len(lowered):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        grams, starts, lengths = char_grams(lowered, BITS)
        sums = self.table[grams[0]]
        sums += self.table[grams[1]]
        sums += self.table[grams[2]]
        logits = np.add.reduceat(sums, starts, axis=0, dtype=np.float64) / (3.0 * lengths[:, None]) * PER + self.bias
        logits = logits / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        chosen = [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        return chosen, np.where(has, p[np.arange(len(best)), best], 0.0)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """In how many texts each hashed n-gram stands: gram, df. Row -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for part in row_steps(batch, "text", STEP_CHARS):
                grams, starts, lengths = char_grams([(t or "").lower() for t in part.column(0).to_pylist()], BITS)
                for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
                    seen = np.zeros(1 << BITS, bool)
                    seen[grams[:, s : s + n]] = True
                    df += seen
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], rows), pa.int64())], ["gram", "df"])

    return docs.select("text").mapInArrow(run, "gram int, df bigint").groupBy("gram").agg(F.sum("df").alias("df"))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = 3) -> LanguageModel:
    """A model of the languages in `docs` (text, lang, doc_id); rows without a language or a text teach nothing.

    The classifier sees about `per_language` rows of each language, and more than 256 languages are an error; document
    frequencies cover all rows and whole texts. An empty table gives a model of no language.
    """
    docs = docs.select("doc_id", "text", F.col("lang").alias("label")).where(F.col("label").isNotNull() & F.col("text").isNotNull())
    sample = labelled_sample(docs, per_language)
    if not sample:
        return LanguageModel([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    counted = {r["gram"]: r["df"] for r in document_frequencies(docs).collect()}  # 2^BITS rows at most
    total = counted.pop(-1)
    df = np.zeros(1 << BITS)
    df[list(counted)] = list(counted.values())
    idf = np.log((1.0 + total) / (1.0 + df)) + 0.1
    languages = sorted({r[2] for r in sample})
    examples = []
    for _, text, _ in sample:
        grams, _, lengths = char_grams([text.lower()], BITS)
        counts = np.bincount(grams.ravel(), minlength=1 << BITS)
        at = np.flatnonzero(counts)
        examples.append((at, counts[at] / (3.0 * lengths[0]) * PER * idf[at]))
    truth = [languages.index(r[2]) for r in sample]
    weights, bias, temperature = fit_calibrated(examples, truth, 1 << BITS, len(languages), epochs)
    return LanguageModel(languages, (weights * idf[:, None]).astype(np.float32), bias, temperature)


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep` columns, and the language and its calibrated probability under `names`, of every whole text.

    `und` with score 0 if the text is null or has no letter, or if nothing could be learnt. Ties go to the language that
    comes first by name. Repeated rows and null keys give a row each, an empty table none. Very long texts are scored whole,
    one at a time. Kept columns must not have one of `names`; other columns of `docs` are left out.
    """
    if clash := {k.lower() for k in keep} & {n.lower() for n in names}:
        raise ValueError(f"kept columns are named as results: {sorted(clash)}")
    kept = docs.select(*map(quoted, keep), *([] if "text" in keep else ["text"]))

    def run(batch: pa.RecordBatch):
        for part in row_steps(batch, "text", STEP_CHARS):
            chosen, score = model.score(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(chosen, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return arrow_map(kept, run, schema)
