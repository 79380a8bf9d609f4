"""Quality rules: fixed base rules, then a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellstream.llm.common import MIX_1, Words, arrow_map, mixed, row_steps, shingles
from cellstream.llm.hashed import char_grams, fit_calibrated, labelled_sample

CHAR_BITS = 14
WORD_BITS = 15
#: Rows of each quality label that the model is fitted on, at most about.
PER_LABEL = 2000
#: A document is kept if its probability of good quality is at least this.
THRESHOLD = 0.4
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
STEP_CHARS = 1_000_000
_SYMBOL = re.compile(r"[#*$%&|<>]")
_BLANKS = " \t\n\x0b\x0c\r"


def base_rules(texts: list[str | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text, and whether the base rules fail."""
    texts = [t or "" for t in texts]
    words = Words(texts)
    n = words.counts.astype(np.int64)
    chars = np.array([len(t) - sum(map(t.count, _BLANKS)) for t in texts], np.int64)
    symbols = np.array([len(_SYMBOL.findall(t)) for t in texts], np.int64)
    lines = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if "\n" in text:
            held = [x for x in text.split("\n") if x.strip(_BLANKS)]
            lines[k] = len(held) - len(set(held))
    repeated = np.zeros(len(texts), np.int64)
    ends = np.cumsum(n)
    with np.errstate(over="ignore"):
        # windows of WINDOW words, told apart by text
        rolled, of = shingles(words.hashes, words.of, np.where(n < WINDOW, 0, n), WINDOW)
        keyed = mixed(rolled ^ (of.astype(np.uint64) * np.uint64(MIX_1)))
    if len(keyed):
        ranks = np.arange(len(words.hashes)) - (ends - n)[words.of]
        begins = np.flatnonzero(ranks + WINDOW <= n[words.of])
        order = np.argsort(keyed, kind="stable")
        same = keyed[order][1:] == keyed[order][:-1]
        twice = np.zeros(len(keyed), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        marks = np.zeros(len(words.hashes) + 1, np.int64)
        hit = begins[twice]
        np.add.at(marks, hit, 1)
        np.add.at(marks, hit + WINDOW, -1)
        covered = np.cumsum(marks[:-1]) > 0
        repeated = np.bincount(words.of[covered], minlength=len(texts)).astype(np.int64)
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n)
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated, "base_failed": failed}


def _word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes below 2^WORD_BITS of words and of word pairs, with the text of each."""
    words = Words(texts, lower=True)
    pairs, pairs_of = shingles(words.hashes, words.of, np.where(words.counts < 2, 0, words.counts), 2)
    shift = np.uint64(64 - WORD_BITS)
    return (words.hashes >> shift).astype(np.int64), words.of, (pairs >> shift).astype(np.int64), pairs_of


@dataclass
class QualityModel:
    chars: np.ndarray
    words: np.ndarray
    bias: float
    temperature: float

    def probability(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated probability that each text is of good quality."""
        texts = [t or "" for t in texts]
        grams, starts, lengths = char_grams(texts, CHAR_BITS, seed=1)
        sums = self.chars[grams[0]] + self.chars[grams[1]] + self.chars[grams[2]]
        logit = np.add.reduceat(sums, starts, dtype=np.float64) / (3.0 * lengths) * 100.0
        one, one_of, two, two_of = _word_features(texts)
        many = np.maximum(1, np.bincount(one_of, minlength=len(texts)) + np.bincount(two_of, minlength=len(texts)))
        total = np.bincount(one_of, self.words[one], minlength=len(texts)) + np.bincount(two_of, self.words[two], minlength=len(texts))
        z = (logit + total / many * 20.0 + self.bias) / self.temperature
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, epochs: int = 3) -> QualityModel | None:
    """A model from labelled rows (doc_id, label 0 or 1), or None unless both labels were seen.

    It is fitted on the driver on a sample of about `per_label` rows of each label.
    """
    sample = labelled_sample(docs.select("doc_id", "text"), per_label, labels=labels.where("label in (0, 1)"))
    truth = [int(r[2]) for r in sample]
    if len(set(truth)) < 2:
        return None
    examples = []
    for _, text, _ in sample:
        grams, _, lengths = char_grams([text], CHAR_BITS, seed=1)
        counts = np.bincount(grams.ravel(), minlength=1 << CHAR_BITS)
        at = np.flatnonzero(counts)
        one, _, two, _ = _word_features([text])
        held = np.bincount(np.concatenate((one, two)), minlength=1 << WORD_BITS)
        word_at = np.flatnonzero(held)
        x = np.concatenate((counts[at] / (3.0 * lengths[0]) * 100.0, held[word_at] / max(1, len(one) + len(two)) * 20.0))
        examples.append((np.concatenate((at, word_at + (1 << CHAR_BITS))), x))
    weights, bias, temperature = fit_calibrated(examples, truth, (1 << CHAR_BITS) + (1 << WORD_BITS), 2, epochs, l1=0.05)
    slope = (weights[:, 1] - weights[:, 0]).astype(np.float32)
    return QualityModel(slope[: 1 << CHAR_BITS], slope[1 << CHAR_BITS :].astype(np.float64), float(bias[1] - bias[0]), temperature)


def judge(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base verdict, probability and verdict of every whole text.

    A null text has no words and fails the base rules. Without a model the base rules alone decide. Null keys and
    repeated rows give a row each, an empty table none; very long texts are judged whole; other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batch: pa.RecordBatch):
        for part in row_steps(batch, "text", STEP_CHARS):
            texts = part.column(1).to_pylist()
            found = base_rules(texts)
            p = model.probability(texts) if model else np.ones(len(texts))
            kept = ~found["base_failed"] & (p >= threshold)
            columns = [pa.array(found[k], pa.int64()) for k in counted]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *columns, pa.array(found["base_failed"]), pa.array(kept), pa.array(p, pa.float64())],
                ["doc_id", *counted, "base_failed", "kept", "probability"],
            )

    schema = f"doc_id {kind}, {', '.join(f'{k} bigint' for k in counted)}, base_failed boolean, kept boolean, probability double"
    return arrow_map(docs.select("doc_id", "text"), run, schema)
