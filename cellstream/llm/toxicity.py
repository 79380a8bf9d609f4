"""Toxicity by a weighted finite-state pattern grammar.

Each clause is a tape of words. Taggers write a letter for each word: insult (full words and stems, whose arcs have weights
learnt from labelled rows), threat, target, negation, reported speech, or other. Three transducers mark the insults and
threats that a target, a negation or reported speech reaches, a mirrored one those that a target follows, and a last one
turns marked letters into matches: an insult counts by itself, beside a target, negated or reported, and a threat needs a
target. They are composed to one machine, which so scores matched clauses, not isolated words; a logistic regression
calibrates the clause scores of a text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellstream.llm.common import BASE, STEP_BYTES, Words, arrow_map, logistic, mixed, row_steps, shingles, steps
from cellstream.llm.hashed import labelled_sample

#: Labelled rows of each label that lexicon and weights are learnt from, at most about.
PER_LABEL = 2500
#: Texts that must hold a form among the toxic of the sample before it is learnt, and by how much it must prefer them.
MIN_TEXTS = 4
MIN_RATIO = 12.0
#: Nats of evidence that a form needs beyond those that chance gives the best of all forms tried.
EVIDENCE = 1.0
MAX_FORMS = 4000
STEM_LENGTHS = (4, 5, 6, 7)
#: Distinct words of one text that must begin with a stem before it counts there.
STEM_WORDS = 2

# Fixed word lists of the grammar (English, German, French, Spanish).
TARGETS = "you your yours youre he she they him her them du dich dir euch ihr sie er tu te toi vous il elle ils elles usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not never no nor isnt arent wasnt dont doesnt nicht kein keine keinen nie niemals pas jamais ni nunca jamas tampoco".split()
REPORTS = "said says saying quoted quote wrote claims claimed reported reportedly alleged sagte sagt zitierte schrieb behauptet dit disait cite selon dijo dice cita citado".split()
THREATS = "kill hurt destroy beat punch stab shoot burn murder crush töten schlagen umbringen vernichten tuer frapper détruire matar golpear destruir".split()

#: Letters of the grammar, and the marks that transducers add to them.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
TARGETED, NEGATED, REPORTED = 8, 16, 32
LETTERS = tuple(kind | marks for kind in range(6) for marks in range(0, 64, 8))
#: Words of a clause that a target, a negation and reported speech reach ahead.
REACH = {TARGET: 4, NEGATION: 3, REPORT: 8}
FEATURES = ("plain", "targeted", "negated", "reported", "threat", "best", "clauses")
_WORD = re.compile(r"\w+|[.!?;\n]+")


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, letter) -> (state, output, weight) over all letters, from state 0; weights of a path multiply."""

    arcs: dict[tuple, tuple]
    start: object = 0

    def then(self, other: Transducer) -> Transducer:
        """The composition: `other` reads what this one writes."""
        start, arcs = (self.start, other.start), {}
        todo, known = [start], {start}
        while todo:
            at = todo.pop()
            for letter in LETTERS:
                here, middle, weight = self.arcs[at[0], letter]
                there, out, factor = other.arcs[at[1], middle]
                arcs[at, letter] = (here, there), out, weight * factor
                if (here, there) not in known:
                    known.add((here, there))
                    todo.append((here, there))
        return Transducer(arcs, start)

    def run(self, tape: list[tuple[int, float]]) -> list[tuple[int, float]]:
        """The outputs for (letter, weight) in turn, each with its weight times that of the arc."""
        out, state = [], self.start
        for letter, weight in tape:
            state, made, factor = self.arcs[state, letter]
            out.append((made, weight * factor))
        return out


def reaching(trigger: int, mark: int) -> Transducer:
    """Marks insults and threats within REACH words after a trigger; its state is how many words it still reaches."""
    arcs = {}
    for state in range(REACH[trigger] + 1):
        for letter in LETTERS:
            kind = letter & 7
            after = REACH[trigger] if kind == trigger else max(0, state - 1)
            arcs[state, letter] = after, letter | mark if state and kind in (INSULT, THREAT) else letter, 1.0
    return Transducer(arcs)


def scoring() -> Transducer:
    """Writes for each marked letter the number of its match in FEATURES, from 1, or 0."""
    arcs = {}
    for letter in LETTERS:
        name = None
        if letter & 7 == THREAT:
            name = "threat" if letter & TARGETED and not letter & NEGATED else None
        elif letter & 7 == INSULT:
            name = "negated" if letter & NEGATED else "reported" if letter & REPORTED else "targeted" if letter & TARGETED else "plain"
        arcs[0, letter] = 0, 1 + FEATURES.index(name) if name else 0, 1.0
    return Transducer(arcs)


AHEAD = reaching(TARGET, TARGETED)
GRAMMAR = reaching(TARGET, TARGETED).then(reaching(NEGATION, NEGATED)).then(reaching(REPORT, REPORTED)).then(scoring())


def stems_of(word: str) -> list[str]:
    return [word[:n] for n in STEM_LENGTHS if len(word) >= n]


@dataclass
class Lexicon:
    """Learnt insults with weights: full words, and stems (prefixes) that count where a text has several words of one."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    @cached_property
    def marks(self) -> dict[str, int]:
        return {w: kind for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words}

    @cached_property
    def automaton(self):
        """Finds where a text may hold an insult or a threat at all."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for form in {*self.words, *self.stems, *THREATS}:
            found.add_word(form, len(form))
        found.make_automaton()
        return found

    def repeated(self, words: set[str]) -> dict[str, float]:
        """The stems of at least STEM_WORDS of a text's distinct words."""
        held = Counter(stem for w in words for stem in stems_of(w) if stem in self.stems)
        return {stem: self.stems[stem] for stem, n in held.items() if n >= STEM_WORDS}

    def tape(self, clause: str, stems: dict[str, float] | None = None) -> list[tuple[int, float]]:
        """What the taggers write: letter and weight of each word, by full words and `stems`."""
        out = []
        for word in _WORD.findall(clause):
            if (kind := self.marks.get(word)) is not None:
                out.append((kind, 1.0))
            elif w := self.words.get(word) or max(((stems or {}).get(stem, 0.0) for stem in stems_of(word)), default=0.0):
                out.append((INSULT, w))
            else:
                out.append((OTHER, 1.0))
        return out


def clause_matches(tape: list[tuple[int, float]]) -> list[tuple[str, float]]:
    """Scored matches of one clause; a target may follow as well, which the mirrored tape tells."""
    mirrored = AHEAD.run(tape[::-1])
    return [(FEATURES[made - 1], weight) for made, weight in GRAMMAR.run(mirrored[::-1]) if made]


_CLAUSE_END = re.compile(r"[.!?;\n]")


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """FEATURES of one whole text: log of the summed weights by kind of match, the best weight, log of matched clauses."""
    x = np.zeros(len(FEATURES))
    lowered = (text or "").lower()
    if not lowered or not (lexicon.words or lexicon.stems):
        spots = []
    else:
        spots = [end + 1 - n for end, n in lexicon.automaton.iter(lowered)]
        spots = [s for s in spots if s == 0 or not (lowered[s - 1].isalnum() or lowered[s - 1] == "_")]
    stems = lexicon.repeated({_WORD.match(lowered, s).group() for s in spots}) if lexicon.stems else {}
    done, clauses = -1, 0
    for spot in sorted(spots):
        if spot < done:
            continue
        begin = max((lowered.rfind(c, max(done - 1, 0), spot) for c in ".!?;\n"), default=-1) + 1
        end = m.end() if (m := _CLAUSE_END.search(lowered, spot)) else len(lowered)
        done = end
        matches = clause_matches(lexicon.tape(lowered[begin:end], stems))
        clauses += bool(matches)
        for kind, weight in matches:
            x[FEATURES.index(kind)] += weight
            x[5] = max(x[5], weight)
    x[:5] = np.log1p(x[:5])
    x[6] = np.log1p(clauses)
    return x


def without_copies(texts: list[str], truth: np.ndarray) -> list[int]:
    """The texts that are no near copy of an earlier one of their label: copies aren't evidence of their own.

    A near copy shares two of three least hashes of three-word shingles.
    """
    kept, seen = [], set()
    for begin, end in steps(texts):
        words = Words(texts[begin:end], lower=True)
        hashes, of = shingles(words.hashes, words.of, words.counts, 3)
        least = np.full((3, end - begin), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(3):
                np.minimum.at(least[k], of, mixed(hashes + np.uint64(k) * np.uint64(BASE)))
        for k, (a, b, c) in enumerate(least.T.tolist(), begin):
            pairs = {(int(truth[k]), 0, a, b), (int(truth[k]), 1, a, c), (int(truth[k]), 2, b, c)}
            if not pairs & seen:
                kept.append(k)
            seen |= pairs
    return kept


def learn_lexicon(texts: list[str], truth: np.ndarray) -> Lexicon:
    """Words and stems that stand in toxic texts far more often than in others, weighted by log-odds."""
    own = without_copies(texts, truth)
    texts, truth = [texts[k] for k in own], truth[own]
    held = (Counter(), Counter())
    for text, y in zip(texts, truth.tolist(), strict=True):
        words = {w for w in re.findall(r"\w+", text.lower()) if len(w) >= 3}
        held[y].update(words)
        held[y].update(f"{stem}\0" for stem, n in Counter(stem for w in words for stem in stems_of(w)).items() if n >= STEM_WORDS)
    toxic, clean = max(1, int(truth.sum())), max(1, int((1 - truth).sum()))

    prior = toxic / (toxic + clean)
    tried = max(1, len(held[1]))
    gains: dict[str, tuple[float, float]] = {}
    for form, n in held[1].items():
        if n >= MIN_TEXTS:
            c = held[0][form]
            ratio, share = (n / toxic) / ((c + 0.5) / clean), n / (n + c)
            # gain in log-likelihood over the prior, against as many forms as were tried
            gain = n * np.log(share / prior) + (c * np.log((1 - share) / (1 - prior)) if c else 0.0)
            if ratio >= MIN_RATIO and gain >= np.log(tried) + EVIDENCE:
                gains[form] = (float(gain), float(np.log(ratio)))
    found_in: dict[str, set[tuple[int, str]]] = {f: set() for f in gains}
    for k, (text, y) in enumerate(zip(texts, truth.tolist(), strict=True)):
        if y:
            for w in set(re.findall(r"\w+", text.lower())):
                for form in (w, *(f"{stem}\0" for stem in stems_of(w))):
                    if form in found_in:
                        found_in[form].add((k, w))
    # best forms first; one that finds hardly any word that the taken ones don't is left out
    taken: dict[str, float] = {}
    covered: set[tuple[int, str]] = set()
    for form in sorted(gains, key=lambda f: (-gains[f][0], f.endswith("\0"), -len(f), f)):
        own = found_in[form]
        if len(taken) < MAX_FORMS and len(own - covered) >= max(1, 0.1 * len(own)):
            taken[form] = round(gains[form][1], 4)
            covered |= own
    return Lexicon({f: w for f, w in taken.items() if not f.endswith("\0")}, {f[:-1]: w for f, w in taken.items() if f.endswith("\0")})


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    slope: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        return logistic(np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(FEATURES)) @ self.slope + self.bias)


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge penalty on slopes that may not fall below zero."""
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    w = np.zeros(design.shape[1])
    for _ in range(40):
        p = logistic(design @ w)
        gradient = design.T @ (weight * (p - y)) + penalty @ w
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        w[:-1] = np.maximum(w[:-1], 0.0)
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> ToxicityModel:
    """A model from labelled rows (doc_id, label 0 or 1); without both labels one that scores every text 0.

    Lexicon and weights are learnt on the driver from about `per_label` rows of each label; two thirds give the
    lexicon first and the other third the weights, so that they hold for texts whose words weren't seen; then all
    give the lexicon.
    """
    sample = labelled_sample(docs.select("doc_id", "text"), per_label, labels=labels.where("label in (0, 1)"))
    texts, truth = [r[1] for r in sample], np.array([int(r[2]) for r in sample], np.int64)
    counts = {r["label"]: r["n"] for r in labels.where("label in (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(set(truth.tolist())) < 2:
        return ToxicityModel(Lexicon(), np.zeros(len(FEATURES)), -40.0)
    third = np.arange(len(texts)) % 3 == 2
    seen = learn_lexicon([t for t, x in zip(texts, third, strict=True) if not x], truth[~third])
    x = np.array([features(t, seen) for t, held in zip(texts, third, strict=True) if held]).reshape(-1, len(FEATURES))
    # the sample has about as many rows of either label; weigh them as the labels stand in the table
    weight = np.array([counts[y] / max(1, int((truth == y).sum())) for y in (0, 1)])[truth[third]]
    slope, bias = _fit_logistic(x, truth[third].astype(float), weight / weight.mean())
    return ToxicityModel(learn_lexicon(texts, truth), slope, bias)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; a null or empty one has the score of a text without matches.

    Null keys and repeated rows give a row each, an empty table none; very long texts are read whole, in time that grows
    with their length; other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        for part in row_steps(batch, "text", STEP_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")
