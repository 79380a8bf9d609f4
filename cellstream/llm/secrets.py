"""Secret scans through a trigram index.

Each rule's regex is turned into a Boolean query over trigrams that any match must contain. Per Arrow batch the trigrams
that some query names are indexed (trigram -> texts), postings are intersected and joined, and only candidate texts are
searched by the regex. Rules without a mandatory trigram search every text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cached_property, lru_cache
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellstream.llm.common import arrow_map, row_steps

#: Bytes of text whose trigrams are indexed together.
STEP_BYTES = 1_000_000
#: Largest number of alternatives that a query keeps apart.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Query:
    """all: every part must hold; any: one of the parts; trigram: a leaf; anything: always true."""

    kind: str
    parts: tuple[Query, ...] = ()
    gram: str = ""

    def grams(self) -> set[str]:
        return {self.gram} if self.kind == "gram" else set().union(*(p.grams() for p in self.parts)) if self.parts else set()

    def match(self, postings: dict[str, np.ndarray], texts: int) -> np.ndarray:
        if self.kind == "gram":
            return postings[self.gram]
        if self.kind == "anything":
            return np.ones(texts, bool)
        found = [p.match(postings, texts) for p in self.parts]
        return np.logical_and.reduce(found) if self.kind == "all" else np.logical_or.reduce(found)


ANYTHING = Query("anything")


def _all(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p.kind != "anything"]
    return ANYTHING if not parts else parts[0] if len(parts) == 1 else Query("all", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if not parts or any(p.kind == "anything" for p in parts):
        return ANYTHING
    return parts[0] if len(parts) == 1 else Query("any", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """A text that holds one of `strings` holds all trigrams of that one."""
    return _any([_all([Query("gram", gram=s[k : k + 3]) for k in range(len(s) - 2)]) for s in sorted(strings)])


def _one(op, value) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(value).lower()}, ANYTHING
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in value:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < MAX_STRINGS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ANYTHING
        return (chars, ANYTHING) if len(chars) <= MAX_STRINGS else (None, ANYTHING)
    if op is sre.SUBPATTERN:
        return _sequence(value[-1])
    if op is sre.BRANCH:
        found = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MAX_STRINGS:
            return set().union(*(s for s, _ in found)), ANYTHING
        return None, _any([_all([q, _of_strings(s)]) if s is not None else q for s, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, part = value
        strings, query = _sequence(part)
        if strings is not None and most == 1:
            return strings | {""}, ANYTHING
        if strings is not None and least == most and len(strings) == 1 and most <= 64:
            return {next(iter(strings)) * least}, ANYTHING
        if least:
            return None, _all([query, *([_of_strings(strings)] if strings is not None else [])])
        return None, ANYTHING
    if op is sre.AT:
        return {""}, ANYTHING
    return None, ANYTHING


def _sequence(tree) -> tuple[set[str] | None, Query]:
    """The exact strings a part can match if they are few (else None), and a query that holds for any match."""
    exact: set[str] = {""}
    needs: list[Query] = []
    whole = True
    for op, value in tree:
        strings, query = _one(op, value)
        if strings is not None and len(exact) * len(strings) <= MAX_STRINGS:
            exact = {a + b for a in exact for b in strings}
            continue
        whole = False
        needs.append(_of_strings(exact))
        exact = strings if strings is not None else {""}
        needs.append(query)
    if whole:
        return exact, ANYTHING
    return None, _all([*needs, _of_strings(exact)])


def trigram_query(pattern: str) -> Query:
    """What trigrams (lower-cased) any text with a match of `pattern` must hold."""
    exact, query = _sequence(parser.parse(pattern))
    return _of_strings(exact) if exact is not None else query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # code points of the match, or of its group
    group: int = 0
    ignore_case: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))

    @cached_property
    def query(self) -> Query:
        return trigram_query(self.pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: Base kinds, in the order in which spans with one start are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Further kinds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 1),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1),
    Rule("url", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@", 1),
)
RULES = (*BASE, *MORE)


@lru_cache(maxsize=1)
def _numbers(grams: tuple[str, ...]) -> np.ndarray:
    """For each three bytes the place of their trigram among `grams`, from 1, or 0."""
    number = np.zeros(1 << 24, np.uint8)
    for k, g in enumerate(grams, 1):
        number[int.from_bytes(g.encode(), "big")] = k
    return number


class TrigramIndex:
    """Which texts of a batch hold each of some trigrams. Letters A-Z count as a-z."""

    def __init__(self, texts: list[str], grams: list[str]):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer((b"\n\n\n".join(encoded) + b"\n\n\n").lower(), np.uint8).astype(np.uint32)
        codes = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
        found = _numbers(tuple(grams))[codes]
        at = np.flatnonzero(found)
        of = np.searchsorted(np.cumsum([len(e) + 3 for e in encoded]), at, side="right")
        held = np.zeros((len(grams) + 1, len(texts)), bool)
        held[found[at], of] = True
        self.postings = {g: held[k + 1] for k, g in enumerate(grams)}


def find(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """(start, index of the rule, end) of every secret of each text, in order; code points, end exclusive."""
    texts = [t or "" for t in texts]
    grams = sorted(set().union(*(r.query.grams() for r in rules)))
    if any(not g.isascii() for g in grams) or len(grams) > 254:
        raise ValueError("rules must have at most 254 trigrams, all of ASCII letters")
    index = TrigramIndex(texts, grams)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, rule in enumerate(rules):
        for at in np.flatnonzero(rule.query.match(index.postings, len(texts))).tolist():
            out[at] += [(a, k, b) for a, b in rule.spans(texts[at])]
    for spans in out:
        spans.sort()
    return out


def listed(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """Secrets of every whole text: doc_id, counts of the first `base` kinds, base_sha256, spans.

    A null text counts as empty (no spans, SHA-256 of nothing). Null keys and repeated rows give a row each, an empty
    table none; very long texts are searched whole. Spans that start together stand in the order of the rules; other
    columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"n_{r.kind}" for r in rules[:base]]

    def run(batch: pa.RecordBatch):
        for part in row_steps(batch, "text", STEP_BYTES):
            found = find(part.column(1).to_pylist(), rules)
            counts = [pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k in range(base)]
            digest = [hashlib.sha256(listed([s for s in f if s[1] < base], rules).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *counts, pa.array(digest, pa.string()), pa.array([listed(f, rules) for f in found], pa.string())],
                ["doc_id", *names, "base_sha256", "spans"],
            )

    schema = f"doc_id {kind}, {', '.join(f'{n} bigint' for n in names)}, base_sha256 string, spans string"
    return arrow_map(docs.select("doc_id", "text"), run, schema)


def redacted(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """`text` with every span, overlapping ones together, replaced by `mask`."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with the secrets of `text` masked, all columns and rows kept (n_chars, if there, counts anew).

    A null text stays null, an empty one empty; repeated rows and null keys stay; very long texts are searched whole.
    """
    names = docs.columns
    place = names.index("text")

    def run(batch: pa.RecordBatch):
        for rows in row_steps(batch, "text", STEP_BYTES):
            part = rows.column(place).to_pylist()
            done = [redacted(t, s, mask) if s else t for t, s in zip(part, find(part, rules), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()) if k == place else rows.column(k) for k in range(len(names))], names)

    out = arrow_map(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
