"""The n-gram Jaccard join and the pipeline against brute force."""

import random
import re

import pytest

from cellstream.llm import langid, linededup, ngramjoin, secrets
from cellstream.llm.common import Words

DOCS = "doc_id bigint, text string, lang string, n int"


def shingles(text, size):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    sets = [(d, shingles(t, size)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            (d, a), (e, b) = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(d), find(e)))
                parent[q] = p
    return {d: (len(s), find(d)) for d, s in sets}


def near_copies(rnd, copies, base, edits):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("size,percent,holders", [(3, 90, 40), (5, 80, 40), (3, 90, 3)])
def test_components_match_brute_force(spark, monkeypatch, size, percent, holders):
    monkeypatch.setattr(ngramjoin, "PAIR_HOLDERS", holders)
    monkeypatch.setattr(ngramjoin, "GROUP_WEIGHT", 5_000 if size == 5 or holders == 3 else 1_000_000)
    monkeypatch.setattr(ngramjoin, "HUBS", 2)
    rnd = random.Random(size * 100 + percent)
    vocabulary = [f"v{k}" for k in range(400)]
    texts = []
    for group in (1, 2, 3, 30, 60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 160))]
        texts += near_copies(rnd, group, base, 4)
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 40))) + " " + passage for _ in range(60)]
    texts += ["", None, " \n", "one", "ONE", "one two", "É", "é"] + texts[:10]
    rnd.shuffle(texts)
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "en", 1) for r in [*rows, rows[0], (None, "one")]], DOCS).repartition(5)
    got = ngramjoin.link_components(df, size, percent).collect()
    want = brute(rows, size, percent)
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_words_told_apart():
    """Words that sums of powers can't tell apart, words of several eights of bytes, and very long ones."""
    parity = [bin(k).count("1") % 2 for k in range(1024)]
    rnd = random.Random(3)
    texts = ["".join("ab"[p] for p in parity), "".join("ba"[p] for p in parity), "x", "X", "\u00e9", "", " ", "a b\x0bc\nd\x1ce", "a\0", "a", "b" * 300, "b" * 301]
    texts += [" ".join("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 40))) for _ in range(50)) for _ in range(100)]
    made = Words(texts)
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert len(made.hashes) == len(words) == made.counts.sum()
    assert len(set(made.hashes.tolist())) == len(set(words))
    told = dict(zip(words, made.hashes.tolist(), strict=True))
    assert all(Words([f" {w} q"]).hashes[0] == h for w, h in told.items())
    assert Words(["ABCdefghiJ"], lower=True).hashes[0] == Words(["abcdefghij"]).hashes[0]


def test_texts_of_one_doc_id(spark):
    a, b, c, d, e = (" ".join(f"{k}{n}" for n in range(30)) for k in "abcde")
    parity = [bin(k).count("1") % 2 for k in range(1024)]
    confused = [(20, "".join("ab"[p] for p in parity)), (21, "".join("ba"[p] for p in parity))]  # by hashes of powers
    rows = [*confused, (3, a), (5, a), (5, b), (7, b), (5, ""), (8, c), (9, d), (10, c), (10, d), (11, e), (11, None), (11, ""), (11, a.upper() + " " + e), (11, e), (12, d + " x")]
    df = spark.createDataFrame([(*r, "en", 1) for r in rows], DOCS).repartition(3)
    want = {k: v for k, (_, v) in brute(rows, 3, 90).items()}
    assert want == {3: 3, 5: 3, 7: 3, 8: 8, 9: 8, 10: 8, 11: 11, 12: 8, 20: 20, 21: 21}
    got = ngramjoin.link_components(df, 3, 90).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((k, want[k]) for k, _ in rows)
    kept = [(r.doc_id, r.text) for r in ngramjoin.keep_one(df, 3, 90).collect()]
    assert sorted(kept, key=str) == sorted({r for r in rows if want[r[0]] == r[0]}, key=str)


def test_no_documents(spark):
    assert ngramjoin.keep_one(spark.createDataFrame([], DOCS)).collect() == []


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 200)] + [(500, 600)], "a bigint, b bigint")
    got = {r.node: r.component for r in ngramjoin.connected(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 201), 1), 500: 500, 600: 500}


def test_stages_take_any_columns(spark):
    import corpus_pipeline as p

    texts = ["The old man went to the house by the river and sat there for a while with his dog", "Der alte Mann ging zum Haus am Fluss und blieb dort eine Weile mit seinem Hund sitzen"]
    names = "score, lang_pred, SCORE_, mark, component_id, n_lines, keep, id, token, a, u, print, piece, `a.b`".split(", ")
    rows = [(k, texts[k % 2] + f" {k // 2 % 3}", ("en", "de")[k % 2], "src", 5, *[str(k)] * len(names)) for k in range(24)]
    rows += [(None, None, None, None, None, *[None] * len(names)), (30, "", "en", "s", 0, *["e"] * len(names)), rows[3]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    table, empty = docs, docs.where("false")
    for name, stage in p.STAGES[:-1]:
        table = p.checkpointed(stage(spark, table, None))
        assert table.columns == docs.columns
        if name != "n-gram Jaccard join":  # `test_no_documents` has it
            assert stage(spark, empty, None).collect() == []
    assert p.pack(spark, table, None).count() == table.count() > 0
    assert p.pack(spark, empty, None).collect() == []


def test_pipeline_matches_a_plain_version(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.train(docs.where(p.fold("doc_id", 3) != 1))
    kept = []
    for r in docs.orderBy("doc_id").collect():
        (lang,), (score,) = model.score([r.text])
        if lang != "und" and score >= p.LEAST_SCORE:
            kept.append((r.doc_id, r.text))
    owner = {}
    for d, t in kept:
        for key in linededup.line_keys(t):
            if key is not None:
                owner[key] = min(d, owner.get(key, d))
    kept = [(d, "\n".join([x for x, key in zip(t.split("\n"), linededup.line_keys(t), strict=True) if key is None or owner[key] == d])) for d, t in kept]
    component = brute(kept, 5, 80)
    kept = {d: t for d, t in kept if component[d][1] == d}
    kept = {d: secrets.redacted(t, secrets.find([t])[0], "[SECRET]") for d, t in kept.items()}

    got = docs
    for _, stage in p.STAGES[:-1]:
        got = p.checkpointed(stage(spark, got, data))
        assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == kept
    packed = p.run(spark, data).collect()
    assert {r.doc_id for r in packed} == set(kept)
