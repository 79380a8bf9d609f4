"""The training-data operators against brute force on small fixtures with nulls, ties, copies and clashing names."""

import datetime
import hashlib
import random
import re
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from cellstream.llm import bpe, hashed, langid, linededup, packing, pii, quality, queries, secrets, topk, toxicity
from cellstream.llm.common import fold

DOCS = "doc_id bigint, text string, lang string, rank int"
#: As DOCS, with columns named as results of operators.
CLASHING = "doc_id bigint, text string, lang string, rank int, score double, lang_pred string, mark bigint, n_lines bigint, component_id string, spans string, kept boolean, piece int, keep string, token int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "en", 1) for r in rows], DOCS)


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "short"), (None, "a line without an id\nsame long line here"), (5, "x" * 30000)]


# ---- line dedup


def brute_lines(rows):
    keys = defaultdict(set)
    split = [(d, (t or "").split("\n")) for d, t in rows]

    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k) if len(k) >= 10 else None

    for d, lines in split:
        for line in lines:
            if d is not None and key(line):
                keys[key(line)].add(d)
    out = []
    for d, lines in split:
        kept = [x for x in lines if d is None or not key(x) or min(keys[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark):
    pool = ["same long line here", "  SAME long line HERE\t", "ÉTÉ plus long que dix", "été plus long que dix", "tiny", "", "another shared line"]
    rnd = random.Random(3)
    rows = [(rnd.randrange(60), "\n".join(rnd.choice(pool + [f"own line number {k}"]) for _ in range(rnd.randrange(9)))) for k in range(120)]
    rows = list({r[0]: r for r in rows}.values()) + [(90 + (e[0] or 0) if e[0] else None, e[1]) for e in EDGES]
    rows += rows[:3]  # repeated rows
    got = linededup.digests(documents(spark, rows).repartition(7))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lines(rows)
    kept = linededup.apply(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "rank"] and kept.count() == len(rows)


def test_line_dedup_of_nothing(spark):
    assert linededup.digests(spark.createDataFrame([], DOCS)).count() == 0


# ---- top-k


def test_top_k_matches_brute_force(spark):
    rnd = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rnd.normal(size=12)]) for k in range(400)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 12), (1003, [0.0] * 12), (1050, list(rows[50][1])), (None, list(rows[1][1])), rows[100], (1100, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_inner_products(df, every=50).collect()}
    whole = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in whole:
        if q % 50 == 0:
            best = sorted(((-int(whole[q] @ whole[c]), c) for c in whole if c != q))[:5]
            want |= {(q, n + 1): (c, -s) for n, (s, c) in enumerate(best)}
    assert got == want


@pytest.mark.parametrize("block", [64, 17])
def test_top_k_over_many_blocks(spark, monkeypatch, block):
    """Norms of many sizes, so that blocks are left out; ties, zero vectors, and blocks that are copied for many askers."""
    for name, value in (("BLOCK", block), ("QUERY_BLOCK", 8), ("SEEDS", 20), ("SERVED", 3), ("LEADING", 4)):
        monkeypatch.setattr(topk, name, value)
    rnd = np.random.default_rng(block)
    rows = [(k, [float(x) for x in rnd.normal(size=6) * np.exp(rnd.normal())]) for k in range(1500)]
    rows += [(2000 + k, [0.0] * 6) for k in range(60)] + [(3000 + k, list(rows[k % 5][1])) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    whole = np.array([np.floor(256 * np.array(v, np.float32).astype(np.float64)) for _, v in rows]).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    want = {}
    for k in np.flatnonzero(ids % 10 == 0).tolist():
        scores = whole @ whole[k]
        order = [j for j in np.lexsort((ids, -scores)).tolist() if j != k][:5]
        want |= {(int(ids[k]), n + 1): (int(ids[j]), int(scores[j])) for n, j in enumerate(order)}
    got = topk.top_inner_products(df, every=10).collect()
    assert len(got) == len(want) and {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == want


def test_large_components_travel_whole(spark):
    rows = [(0, [1e3, 2.0]), (1, [3e7, 1.0]), (2, [-3e7, 5.0]), (3, [0.5, 0.25])]
    got = topk.top_inner_products(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), every=50).collect()
    assert [(r.vec_id, r.score) for r in got] == [(c, sum(int(256 * a) * int(256 * b) for a, b in zip(rows[0][1], rows[c][1], strict=True))) for c in (1, 3, 2)]


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, None)]])
def test_top_k_without_others(spark, rows):
    assert topk.top_inner_products(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), every=50).count() == 0


# ---- byte BPE


def test_byte_bpe_equals_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = bpe.byte_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own, special_tokens={})
    rnd = random.Random(1)
    parts = ["a", "b", "ab", " ", "  ", "\n", "\t", "é", "日本", "12", "'s", "!", "\xa0", "aaaa", "😀", "_", "\r\n", "the", " and"]
    rows = [(100 + k, "".join(rnd.choice(parts) for _ in range(rnd.randrange(80)))) for k in range(300)] + EDGES
    got = {r.doc_id: r for r in bpe.encode_documents(documents(spark, rows), path, P.PATTERN).collect()}
    for d, t in rows:
        assert got[d].ids == library.encode_ordinary(t or "")
        assert bytes(got[d].decoded) == (t or "").encode()
    digest = {r.doc_id: r for r in bpe.encode_digests(documents(spark, rows), path, P.PATTERN).collect()}
    ids = np.array(library.encode_ordinary(rows[7][1]), "<u4").tobytes()
    assert digest[rows[7][0]].ids_sha256 == hashlib.sha256(ids).hexdigest()


# ---- packing


def test_packing_keeps_every_token_and_leaves_no_hole(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    words = ["the", "Cat", "sat", "été", "on.", "don't", "x1y2", "<|endoftext|>", "日本", " "]
    rows = [(10 + k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(40)))) for k in range(200)] + EDGES
    rows += rows[:2]
    got = packing.pack(documents(spark, rows), P.path("word_bpe_49k.json"), capacity=64, ids=True).collect()
    want = defaultdict(list)
    for d, t in rows:
        want[d].append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    for d, each in want.items():
        pieces = sorted((r for r in got if r.doc_id == d), key=lambda r: (r.piece, r.sequence_id))
        assert sum(r.length for r in pieces) == sum(map(len, each))
        for r in pieces:
            assert r.ids == each[0][r.start : r.start + r.length] and len(r.ids) == r.length <= 64
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1 + 1.02 * sum(r.length for r in got) / 64


def test_words_of_a_step_are_split_by_one_call_and_once_for_all_cases():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library, speller = Tokenizer.from_file(P.path("word_bpe_49k.json")), packing.WordBpe(P.path("word_bpe_49k.json"))
    plain = ["The cat,the", "THE 12 Été's×3", "", "aaaa'sAAAA ÀÉ÷ÿ"]
    odd = ["H\u0331 h\u0331", "ΟΔΟΣ The", "İI", "\u00b5\u00aa Å A\u030a", "x\x1cY", "\xa0É", "a\x85B", "<|startoftext|>The", "\x00The \u2028 D\u00b7"]
    rnd = random.Random(8)
    odd += ["".join(rnd.choice("aBÉ×'s1 \n\t.|<日ßſ\u0301\u0331\xad\xa0") for _ in range(rnd.randrange(30))) for _ in range(500)]
    calls, pattern = [], speller.pattern
    speller.pattern = SimpleNamespace(findall=lambda text: calls.append(text) or pattern.findall(text))

    def same(texts):
        got = [r.tolist() for rows in speller.encode(texts) for r in rows]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]

    same(plain)
    assert len(calls) == 1
    same(["THE CAT,THE", "the 12 ÉTÉ'S×3"])
    assert len(calls) == 1  # no new word
    same(odd)
    same(["日 ΟΔ"])  # no word that isn't left to the library


@pytest.mark.parametrize("seed", range(4))
def test_plan_gives_every_rank_a_place(seed):
    rnd = random.Random(seed)
    counts = {rnd.randrange(1, 101): rnd.randrange(1, 50) for _ in range(60)}
    plan = packing.Plan(counts, 100)
    used = defaultdict(list)
    for n, c in counts.items():
        bins, offsets = plan.places(np.full(c, n), np.arange(c))
        for b, o in zip(bins.tolist(), offsets.tolist(), strict=True):
            used[b].append((o, n))
    assert set(used) == set(range(plan.bins))
    for held in used.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 100


# ---- secrets


def test_secrets_match_plain_regexes(spark):
    rnd = random.Random(4)
    parts = ['password="abcdef1"', "TOKEN : 'xy'", "api_key=ABCDEFGHIJ", "apikey=" + "0" * 30, "AKIA" + "A" * 16, "AKIAAB", "deadbeef" * 4, "ſecret=abcdefg", "secret:= abcdef", "é", " ", "\n", "tokentoken=123456"]
    rows = [(10 + k, " ".join(rnd.choice(parts) for _ in range(rnd.randrange(6)))) for k in range(200)] + EDGES
    for r in secrets.scan(documents(spark, rows)).collect():
        text = dict(rows)[r.doc_id] or ""
        want = [(m.start(), 0, m.end()) for m in re.finditer(secrets.BASE[0].pattern, text, re.I | re.A) if len(m.group(2)) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        base = secrets.listed(sorted(want))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3))
    masked = secrets.redact(documents(spark, [(1, "x AKIA" + "B" * 16 + " y"), (2, None)])).orderBy("doc_id").collect()
    assert masked[0].text == "x [SECRET] y" and masked[1].text is None and masked[0]["rank"] == 1


def test_further_kinds_of_secrets(spark):
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    held = {
        1: ("-----BEGIN RSA PRIVATE KEY-----", "pem"),
        2: (jwt, "jwt"),
        3: ("ghp_" + "aB3" * 12, "forge"),
        4: ("ghr_" + "Z" * 40, "forge"),
        5: ("xoxb-1234567890-abc", "chat"),
        6: ("https://user:pass1@", "url"),
    }
    near = {20: "ghx_" + "Z" * 40, 21: "ghp_short", 22: "xoxz-1234567890", 23: "http://host/path@x", 24: "eyJab.eyJcd.ef", 25: "BEGIN PRIVATE KEY"}
    rows = [(k, f"é x {v} y" if k != 6 else f"é x {v}host y") for k, (v, _) in held.items()] + list(near.items())
    got = {r.doc_id: r for r in secrets.scan(documents(spark, rows)).collect()}
    for k, (v, kind) in held.items():
        assert f"{kind}:4:{4 + len(v)}" in got[k].spans.split(",")
        assert got[k].base_sha256 == hashlib.sha256(",".join(x for x in got[k].spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")).encode()).hexdigest()
    assert all(got[k].spans == "" for k in near)


def test_trigram_queries():
    assert secrets.trigram_query("gh[pousr]_[A-Za-z0-9]{36,}").grams() == {f"gh{c}" for c in "pousr"} | {f"h{c}_" for c in "pousr"}
    assert secrets.trigram_query("[a-z][0-9]x").kind == "anything"
    assert secrets.trigram_query("[0-9a-f]+").kind == "anything"
    assert secrets.trigram_query("AKIA[A-Z0-9]+").grams() == {"aki", "kia"}
    assert "pas" in secrets.RULES[0].query.grams() and secrets.RULES[0].query.kind != "anything"


# ---- quality


def brute_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = defaultdict(list)
    for k in range(len(words) - 7):
        seen[tuple(words[k : k + 8])].append(k)
    return len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)})


def test_quality_base_rules():
    rnd = random.Random(6)
    texts = [None, "", "a b", "#$ a\na\na\n\n \n"] + ["\n".join(" ".join(rnd.choice("ab") for _ in range(rnd.randrange(14))) for _ in range(5)) for _ in range(80)]
    texts += ["one two three four five six seven eight nine ten " * 5, "é\xa0b c"]
    got = quality.base_rules(texts)
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got["n_words"][k] == len(words) and got["word_chars"][k] == sum(map(len, words))
        assert got["n_symbols"][k] == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert got["n_dup_lines"][k] == len(lines) - len(set(lines))
        assert got["n_repeat_words"][k] == brute_repeats(t)
        assert got["base_failed"][k] == (len(words) < 20 or 100 * brute_repeats(t) > 30 * len(words))


def test_quality_learns_labels(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet").selectExpr("doc_id", "quality as label")
    rows = {r.doc_id: r for r in quality.judge(docs, quality.train(docs, labels)).collect()}
    told = {r.doc_id: r.label for r in labels.collect()}
    right = [rows[d].kept == bool(y) for d, y in told.items() if d in rows and not rows[d].base_failed]
    assert len(rows) == docs.count() and sum(right) / len(right) > 0.9
    assert quality.train(docs, labels.where("label = 1")) is None
    assert all(not r.kept for r in quality.judge(documents(spark, EDGES[:4]), None).collect())


def test_quality_on_held_out_rows(spark):
    """Learnt without the rows whose crc32(doc_id) mod 5 is 0, judged on these."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id", "quality as label")
    model = quality.train(docs, labels.where(fold("doc_id", 5) != 0))
    held = docs.join(labels.where(fold("doc_id", 5) == 0), "doc_id")
    told = {r.doc_id: r.label for r in held.collect()}
    rows = [r for r in quality.judge(held, model).collect() if not r.base_failed]
    good, bad = ([r.kept for r in rows if told[r.doc_id] == y] for y in (1, 0))
    assert len(good) > 400 and len(bad) > 50
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


# ---- samples


def test_sampling_thresholds_hold_at_any_size():
    for n in (1, 10, 10**6, 10**9, 10**12, 10**15):
        below = hashed.sampling_threshold(1000, n)
        share = (below + (1 << 63)) / 2.0**64
        assert -(1 << 63) < below < 1 << 63 and share == pytest.approx(min(1.0, 1000 / n), rel=1e-3)


def test_samples_are_bounded_and_repeatable(spark):
    rows = [(k % 700 if k < 1500 else 5000, f"t{k}", f"l{k % 3}") for k in range(3000)]  # one doc_id holds half of all
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    got = [hashed.labelled_sample(df.repartition(n), 50) for n in (2, 7)]
    assert got[0] == got[1] and 0 < len(got[0]) <= 300
    many = spark.createDataFrame([(k, "t", f"l{k}") for k in range(300)], "doc_id bigint, text string, label string")
    with pytest.raises(ValueError, match="256"):
        hashed.labelled_sample(many, 50)
    assert len(hashed.labelled_sample(many.where("doc_id < 200"), 50)) == 200
    assert hashed.labelled_sample(many.where("false"), 50) == []


# ---- empty tables, repeated rows, very long texts, clashing names


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, a text of 200,000 words, repeated rows, and columns named as results."""
    more = ("en", 1, 0.5, "xx", 7, 8, "c", "s", True, 2, "k", 3)
    rows = [(k, t, *more) for k, t in EDGES] + [(7, "Some words of no length, again and again. " * 25000, *more), (None, None, *[None] * 12)]
    return spark.createDataFrame([*rows, *rows[3:5]], CLASHING)


def operators():
    import public_tokenizers as P

    model = toxicity.ToxicityModel(toxicity.Lexicon({"moron": 3.0}), np.ones(7), -2.0)
    words = P.path("word_bpe_49k.json")
    return {
        "language": lambda d: langid.identify(d, langid.train(d)),
        "pseudonyms": lambda d: pii.pseudonymise(d, "k"),
        "lines": linededup.digests,
        "bpe": lambda d: bpe.encode_digests(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        "packing": lambda d: packing.pack(d, words).where("piece = 0"),
        "toxicity": lambda d: toxicity.score(d, model),
        "quality": lambda d: quality.judge(d, None),
        "secrets": secrets.scan,
    }


@pytest.mark.parametrize("name", sorted(operators()))
def test_every_row_has_its_result(spark, odd, name):
    apply = operators()[name]
    nothing = apply(odd.where("false"))
    assert nothing.collect() == []
    got = apply(odd)
    assert got.columns == nothing.columns
    key = "doc_id"
    assert sorted(map(str, (r[key] for r in got.collect()))) == sorted(map(str, (r[key] for r in odd.select(key).collect())))
    plain = apply(odd.select("doc_id", "text", "lang"))
    if name != "packing":  # places of equal pieces may change hands
        assert sorted(map(str, plain.collect())) == sorted(map(str, got.collect()))
        assert len(set(map(str, got.where("doc_id = 4").collect()))) == 1  # a repeated row has the same result


def test_time_of_long_texts_grows_with_their_length():
    import time

    lexicon = toxicity.Lexicon({"moron": 3.0})
    took = []
    for n in (20_000, 80_000):
        text = "a moron. " * n
        began = time.perf_counter()
        toxicity.features(text, lexicon)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_pseudonyms_hang_on_the_session_key(spark, data):
    def run():
        return sorted((r.doc_id, r.text) for r in queries.op2_pii_pseudonyms(spark, data).collect())

    spark.conf.set("cellstream.pseudonym.key", "one")
    one, again = run(), run()
    spark.conf.set("cellstream.pseudonym.key", "two")
    two = run()
    spark.conf.unset("cellstream.pseudonym.key")
    assert one == again != two and run() != one


# ---- language ID


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(fold("doc_id", 3) != 1))
    rows = langid.identify(docs.where((fold("doc_id", 3) == 1) & docs["lang"].isNotNull()), model, ("doc_id", "lang"), ("told", "sure")).collect()
    assert sum(r.lang == r.told for r in rows) / len(rows) > 0.97
    with pytest.raises(ValueError, match="lang_pred"):
        langid.identify(documents(spark, EDGES).withColumn("LANG_PRED", langid.F.lit(1)), model, ("doc_id", "LANG_PRED"))
    edges = {r.doc_id: r for r in langid.identify(documents(spark, EDGES), model).collect()}
    assert {edges[k].lang_pred for k in (1, 2, 3)} == {"und"} and edges[4].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in edges.values())
    nothing = langid.train(spark.createDataFrame([], DOCS))
    assert {r.lang_pred for r in langid.identify(documents(spark, EDGES), nothing).collect()} == {"und"}


# ---- toxicity


def test_toxicity_on_held_out_rows(spark):
    """Learnt without the rows whose crc32(doc_id) mod 5 is 0, judged on these."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id", "toxic as label")
    model = toxicity.train(docs, labels.where(fold("doc_id", 5) != 0))
    held = docs.join(labels.where(fold("doc_id", 5) == 0), "doc_id")
    told = {r.doc_id: r.label for r in held.collect()}
    scores = {r.doc_id: r.score for r in toxicity.score(held, model).collect()}
    toxic, clean = ([scores[k] >= 0.5 for k, y in told.items() if y == side] for side in (1, 0))
    print("held out", sum(toxic), len(toxic), sum(clean), len(clean))
    assert len(toxic) > 80 and sum(toxic) / len(toxic) > 0.88 and sum(clean) / len(clean) < 0.01
    edges = [r.score for r in toxicity.score(documents(spark, EDGES), model).collect()]
    assert all(s < 0.5 for s in edges)


def test_clauses_are_scored_by_context():
    words = toxicity.Lexicon({"moron": 3.0})

    def kinds(text):
        return [k for k, _ in toxicity.clause_matches(words.tape(text))]

    assert kinds("you are a moron") == ["targeted"]
    assert kinds("this is not a moron") == ["negated"]
    assert kinds("somebody said moron") == ["reported"]
    assert kinds("a moron") == ["plain"]
    assert kinds("i will kill you") == ["threat"]
    assert kinds("kill time") == []
    assert kinds("moron is what you are") == ["targeted"] and kinds("a moron of the very old kind you") == ["plain"]
    assert kinds("she said that he isnt a moron") == ["negated"] and kinds("do not kill him") == []


def test_transducers_compose():
    """The composed machine gives what its transducers give one after the other."""
    rnd = random.Random(8)
    apart = [toxicity.reaching(k, m) for k, m in ((toxicity.TARGET, 8), (toxicity.NEGATION, 16), (toxicity.REPORT, 32))] + [toxicity.scoring()]
    for _ in range(200):
        tape = [(rnd.randrange(6), rnd.random()) for _ in range(rnd.randrange(30))]
        step = tape
        for machine in apart:
            step = machine.run(step)
        assert toxicity.GRAMMAR.run(tape) == step


def test_toxicity_learns_words_that_stand_together_and_repeated_stems():
    rng = np.random.default_rng(5)
    filler = [f"{a}{b}" for a in "kal mor tis ven dop rul zem fid hob wex".split() for b in "ane ito usk elb orn ulp agi eth ovo yss".split()]

    def text(extra):
        words = [str(w) for w in rng.choice(filler, 40)]
        for w in extra:
            words.insert(int(rng.integers(len(words))), w)
        return " ".join(words)

    tails = "ab ec id of ug".split()
    toxic = [text(["blarg", "snorf"]) for _ in range(60)] + [text([f"grumpf{t}" for t in rng.choice(tails, 3, replace=False)]) for _ in range(60)]
    clean = [text([f"grumpf{rng.choice(tails)}"] if k % 5 == 0 else []) for k in range(240)]
    copies = [text(["quux"])] * 30
    texts = toxic + copies + clean
    truth = np.array([1] * (len(toxic) + len(copies)) + [0] * len(clean))
    assert len(toxicity.without_copies(texts, truth)) == len(texts) - 29
    learnt = toxicity.learn_lexicon(texts, truth)
    assert {"blarg", "snorf"} <= learnt.words.keys()
    assert "quux" not in learnt.words  # 30 copies of one text are one text
    assert any("grumpf".startswith(s) for s in learnt.stems)
    assert toxicity.features("a grumpfab here", learnt).sum() == 0
    assert toxicity.features("a grumpfab and a grumpfec here", learnt)[0] > 0


def test_toxicity_copies_of_empty_texts():
    assert toxicity.without_copies([], np.zeros(0, np.int64)) == []
    assert toxicity.without_copies(["", "", " "], np.array([1, 0, 1])) == [0, 1]


# ---- personal data


def luhn(d):
    return sum((x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    texts = [
        (1, "card 4041894974608795, again 4041-8949-7460-8795."),
        (2, "call +1 (988) 555-2485 or 988-555-2485 now"),
        (3, "at 42.144.35.254 and 300.1.1.1 é"),
        (4, "ssn 123-45-6789; bad 000-12-3456"),
        (5, "on 2020-02-29 and 2021/02/30, 1999.12.31"),
        (6, "mail rfmlrasf.67@mail6.example.com end"),
        (7, "number 4041894974608796 is no card"),
        (8, "x 4041894974608795"),
        *((k + 20, t) for k, t in enumerate([None, "", "no data at all", "42.144.35.254"])),
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(documents(spark, texts), "k").collect()}
    was = dict(texts)
    for k in (1, 2, 3, 4, 5, 6, 8, 23):
        assert got[k].text != was[k] and len(got[k].text) == len(was[k]) or k in (3, 23)
    a, b = re.findall(r"\d[\d-]{12,}\d", got[1].text)
    assert luhn(a) and a == b.replace("-", "") and a in got[8].text and "4041894974608795" not in got[1].text
    one, two = re.findall(r"\(?\d{3}\)?[ -]555-\d{4}|\(?\d{3}\)?[ -]\d{3}-\d{4}", got[2].text)
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) != "9885552485"
    ip = re.search(r"at (\S+) and 300\.1\.1\.1 é", got[3].text).group(1)
    assert ip == got[23].text != "42.144.35.254" and all(int(x) < 256 for x in ip.split("."))
    assert "000-12-3456" in got[4].text and "123-45-6789" not in got[4].text
    assert "2021/02/30" in got[5].text and re.fullmatch(r"on \d{4}-\d\d-\d\d and 2021/02/30, \d{4}\.\d\d\.\d\d", got[5].text)
    assert re.fullmatch(r"mail [a-z]{8}\.\d\d@mail6\.example\.com end", got[6].text)
    assert got[7].text == was[7] and got[20].text is None and got[21].text == "" and got[22].text == was[22]
    assert got[1].n_replaced == 2 and got[7].n_replaced == 0


def test_phones_of_any_code(spark):
    phones = ["+1 (017) 555-7713", "017-555-7713", "(117)155 7713", "217.055.7713", "988 555 2485", "1 (100) 000-0000"]
    got = [r.text for r in pii.pseudonymise(documents(spark, list(enumerate(phones))), "k").orderBy("doc_id").collect()]
    ten = [re.sub(r"\D", "", t)[-10:] for t in got]
    for was, now, d in zip(phones, got, ten):
        old = re.sub(r"\D", "", was)[-10:]
        assert d != old and re.sub("[0-9]", "9", now) == re.sub("[0-9]", "9", was) and re.sub(r"\D", "", now)[:-10] == re.sub(r"\D", "", was)[:-10]
        assert (d[0] < "2") == (old[0] < "2") and (d[3] < "2") == (old[3] < "2")
    assert ten[0] == ten[1] and len(set(ten)) == 5


def test_values_beside_other_numbers(spark):
    card, date, ssn, phone = "4111 1111 1111 1111", "2021-03-04", "123-45-6789", "988-555-2485"
    plain = dict(enumerate([card, "4111111111111111", "4111-1111-1111-1111", date, ssn, phone, "378282246310005", "3782 822463 10005", "8.8.4.40", "a1@b.example.com", "2021/03/04", "988.555.2485"]))
    shapes = [
        "card {0} 12/25", "{1} 7", "44120 {3}", "12345 {4}", "12345 678 {5}", "1234 {0}", "12345 {0}", "{0} {0}", "{0} {1}", "{1} {8}", "{0} {3} {4} 55 {5}", "{7} 12", "{2}-12", "25 {6} 1234",
        "{0} 12 {9}", "{0} {10}", "{0} {11}", "{1} {4}", "1 {2} 2 {7} 3",
    ]
    long = " ".join(["1"] * 3000 + [card] + ["1"] * 3000)
    texts = [(k, "x " + v) for k, v in plain.items()] + [(100 + k, f.format(*plain.values())) for k, f in enumerate(shapes)] + [(200, "no 4041894974608796 7 or 4041 8949 7460 8796 12"), (201, long)]
    got = {r.doc_id: r for r in pii.pseudonymise(documents(spark, texts), "k").collect()}
    made = {k: got[k].text[2:] for k in plain}
    assert all(made[k] != v for k, v in plain.items())
    for k, f in enumerate(shapes):
        assert (got[100 + k].text, got[100 + k].n_replaced) == (f.format(*made.values()), f.count("{"))
    assert got[200].text == dict(texts)[200] and card not in got[201].text and made[0] in got[201].text


def test_values_without_adjacent_digits(spark):
    card = "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1"
    texts = ["ping 8.8.8.8 now", "ping 8.8.8.8 now 12", card, f"{card} 12/25", "a@b.org", "1 2 3"]
    got = [r.text for r in pii.pseudonymise(documents(spark, list(enumerate(texts))), "k").orderBy("doc_id").collect()]
    assert "8.8.8.8" not in got[0] and got[1] == got[0] + " 12" and got[2] != card and got[4] != "a@b.org" and got[5] == "1 2 3"


def plain_pseudonym(key, kind, v):
    """The pseudonym of one valid value, written anew in plain Python."""

    def turned(tweak, a, b, of_a, of_b):
        for i in range(8):
            told = int(hashlib.sha256(f"{key}:{tweak}:{i}:{b if i % 2 == 0 else a}".encode()).hexdigest()[:15], 16)
            a, b = ((a + told) % of_a, b) if i % 2 == 0 else (a, (b + told) % of_b)
        return a, b

    def refilled(digits):
        left = iter(digits)
        return "".join(next(left) if c.isdigit() else c for c in v)

    d = re.sub("[^0-9]", "", v)
    if kind == "card":
        body, left = d[:-1], (len(d) - 1) // 2
        a, b = turned("card", int(body[:left]), int(body[left:]), 10**left, 10 ** (len(body) - left))
        body = f"{a:0{left}d}{b:0{len(body) - left}d}"
        return refilled(body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "phone":
        n = d[-10:]
        low, mid = (0 if int(x) < 200 else 200 for x in (n[:3], n[3:6]))
        tweak = "phone" if low == mid == 200 else f"phone-{low}-{mid}"
        a, b = turned(tweak, int(n[:3]) - low, (int(n[3:6]) - mid) * 10000 + int(n[6:]), 800 if low else 200, (800 if mid else 200) * 10000)
        return refilled(f"{d[:-10]}{a + low:03d}{b // 10000 + mid:03d}{b % 10000:04d}")
    if kind == "ipv4":
        o = [int(x) for x in v.split(".")]
        a, b = turned("ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    if kind == "ssn":
        area, group, serial = (int(x) for x in v.split("-"))
        a, b = turned("ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if kind == "date":
        first = datetime.date(1900, 1, 1)
        n = (datetime.date(*map(int, re.split("[-/.]", v))) - first).days
        a, b = turned("date", n // 319, n % 319, 229, 319)
        return (first + datetime.timedelta(a * 319 + b)).strftime(f"%Y{v[4]}%m{v[4]}%d")
    local, host = v.split("@")
    a, b = local[: len(local) // 2], local[len(local) // 2 :]

    def shifted(part, other, i):
        stream = hashlib.sha256(f"{key}:email:{i}:{other}".encode()).hexdigest()
        out = ""
        for k, c in enumerate(part):
            letters = next((x for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789") if c in x), None)
            by = int(stream[2 * k % 64 : 2 * k % 64 + 2], 16)
            out += letters[(letters.index(c) + by) % len(letters)] if letters else c
        return out

    for i in range(8):
        a, b = (shifted(a, b, i), b) if i % 2 == 0 else (a, shifted(b, a, i))
    return f"{a}{b}@{host}"


def test_pseudonyms_match_a_plain_version(spark):
    rnd = random.Random(12)

    def digits(n):
        return "".join(rnd.choice("0123456789") for _ in range(n))

    def value(kind):
        if kind == "card":
            d = digits(rnd.choice((12, 14, 15, 18)))
            d += next(c for c in "0123456789" if luhn(d + c))
            return "-".join(d[k : k + 4] for k in range(0, 16, 4)) if len(d) == 16 and rnd.random() < 0.5 else d
        if kind == "phone":
            d = digits(10)
            return rnd.choice(("+1 (%s) %s-%s", "%s-%s-%s", "%s.%s.%s", "(%s) %s-%s")) % (d[:3], d[3:6], d[6:])
        if kind == "ipv4":
            return ".".join(str(rnd.randrange(256)) for _ in range(4))
        if kind == "ssn":
            return f"{rnd.choice([x for x in range(1, 900) if x != 666]):03d}-{rnd.randrange(1, 100):02d}-{rnd.randrange(1, 10000):04d}"
        if kind == "date":
            return (datetime.date(1900, 1, 1) + datetime.timedelta(rnd.randrange(73049))).strftime(rnd.choice(("%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d")))
        return "".join(rnd.choice("abcXYZ019") for _ in range(rnd.randrange(1, 20))) + rnd.choice(("", ".x", "_9")) + "@mail.example.org"

    values = [(kind, value(kind)) for kind in ("card", "phone", "ipv4", "ssn", "date", "email") for _ in range(25)]
    shapes = ["{}", "at {}, then", "x {} y\n{}"]
    texts, want = [], []
    for k, (kind, v) in enumerate(values):
        shape = shapes[k % 3]
        made = plain_pseudonym("own key", kind, v)
        texts.append((k, shape.format(v, v)))
        want.append((k, shape.format(made, made), shape.count("{}") if made != v else 0))
    rows = texts + [texts[0], (None, texts[1][1]), (900, None), (901, ""), (902, "w" * 40000 + " " + texts[2][1])]
    got = pii.pseudonymise(documents(spark, rows), "own key").collect()
    assert [(r.doc_id, r.text, r.n_replaced) for r in got if r.doc_id is not None and r.doc_id < 900] == [*want, want[0]]
    others = {r.doc_id: (r.text, r.n_replaced) for r in got if r.doc_id is None or r.doc_id >= 900}
    assert others == {None: want[1][1:], 900: (None, 0), 901: ("", 0), 902: ("w" * 40000 + " " + want[2][1], want[2][2])}
    assert pii.pseudonymise(spark.createDataFrame([], DOCS), "k").count() == 0


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    pairs = spark.range(91).select(pii.feistel("k", "t", F.floor(F.col("id") / 13), F.col("id") % 13, F.lit(7), F.lit(13)).alias("p")).select("p.a", "p.b")
    assert pairs.distinct().count() == 91 and pairs.where("a < 0 or a >= 7 or b < 0 or b >= 13").count() == 0
