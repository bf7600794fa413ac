"""Merkle manifest, spelling variants and the hidden Markov model against plain Python."""

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import hmm, merkle, queries, spelling

from . import plain
from .test_llm import ODD, SF, by_id, docs, odd, texts  # noqa: F401


def key(row):
    return repr(row)


# Merkle manifest


def test_blocks_of_sha256():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5):
        parts = rng.integers(0, 256, (n, 4, 32), dtype=np.uint8)
        state = np.repeat(merkle.START[None], 4, axis=0)
        for p in parts:
            state = merkle.absorb(state, p)
        want = [hashlib.sha256(b"".join(bytes(p[i]).hex().encode() for p in parts)).digest() for i in range(4)]
        assert [bytes(x) for x in merkle.finish(state, np.full(4, n))] == want


@pytest.fixture(scope="module")
def odd_leaves(spark):
    rows = [(i, f"text {i}\n\nof source {i % 3}", "en", "hot" if i % 3 else "cold", i) for i in range(60)]
    rows += [(i, t, "en" if i % 2 else None, f"s{i % 7}", None) for i, t in enumerate(ODD)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (3, "a\nb", "de", None, 3), (3, "a\nb", "de", None, 3), (3, "z", "de", "", 1),
             (-4, "a\nb", None, "É", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def manifest_rows(df):
    parts = ("leaf", "subroot", "root", "proof", "folded")
    return [(r["id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), r["proof"].hex(), r["folded"].hex(), r["verified"])
            for r in df.select("id", *parts, "verified").collect()]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_over_several_tiers(odd_leaves, levels):
    want = plain.merkle([r.asDict() for r in odd_leaves.collect()])
    got = manifest_rows(merkle.tampered_manifest(odd_leaves, levels=levels))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, odd_leaves):
    one = odd_leaves.filter("doc_id = -4")
    assert manifest_rows(merkle.tampered_manifest(one)) == plain.merkle([r.asDict() for r in one.collect()])
    assert merkle.tampered_manifest(odd_leaves.limit(0)).count() == 0


def test_manifest_with_clashing_columns(odd_leaves):
    more = odd_leaves.selectExpr("*", *[f"1 AS {c}" for c in ("digest", "grp", "pos", "block", "total", "id", "changed", "root", "leaf")])
    assert sorted(manifest_rows(merkle.tampered_manifest(more)), key=key) == sorted(manifest_rows(merkle.tampered_manifest(odd_leaves)), key=key)


def test_parents_keep_the_states_before_their_slots():
    nodes = np.random.default_rng(5).integers(0, 256, (8, 32), dtype=np.uint8)
    digests, states = merkle.grow(nodes, 2)
    assert [d.shape for d in digests] == [(3, 32), (1, 32)] and states[0].shape == (3, 3, 8)
    before = merkle.absorb(states[0][0, 1][None], nodes[1][None])  # slot 1 resumed with its own child
    assert (before == states[0][0, 2]).all()
    path = merkle.steps(nodes, digests, states)
    left_lost = path.copy()
    for i, level in itertools.product(range(8), range(2)):  # left siblings play no part in the fold
        left_lost[i, level, 34:34 + 32 * path[i, level, 0]] = 0
    start = np.repeat(merkle.START[None], 8, axis=0)
    root, _, _ = merkle.fold(nodes, left_lost, start, np.zeros(8, dtype=np.int64))
    assert (root == digests[-1][0]).all()


# Spelling variants


def variant_rows(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


SPELT = [
    (0, "colour colour colour colour colour colour colour color color color colours colours colours"),
    (1, "Straße straße STRAßE strasse strasse strasse strassen strassen strassen abcde abcde abcde abcdf abcdf abcdf abcdg abcdg abcdg"),
    (2, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaaa aaaaaaa aaaaaaa bcdef xbcdef bcdefx bcdef xbcdef bcdefx bcdef xbcdef bcdefx"),
    (3, " ".join(["x" * 300 + "y" + "z" * 300, "x" * 301 + "z" * 300, "x" * 300 + "z" * 300] * 3)),
    (4, "÷×÷×÷ ÷×÷×÷ ÷×÷×÷ ÷×÷×÷÷ ÷×÷×÷÷ ÷×÷×÷÷ don't can't, ab-cd " * 3), (5, None), (6, ""), (None, "ÀÈÌÒÙ àèìòù ÀÈÌÒÙ ÀÈÌÒÙ àèìòù àèìòù " * 40),
    (7, "colour colour " * 2000),
]


@pytest.mark.parametrize("most, longest", [(spelling.MOST, spelling.LONGEST), (2, 64), (20_000, 1), (1, 1)])
def test_variants_of_planted_words(spark, most, longest):
    df = spark.createDataFrame(SPELT, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS m", "4 AS id")
    got = variant_rows(spelling.variants(df, most=most, longest=longest))
    assert sorted(got, key=key) == sorted(plain.spelling(SPELT), key=key)
    assert {"color", "colours"} <= {r[0] for r in got if r[1] == "colour"}


def test_variants_of_odd_rows_and_of_none(odd):  # noqa: F811
    got = variant_rows(spelling.variants(odd))
    assert sorted(got, key=key) == sorted(plain.spelling([(r["doc_id"], r["text"]) for r in odd.collect()]), key=key)
    assert spelling.variants(odd.limit(0)).count() == 0


def test_variants_of_the_documents(docs, texts):  # noqa: F811
    got = variant_rows(spelling.variants(docs))
    assert sorted(got, key=key) == sorted(plain.spelling(list(texts.items())), key=key)


def test_words_kept_in_a_task_are_bounded(monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 2)
    rows = [(i, t.encode()) for i, t in ((1, "apple pears grape"), (2, "apple pears"), (3, "apple"))]
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["id", "text"])
    total = {}
    parts = list(spelling._counted(iter([batch])))
    for part in parts:
        for word, n in zip(*part.to_pydict().values()):
            total[word] = total.get(word, 0) + n
    want = {}
    for i, t in rows:
        for word, n in spelling.doc_words(i, t):
            want[word] = want.get(word, 0) + n
    assert len(parts) > 1 and total == want


def test_minimised_acceptors_share_endings():
    machine = spelling.Acceptor()
    words = sorted(a + b for a in ("walk", "talk", "balk") for b in ("ed", "er"))
    start = machine.state(words, 0, 6, 0)
    assert len(machine.arcs) == 7  # one path of six letters with forks, and the state after it
    pairs = {frozenset((words[i], words[j])) for i, j in spelling.replaced(machine, start, 10**9)}
    assert pairs == {frozenset(p) for p in itertools.combinations(words, 2) if sum(x != y for x, y in zip(*p)) == 1}


# Hidden Markov model


def plain_likelihood(model, tokens):
    """Sum over all paths of states."""
    k, total = len(model.start), 0.0
    for path in itertools.product(range(k), repeat=len(tokens)):
        p = model.start[path[0]]
        for t, state in enumerate(path):
            p *= model.emit[tokens[t], state] * (model.move[path[t - 1], state] if t else 1.0)
        total += p
    return math.log(total)


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(11)
    return hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T.copy())


def test_forward_against_all_paths(small_model):
    rng = np.random.default_rng(2)
    sizes = np.array([1, 6, 3, 6, 2])
    tokens, first = rng.integers(0, 5, sizes.sum()).astype(np.uint32), np.cumsum(sizes) - sizes
    want = [plain_likelihood(small_model, tokens[a:a + n]) for a, n in zip(first, sizes)]
    assert np.allclose(small_model.likelihood(tokens, first, sizes), want)
    starts, moves, emits, total = small_model.expect(tokens, first, sizes)
    assert math.isclose(total, sum(want)) and math.isclose(starts.sum(), 5)
    assert math.isclose(moves.sum(), sizes.sum() - 5) and np.allclose(emits.sum(axis=1), np.bincount(tokens, minlength=5))
    for state in range(3):  # expected starts are a derivative of the log-likelihood
        step = 1e-6
        up = hmm.Model(small_model.start + step * (np.arange(3) == state), small_model.move, small_model.emit)
        slope = (up.likelihood(tokens, first, sizes).sum() - sum(want)) / step
        assert math.isclose(starts[state], slope * small_model.start[state], rel_tol=1e-4)


def test_base_scores_of_odd_rows(odd):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = hmm.scores(odd.selectExpr("*", "1 AS chunk", "2 AS word", "3 AS ids"), rounds=1).collect()
    want = sorted(plain.unigram(rows), key=key)
    keep = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    got = sorted(got, key=lambda r: key(tuple(r[c] for c in keep)))
    want.sort(key=lambda r: key(r[:5]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g[c] for c in keep) == w[:5] and math.isclose(g["base_score"], w[5], rel_tol=1e-9)
        assert math.isfinite(g["score"]) and g["score"] < 0


def test_one_state_gives_the_base_score(docs):  # noqa: F811
    got = hmm.scores(docs, states=1, rounds=1).collect()
    assert len(got) == 200 and all(math.isclose(r["score"], r["base_score"], rel_tol=1e-9) for r in got)


def test_no_training_texts_and_no_rows(spark, docs):  # noqa: F811
    held = docs.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 1)
    got = hmm.scores(held).collect()
    assert got and all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)
    assert hmm.scores(docs.limit(0)).count() == 0


def test_model_is_a_distribution_and_rounds_raise_the_likelihood(docs):  # noqa: F811
    corpus = hmm.read_corpus(docs)
    model, found = hmm.first_model(corpus), []
    for _ in range(4):
        model, log = hmm.improved(corpus, model)
        found.append(log)
        assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and math.isclose(model.start.sum(), 1)
    assert found == sorted(found) and corpus.types[hmm.UNKNOWN] == 1


def test_chunks_do_not_change_scores(docs):  # noqa: F811
    model = None
    for size in (hmm.CHUNK_BYTES, 20_000):
        corpus = hmm.read_corpus(docs, chunk_bytes=size)
        if model is None:
            model = hmm.train(corpus)
            want = by_id(hmm.score(corpus, model))
        else:
            got = by_id(hmm.score(corpus, model))
    assert all(math.isclose(got[k]["score"], want[k]["score"], rel_tol=1e-9) and got[k]["base_score"] == pytest.approx(want[k]["base_score"]) for k in want)


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    rows = queries.QUERIES["op13_hmm_scores"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert rows[0] - rows[1] > 0.1 * rows[2]


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Every training row is in pairs, however rare its label; the cut is the quantile of all of them."""
    import zlib

    from voxelweave.llm import quality

    monkeypatch.setattr(quality, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(4)
    n = 700
    bad = rng.random(n) < 0.03
    texts = ["!!## %d ** " % i * 5 if b else "some plain words of text %d and more of them here" % i for i, b in enumerate(bad)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad)], "doc_id long, quality int")
    seen, plain = [], quality._blocks
    monkeypatch.setattr(quality, "_blocks", lambda *a: seen.append(plain(*a)) or seen[-1])
    model = quality.train(docs, labels)
    learnt = {i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2}
    held = [r["rows"] for r in seen[0].collect()]
    assert {x["id"] for rows in held for x in rows} == learnt
    assert sorted(x["id"] for rows in held for x in rows if x["first"]) == sorted(learnt)
    assert len(held) > 10 and all({x["y"] for x in rows} == {0, 1} for rows in held)
    strength = {i: (np.array(quality.features(texts[i].encode())) - model.centre) / model.spread @ model.weights for i in learnt}
    ordered, at = sorted(strength.values()), sum(bad[i] for i in learnt)
    assert model.cut == pytest.approx((ordered[at - 1] + ordered[at]) / 2, abs=1e-9)
    assert not any(bad[i] for i in learnt if strength[i] > model.cut)
