"""The training-data operators against plain Python, round trips and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tools.compare import connect, difference
from voxelweave.llm import bpe, exact, licenses, minhash, mixing, pii, quality, queries, sharding, simhash, topk, wavelet
from voxelweave.llm.sql import ORACLES

from . import plain

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")

ODD = [
    None, "", " ", "\n", "a", "a", "a  b", " a\n\n b ", "It's\tHe'S\x0b x\x0cy", "é ß ÀÉ 日本語 \U0001f600", "x\x1cy\x85z\xa0w", "aaaa" * 400,
    "abcabd" * 300, "one two", "One  two", "one two three four", "mail a.b@c.example.com, 10.0.0.255 and 256.1.1.1 or 1.2.3.4.5.6.7.8",
    "a@b.co_x@y.zz a@b a@b-c_d@e.fr", "4111 1111 1111 1111; 4111111111111112 +1 (499) 555-6503 +12 3", "1" * 200, "+1" * 50,
    "tel 004.003.002.001 0000000000000000", "Released under the MIT License.", "word " * 30000, "<|endoftext|> x", "nul \0 in it",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 7 == 3 else "en", None if i % 5 == 2 else "s", i) for i, t in enumerate(ODD)]
    rows += [(None, "a lonely text without an id", "en", "s", 0), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_token_ids_of_mixed_letters():
    """Letters that lower-case or compose with what stands beside them, next to marks."""
    parts = ["İ", "i", "I", "J", "ǰ", "\u030c", "\u0307", "\u0301", "e", "É", "e\u0301", "ſ", "K", "Å", "A\u030a", "ß", "Σ", "ς", "Ω", "ﬁ", "Ǆ", "ŉ", "ΐ",
             ",", ".", "'", "'s", "!", "$", "-", " ", "\n", "\u00a0", "1", "٣", "中", "가", "\u1100\u1161", "\U0001f600", "word", "Don't", "x"]
    draw = random.Random(5)
    some = ["İ,", "x İstanbul'da. İ.", "J\u030ca,"] + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 12))) for _ in range(4000)]
    ids, sizes = wavelet.encode(pa.array(some), WORD, 2)
    tool, at = plain.word_tokenizer(), 0
    for text, n, got in zip(some, sizes.tolist(), tool.encode_batch(some, add_special_tokens=False)):
        assert ids[at:at + n].tolist() == [*got.ids, 2], ascii(text)
        at += n


def test_rows_of_one_id_go_to_several_shards(spark):
    rows = spark.range(600).selectExpr("IF(id < 500, NULL, id) AS doc_id", "concat('word ', id % 7) AS text")
    path = wavelet.write_shards(rows, WORD, shard_bytes=512)
    sizes = [len(r["doc_ids"]) for r in wavelet.read_shards(spark, path).select("doc_ids").collect()]
    assert len(sizes) > 4 and max(sizes) < 300 and sum(sizes) == 600
    got = wavelet.read_tokens(spark, path).select("doc_id", "start", "n_tokens").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 500 + list(range(500, 600))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_shards_with_clashing_columns_and_ties(spark):
    rows = spark.range(300).selectExpr("id % 3 AS doc_id", "id AS ends", "id AS before", "id AS block", "id AS m", "id AS shard", "map(1, id) AS tags")
    got = sharding.shuffle_into_shards(rows, 4, keys=("doc_id",))
    again = sharding.shuffle_into_shards(rows.repartition(5, "ends"), 4, keys=("doc_id",))
    assert {"ends", "before", "block", "m", "tags", "slot"} <= set(got.columns)
    place = lambda df: {r["ends"]: (r["shard"], r["slot"]) for r in df.collect()}
    assert place(got) == place(again) and len(place(got)) == 300


def test_one_rare_document_does_not_thin_the_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rare = spark.createDataFrame([(-1, "six words of a new source", "en", "rare", 25)], "doc_id long, text string, lang string, source string, n_chars long")
    share = lambda df: mixing.mixture(df).agg(F.sum(F.col("tokens") * F.col("probability")) / F.sum("tokens")).first()[0]
    plain_share, with_rare = share(docs), share(docs.unionByName(rare.select(*docs.columns)))
    assert abs(plain_share - mixing.SHARE) < 1e-9 and abs(with_rare - mixing.SHARE) < 1e-9
    before, after = (by_id(mixing.mixture(df)) for df in (docs, docs.unionByName(rare.select(*docs.columns))))
    moved = [abs(after[k]["probability"] - before[k]["probability"]) for k in before]
    assert max(moved) < 0.02


def test_targets_that_cannot_hold_raise(spark):
    cells = spark.createDataFrame([("a", "x", "p", 5), ("b", "y", "p", 5)], "source string, lang string, topic string, tokens long")
    want = lambda *v: spark.createDataFrame(list(v), "value string, target double")
    with pytest.raises(ValueError, match="cannot all hold"):
        mixing.rake(cells, {"source": want(("a", 0.5), ("b", 0.5)), "lang": want(("x", 0.9), ("y", 0.1)), "topic": want(("p", 1.0))})


def test_the_codec_gives_its_memory_back(spark, docs):
    from pyspark.sql import types as T

    def held(batches):
        yield from ()
        for _ in batches:
            yield pa.record_batch([pa.array([len(bpe._codecs)])], names=["n"])

    few = docs.limit(20).repartition(1)
    once = bpe.round_trip(few, BYTE, plain.public_tokenizers.PATTERN, remember=False)
    assert once.count() == 20
    assert all(r["n"] == 0 for r in few.mapInArrow(held, T.StructType([T.StructField("n", T.LongType())])).collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    found = connect(SF).execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert difference(df.columns, [tuple(r) for r in df.collect()], columns, found.fetchall()) is None


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert licenses.scan(none.withColumn("path", F.lit("a/b"))).count() == 0
    assert mixing.mixture(none).count() == 0
    assert wavelet.read_tokens(spark, wavelet.write_shards(none, WORD)).count() == 0
    assert bpe.round_trip(none, BYTE, public_tokenizers.PATTERN).count() == 0
    assert sharding.shuffle_into_shards(none).count() == 0
    model = quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(none, model).count() == 0
    assert pii.private_spans(none).count() == 0
    assert exact.exact_groups(none).count() == 0 and exact.without_copies(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, vectors).count() == 0


# 1. Licences


def test_licences_inherit_from_the_nearest_folder(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [("r/LICENSE", mit), ("r/x.py", "some prose\nmore prose"), ("r/a/COPYING", gpl), ("r/a/b/y.py", None), ("r/a/z.py", "# " + mit + "\nx"),
            ("s/w.py", "the mit and the Lizenz mit"), ("top.txt", ""), (None, mit), ("r/x.py", "some prose\nmore prose")]
    out = licenses.scan(spark.createDataFrame([(p, t, "own") for p, t in rows], "path string, text string, license string"))
    got = Counter((r["path"], r["license"], r["found"], r["from_dir"]) for r in out.collect())
    assert got == Counter([
        ("r/LICENSE", "MIT", "own", None), ("r/x.py", "MIT", "inherited", "r"), ("r/x.py", "MIT", "inherited", "r"),
        ("r/a/COPYING", "GPL-3.0", "own", None), ("r/a/b/y.py", "GPL-3.0", "inherited", "r/a"), ("r/a/z.py", "MIT", "own", None),
        ("s/w.py", None, None, None), ("top.txt", None, None, None), (None, "MIT", "own", None)])


def test_licence_lines_of_the_documents_are_found(spark, texts):
    """Every planted notice is found, and nothing is found in a text without one."""
    notices = {licenses.TEMPLATES[n]: n for n in ("Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0", "MIT")}
    df = spark.createDataFrame([(k, f"d/{k}.txt", v) for k, v in texts.items()], "doc_id long, path string, text string")
    for r in licenses.scan(df).collect():
        held = {name for line, name in notices.items() if line in (texts[r["doc_id"]] or "")}
        assert (r["own_license"] in held) if held else r["own_license"] is None, (r, held)


def _commented(text, lead):
    words, lines = text.split(), [""]
    for w in words:
        if len(lines[-1]) + len(w) > 70:
            lines.append("")
        lines[-1] = f"{lines[-1]} {w}".strip()
    return "\n".join(f"{lead}{line}" for line in lines)


def test_real_licence_texts_and_headers(spark):
    t, own = licenses.TEMPLATES, "Copyright (c) 2021 Jane Roe and others\n\n"
    code = "\n\n#include <stdio.h>\nint main(void) { return puts(\"hello\"); }\n"
    preamble = "\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy it.\n\n Preamble\n\n The work is made to share and change freely.\n" * 3
    files = {
        "a/LICENSE": ("MIT License\n\n" + own + _commented(t["MIT#text"].removeprefix("MIT License "), ""), "MIT"),
        "b/LICENSE.txt": ("ISC License\n\n" + own + _commented(t["ISC#text"].removeprefix("ISC License "), ""), "ISC"),
        "c/LICENSE": (own + _commented(t["BSD-2-Clause#text"], ""), "BSD-2-Clause"),
        "d/LICENSE": ("BSD 3-Clause License\n\n" + own + _commented(t["BSD-3-Clause#text"], ""), "BSD-3-Clause"),
        "e/COPYING": ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007" + preamble, "GPL-3.0"),
        "f/COPYING": ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999" + preamble, "LGPL-2.1"),
        "g/LICENSE": ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS" + preamble, "Apache-2.0"),
        "h/x.c": ("/*\n" + _commented("Copyright 2020 The Authors", " * ") + "\n *\n" + _commented(t["Apache-2.0#header"], " * ") + "\n */" + code, "Apache-2.0"),
        "i/x.c": ("/*\n" + _commented(t["GPL-3.0#header"], " * ") + "\n */" + code, "GPL-3.0"),
        "j/x.c": ("/*\n" + _commented(t["GPL-2.0#header"], " * ") + "\n */" + code, "GPL-2.0"),
        "k/x.c": (_commented(t["MPL-2.0#header"], "// ") + code, "MPL-2.0"),
        "l/x.c": ("// SPDX-License-Identifier: Apache-2.0" + code, "Apache-2.0"),
        "m/x.py": ("# SPDX-License-Identifier: GPL-2.0-or-later\nimport os\n", "GPL-2.0-or-later"),
        "n/x.c": ("/*\n" + _commented(t["ISC#grant"], " * ") + "\n */" + code, "ISC"),
        "o/UNLICENSE.md": (_commented(t["Unlicense#text"], ""), "Unlicense"),
        "p/x.c": (_commented(t["AGPL-3.0#header"], "// ") + code, "AGPL-3.0"),
        "a/src/deep/x.c": (code, None), "q/x.c": (code, None),
        "r/essay.txt": ("Which license a project takes is a hard question, and a lawyer may say more than a file does.\n"
                        "The warranty of the dishwasher ended in May. Permission to enter the hall was granted by the owner.", None),
        "s/essay.txt": ("The Apache helicopter and the Mozilla browser have little in common.\nA driving license is not a software license.\nLicense\n", None),
    }
    df = spark.createDataFrame([(p, x) for p, (x, _) in files.items()], "path string, text string")
    got = by_id(licenses.scan(df), "path")
    assert {p: r["own_license"] for p, r in got.items()} == {p: want for p, (_, want) in files.items()}
    assert got["a/src/deep/x.c"]["license"] == "MIT" and got["a/src/deep/x.c"]["found"] == "inherited"


# 2. Mixing


def test_raked_weights_have_the_target_marginals(spark):
    draw = random.Random(3)
    cells = spark.createDataFrame([(s, lang, t, draw.randint(1, 900)) for s in "abc" for lang in "xy" for t in "pq"],
                                  "source string, lang string, topic string, tokens long")
    want = {"source": {"a": 5.0, "b": 3.0, "c": 2.0, "absent": 9.0}, "lang": {"x": 1.0, "y": 1.0}, "topic": {"p": 0.3, "q": 0.7}}
    targets = {d: spark.createDataFrame(list(v.items()), "value string, target double") for d, v in want.items()}
    rows = mixing.rake(cells, targets).collect()
    for d, v in want.items():
        present = {k: x for k, x in v.items() if k != "absent"}
        for k, x in present.items():
            assert math.isclose(sum(r["weight"] for r in rows if r[d] == k), x / sum(present.values()), rel_tol=1e-9)


def test_mixture_keeps_rows_and_bounds(odd):
    out = mixing.mixture(odd).collect()
    assert len(out) == odd.count() and all(0 < r["probability"] <= 1 for r in out)
    assert max(r["probability"] for r in out) == 1.0 and {r["score"] for r in out} == {r["score"] for r in odd.collect()}


# 3. Wavelet shards


def test_wavelet_matrix():
    draw = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 9), (63, 2), (512, 300), (5000, 49408)):
        ids = draw.integers(0, top, n)
        m = wavelet.WaveletMatrix.unpack(wavelet.WaveletMatrix.build(ids, 16).pack())
        assert (m.tokens() == ids).all()
        if n:
            at = draw.integers(0, n, 50)
            assert (m.access(at) == ids[at]).all()
            for token in {int(ids[0]), int(ids[-1]), 7}:
                assert (m.places(token) == np.nonzero(ids == token)[0]).all()
                assert m.count(token, n // 3, n) == (ids[n // 3:] == token).sum()


def test_token_files(spark, docs, texts):
    tool, start, want = plain.word_tokenizer(), 0, {}
    for name in sorted(texts):
        ids = [*tool.encode(texts[name] or "", add_special_tokens=False).ids, 2]
        want[name] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert {k: tuple(r)[1:] for k, r in by_id(queries.op3_token_shards(spark, SF)).items()} == want


def test_token_files_of_odd_texts_in_small_shards(spark, odd):
    tool = plain.word_tokenizer()
    path = wavelet.write_shards(odd, WORD, shard_bytes=2000)
    rows = wavelet.read_tokens(spark, path).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        if r["doc_id"] is not None:
            ids = tool.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
            assert np.frombuffer(r["ids"], dtype="<u4").tolist() == [*ids, 2], ODD[r["doc_id"]]
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    whole = np.concatenate([np.frombuffer(r["ids"], dtype="<u4") for r in rows])
    assert sorted(r[0] for r in wavelet.occurrences(spark, path, 2).collect()) == np.nonzero(whole == 2)[0].tolist()


# 4. Byte-level BPE


def test_byte_pairs(spark, texts):
    tool = plain.byte_encoding()
    for name, r in by_id(queries.op4_byte_bpe(spark, SF)).items():
        ids = tool.encode_ordinary(texts[name] or "")
        assert tuple(r)[1:] == (len(ids), plain.sha(" ".join(map(str, ids))), plain.sha(texts[name] or ""))


def test_byte_pairs_of_odd_texts():
    draw, tool = random.Random(5), plain.byte_encoding()
    codec = bpe.Codec(BYTE, public_tokenizers.PATTERN, most_units=50)
    some = [x or "" for x in ODD] + ["".join(draw.choice(" \n\tab'sé1.") for _ in range(draw.randint(1, 40))) for _ in range(400)]
    some.append("".join(draw.choice("abcdefghij") for _ in range(2500)))
    ids, sizes = codec.encode(pa.array(some))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [tool.encode_ordinary(x) for x in some]
    assert codec.decode(ids, sizes, step=100) == [x.encode() for x in some]


def test_byte_pairs_of_long_words():
    """Words above the size that is cut into pieces, of few letters and of repeats, and many different words at once."""
    codec, tool, draw = bpe.codec(BYTE, public_tokenizers.PATTERN), plain.byte_encoding(), random.Random(3)
    words = ["a" * 5001, "ab" * 3001, "abc" * 1500, "ha" * 4000 + "x", "aab" * 900 + "aaaa" * 700, "the" * 2000, "日本" * 900]
    for letters in ("acgt", "ab", "eations", "日本語中文", "aA", "xyzzy" * 3 + "q"):
        words += ["".join(draw.choice(letters) for _ in range(draw.randint(bpe.PIECES + 1, 6000))) for _ in range(6)]
        words += ["".join(draw.choice(["ing", "ation", letters[0]]) for _ in range(1500))]
    words += ["".join(draw.choice("acgt") for _ in range(120_000))]
    for word, ids in zip(words, codec.merge([w.encode() for w in words])):
        assert np.frombuffer(ids, "<i4").tolist() == tool._encode_single_piece(word), (word[:40], len(word))
    many = ["".join(draw.choice("acgt") for _ in range(250)) for _ in range(2000)]
    for word, ids in zip(many, codec.merge([w.encode() for w in many])):
        assert np.frombuffer(ids, "<i4").tolist() == tool.encode_ordinary(word)


def test_byte_pair_columns(odd):
    out = bpe.decode(bpe.encode(odd.withColumn("ids", F.lit("old")), BYTE, public_tokenizers.PATTERN), BYTE, public_tokenizers.PATTERN)
    assert out.columns == [*odd.columns, "ids", "decoded"]
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in out.collect())


# 5. Sharding


def test_shards_are_exact_and_gapless(spark, docs):
    rows = queries.op5_uniform_shuffle(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_shards_of_odd_rows(odd):
    twice = odd.unionByName(odd).withColumn("slot", F.lit("old"))
    rows = sharding.shuffle_into_shards(twice, shards=4).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert sum(sizes.values()) == twice.count() and max(sizes.values()) - min(sizes.values()) <= 1
    assert Counter(r["text"] for r in rows) == Counter(r["text"] for r in twice.collect())


def test_hypergeometric_draws(spark):
    draws = spark.range(4000).select(sharding.hypergeometric(F.lit(40), F.lit(15), F.lit(12), (F.col("id") + 0.5) / 4000).alias("x"))
    got = Counter(r["x"] for r in draws.collect())
    for k in range(13):
        p = math.comb(15, k) * math.comb(25, 12 - k) / math.comb(40, 12)
        assert abs(got[k] / 4000 - p) < 0.001
    edge = [(0, 0, 0), (5, 0, 3), (5, 5, 3), (5, 2, 5), (5, 2, 0)]
    frame = spark.createDataFrame(edge, "n long, k long, m long")
    out = frame.select("k", "m", "n", sharding.hypergeometric(F.col("n"), F.col("k"), F.col("m"), F.lit(0.5)).alias("x")).collect()
    assert [r["x"] for r in out] == [0, 0, 3, 2, 0]


# 6. Quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = by_id(queries.op6_quality(spark, sf))
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == plain.held_out(k) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for k, r in got.items())
    held = [k for k in marks if plain.held_out(k)]
    assert np.mean([got[k]["predicted"] == marks[k] for k in held]) > 0.95


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (11, 0), (11, None), (13, 1), (None, 1), (19, 0)], "doc_id long, quality int")
    rows = quality.score(odd, quality.train(odd, labels)).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    flat = quality.score(odd, quality.train(odd, labels.limit(0))).collect()
    assert all(abs(r["score"] - 0.7) < 1e-9 for r in flat)


# 7. Private data


def test_private_data(spark, texts):
    for name, r in by_id(queries.op7_private_data(spark, SF)).items():
        assert tuple(r)[1:6] == plain.private_row(texts[name])
        assert {f"{k}:{a}:{b}" for a, _, k, b in plain.private(texts[name] or "")} <= set(r["spans"].split(","))


def plain_stretches(text):
    """Every stretch of whole digit groups with 7 to 19 digits in each run, by trying all."""
    out = set()
    for run in re.finditer(r"(?<![0-9])\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}", text):
        groups = list(re.finditer("[0-9]+", run.group()))
        for i, g in enumerate(groups):
            start = 0 if i == 0 else g.start() - (run.group()[g.start() - 1] in "+(")
            for h in groups[i:]:
                if 7 <= sum(c.isdigit() for c in run.group()[start:h.end()]) <= 19:
                    out.add((run.start() + start, run.start() + h.end()))
    return out


def test_stretches_of_digits(spark):
    draw = random.Random(9)
    some = ["7536784127813050 4845168114407329", "x +1 (499) 555-6503 y", "1" * 300, "1 " * 300, "12-" * 100, "(555) 123-4567", "1.2.3.4.5.6.7.8.9" * 20]
    some += ["".join(draw.choice("0123456789  -.(+/") for _ in range(draw.randint(10, 400))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(some)), "i int, text string")
    got = df.select("i", pii.stretches(F.col("text"), pii.found(F.col("text"), pii.LOOSE_NUMBER, F.lit(True)), F.array().cast(pii.BASE)).alias("s")).collect()
    for r in got:
        assert {(x["start"], x["end"]) for x in r["s"]} == plain_stretches(some[r["i"]]), some[r["i"]]
        assert all(some[r["i"]][x["start"]:x["end"]] == x["value"] for x in r["s"])
        assert all(x["before"] == some[r["i"]][max(0, x["start"] - 16):x["start"]] and x["after"] == some[r["i"]][x["end"]:x["end"] + 1] for x in r["s"])


PLANTED = {  # text -> spans that must be added
    "pay with 7536784127813050 4845168114407329 today": ["card:9:25", "card:26:42"],
    "pay with 2353820953013749 4550997810720808 today": ["card:26:42"],
    "write to jane.doe [at] mail [dot] example [dot] com soon": ["email:9:51"],
    "write to jane(at)mail(dot)com soon": ["email:9:29"],
    "ring (555) 123-4567 at noon": ["phone:5:19"],
    "the year 1999 and 2024-01-15 and 3.14159265 and 1234567890123": [],
    "order 2353820953013749 of 4711": [], "jane at mail dot com": [], "version 1.2.3 build 20240115": [],
}


def test_added_private_data(spark, docs):
    """Spans that the base patterns miss are added, whatever else the corpus holds."""
    planted = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(PLANTED)], "doc_id long, text string")
    plus = spark.createDataFrame([(10**6 + i, f"order ({i % 900 + 100}) {i * 7 % 900 + 100}-{i * 37 % 9000 + 1000} came") for i in range(400)], "doc_id long, text string")
    few = docs.select("doc_id", "text")
    for corpus in (few, few.unionByName(plus)):
        rows = by_id(pii.private_spans(corpus.unionByName(planted)), "id")
        listed = spark.createDataFrame([(k, r["added"]) for k, r in rows.items() if k < 0], "id long, added array<struct<start:long,kind:int,end:long>>")
        for r in listed.select("id", pii.as_text(F.col("added")).alias("t")).collect():
            text = list(PLANTED)[-1 - r["id"]]
            assert (r["t"].split(",") if r["t"] else []) == PLANTED[text], text


def test_private_data_of_odd_rows(odd):
    rows = pii.private_spans(odd.withColumn("base", F.lit(1))).withColumn("listed", pii.as_text(F.col("base"))).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        if r["id"] is not None:
            assert r["listed"] == ",".join(f"{k}:{a}:{b}" for a, _, k, b in plain.private(ODD[r["id"]] or "")), ODD[r["id"]]


def test_redaction(spark):
    one = spark.createDataFrame([(1, "write a@b.de or +1 (499) 555-6503.")], "doc_id long, text string")
    spans = pii.private_spans(one).withColumnRenamed("id", "doc_id")
    text = one.join(spans, "doc_id").select(pii.redacted(F.col("text"), F.array_sort(F.concat("base", "added"))).alias("t")).first()["t"]
    assert text == "write [email] or [phone]."


def test_patterns_are_linear_on_long_runs(spark):
    long = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "1." * 50_000), (4, "+" + "(" * 100_000)]
    rows = by_id(pii.private_spans(spark.createDataFrame(long, "doc_id long, text string")), "id")
    assert len(rows) == 4 and rows[1]["base"] == []


# 8. Exact duplicates


def test_exact_groups_of_odd_rows(odd):
    rows = exact.exact_groups(odd.filter("doc_id IS NOT NULL")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == plain.exact(list(enumerate(ODD)))


def test_repeated_rows_leave_one(odd):
    left = exact.without_copies(odd.unionByName(odd)).collect()
    assert sorted(plain.normal(r["text"]) for r in left) == sorted({plain.normal(t) for t in ODD} | {"alonelytextwithoutanid"})
    assert sum(r["kept"] for r in exact.exact_groups(odd.unionByName(odd)).collect()) == len(left)


def test_pages_of_a_hot_text(spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same text").otherwise(
        F.concat(F.lit("t"), F.col("id"))).alias("text"))
    rows = by_id(exact.exact_groups(many))
    assert rows[5998]["keep_id"] == 1 and rows[5998]["group_size"] == 4000 and sum(r["kept"] for r in rows.values()) == 2001
    assert exact.without_copies(many).count() == 2001


def test_directory_doubles_where_buckets_are_full(spark):
    slots = spark.createDataFrame([(0, 9), (1, 9), (2, 1), (3, 1), (6, 2)], "slot long, n long")
    got = {r["slot"]: r["bucket"] for r in exact.directory(slots, 3, 10).collect()}
    assert len({got[0], got[1], got[2], got[6]}) == 4 and got[2] == got[3]


# 9. SimHash


def test_simhash(spark, texts):
    got = by_id(queries.op9_simhash(spark, SF))
    names = sorted(texts)
    prints = [plain.fingerprint(texts[n], 3) for n in names]
    groups = plain.components(names, prints, 3)
    assert [(got[n]["fingerprint"], got[n]["component_id"]) for n in names] == [(f"{p:016x}", g) for p, g in zip(prints, groups)]


def test_simhash_of_odd_rows(odd):
    rows = simhash.near_duplicates(odd, words_each=3, radius=3, tree_rows=2).collect()
    given = [(r["doc_id"], r["text"]) for r in odd.collect()]
    prints = [plain.fingerprint(t, 3) for _, t in given]
    groups = plain.components([n for n, _ in given], prints, 3)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(r["id"], r["fp"] % 2**64, r["component_id"]) for r in rows], key=key) == sorted(
        [(n, p, g) for (n, _), p, g in zip(given, prints, groups)], key=key)


@pytest.mark.parametrize("tree_rows", [8, 1024])
def test_bk_trees_lose_no_link(spark, tree_rows):
    draw = random.Random(7)
    prints = {draw.getrandbits(64) for _ in range(300)}
    for base in list(prints)[:30]:
        for _ in range(10):
            for _ in range(draw.randint(1, 4)):
                base ^= 1 << draw.randrange(64)
            prints.add(base)
    prints = sorted(prints)
    frame = spark.createDataFrame([((p ^ 1 << 63) - (1 << 63),) for p in prints], "fp long")
    links = {(r["u"] % 2**64, r["v"] % 2**64) for r in simhash.near_links(frame, 3, tree_rows).collect()}
    group = {p: p for p in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for u, v in links:
        group[find(u)] = find(v)
    want = plain.components(prints, prints, 3)
    pairs = {}
    for p, w in zip(prints, want):
        assert pairs.setdefault(w, find(p)) == find(p)
    assert len(set(pairs.values())) == len(pairs)


# Near copies of the pipeline


def edited_copies(seed, families=6, copies=6):
    draw, out = random.Random(seed), []
    for _ in range(families):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(60, 400))]
        for k in range(copies):
            out.append(" ".join(words if k % 2 else [w.upper() for w in words]))
            words = list(words)
            for _ in range(draw.randint(1, max(2, len(words) // 60))):
                words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
    return out


@pytest.mark.parametrize("group_rows, group_shingles", [(2, 10**6), (2048, 300), (2048, 10**6)])
def test_edited_copies_go(spark, group_rows, group_shingles):
    some = [*edited_copies(1), "", None, "one two", "One  two", "a b c d", "same " * 900 + "one end here", "same " * 900 + "other tail there now"]
    frame = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3, "doc_id")
    groups = plain.jaccard_components(some, 5)
    assert 6 < len(set(groups)) < len(some) - 12
    best = {}
    for i, g in enumerate(groups):
        key = (len(some[i] or ""), -i)
        best[g] = max(best.get(g, key), key)
    left = minhash.without_near_copies(frame, group_rows=group_rows, group_shingles=group_shingles).collect()
    assert sorted(r["doc_id"] for r in left) == sorted(-b for _, b in best.values())


def test_near_stage_finds_all_at_its_similarity(spark, docs):
    rows = docs.collect()
    groups = plain.jaccard_components([r["text"] for r in rows], 5)
    left = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    kept = {r["doc_id"]: g for r, g in zip(rows, groups)}
    assert len(left) == len(set(groups)) < len(rows) and {kept[i] for i in left} == set(groups)


# 10. Top k


def test_top_k_of_odd_vectors(spark):
    draw = random.Random(2)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(3)]) for i in range(200)] + [(i, [0.5, 0.5, 0.5]) for i in range(200, 260)]
    rows += [(300, None), (301, [1.0, None, 1.0]), (302, [float("nan")] * 3), (303, [float("inf")] * 3), (None, [1.0] * 3), (320, [1.0, 2.0]),
             (340, []), (360, [9e15, 9e15, 9e15])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(frame, frame.filter("vec_id % 20 = 0"), k=5, shard_rows=40, leaf_rows=4).collect()
    sound = [(n, [math.floor(64 * x) for x in v]) for n, v in rows
             if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, q in sound:
        if n % 20 == 0:
            dots = [(sum(a * b for a, b in zip(q, v)), m) for m, v in sound if m != n and len(v) == len(q)]
            best = sorted((-min(max(s, -2**63), 2**63 - 1), m) for s, m in dots)[:5]
            want += [(n, i + 1, m, -s) for i, (s, m) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


# The pipeline


def test_pipeline_against_plain_python(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = quality.train(docs, labels)
    good = [r for r in rows if model.score(np.array([quality.features((r["text"] or "").encode())]))[0] >= 0.7]
    kept = plain.exact([(r["doc_id"], r["text"]) for r in good])
    good = [r for r in good if kept[r["doc_id"]][2]]
    groups = plain.jaccard_components([r["text"] for r in good], 5)
    best = {}
    for r, g in zip(good, groups):
        key = (len(r["text"] or ""), -r["doc_id"])
        best[g] = max(best.get(g, key), key)
    near = {-b for _, b in best.values()}
    got = by_id(corpus_pipeline.run(spark, SF))
    assert set(got) <= near and len(got) > 0.5 * len(near) and all(r["exact"] for r in got.values())
    mixed = by_id(mixing.mixture(docs.filter(F.col("doc_id").isin(sorted(near)))).filter("sampled"))
    assert set(got) == set(mixed)
    tool = plain.byte_encoding()
    text = {r["doc_id"]: r["text"] for r in rows}
    assert all(list(r["ids"]) == tool.encode_ordinary(text[k] or "") for k, r in got.items())


def test_stages_take_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert out.count() <= odd.count()
        assert stage(spark, odd.limit(0), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, odd, SF)
    assert last.count() == odd.count() and all(r["exact"] for r in last.collect())


def test_top_k_of_clusters_meets_few_shards(spark):
    """Exact on clustered vectors of two lengths in many cells; far cells are not searched."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(32, 16)) * 30
    points = [(i, (centres[i % 32] + rng.normal(size=16)).round(3).tolist()) for i in range(4000)]
    points += [(4000 + i, rng.normal(size=5).round(3).tolist()) for i in range(300)]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id % 20 = 0"), k=5, shard_rows=64).collect()
    whole = {i: np.floor(64 * np.array(v)).astype(np.int64) for i, v in points}
    want = []
    for i in whole:
        if i % 20 == 0:
            dots = sorted((-int(whole[i] @ v), j) for j, v in whole.items() if j != i and len(v) == len(whole[i]))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(dots)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    splits = topk.Splits(np.array([whole[i] for i in range(4000)], dtype=float), 6)
    cells = splits.cell(np.array([whole[i] for i in range(4000)], dtype=float))
    boxes = {c: (np.array([whole[i] for i in np.flatnonzero(cells == c)])) for c in set(cells.tolist())}
    reach = sum(int((np.maximum(whole[i], 0) @ b.max(axis=0) + np.minimum(whole[i], 0) @ b.min(axis=0)) >= next(w[3] for w in want if w[0] == i and w[1] == 5))
                for i in range(0, 4000, 20) for b in boxes.values())
    assert reach < 0.25 * 200 * len(boxes)
