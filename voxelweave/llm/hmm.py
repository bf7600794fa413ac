"""A hidden Markov language model, trained by Baum-Welch over all partitions.

Texts are read once into chunks: each has its own list of words and pages of
numbers that stand for them. The lists are summed by word into corpus counts,
which grow with the corpus, and travel back to their chunks. A state emits a
class of words and the class a word: frequent words are classes of their own,
the others share classes by their last letters. A word is frequent if its count
is at least the root of all tokens, so there are at most that many, and the
model of states and classes may travel to every task.

Each round a task runs the scaled forward and backward recursions over its pages
and sums the expected counts; these sums, one row for each class, are added up by
Spark. Many texts advance together, ordered by length. Training takes texts in
windows of ``WINDOW`` tokens, each a sequence of its own, so that memory does not
grow with length; every token counts. Scores run over whole texts.

The model is a proper distribution over all words and one unknown word:
P(class | state) has half a count for each word of a class, spread over the
states, and P(word | class) half a count for each word. With one state the score
is the base score.

Defined cases: a null text counts as empty and has only its end; a null id counts
as an empty one in the hash; rows that repeat are scored each; without training
texts every token is unknown; other columns play no part; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.llm.words import for_texts
from voxelweave.session import materialize, ship_package

STATES, ROUNDS, SEED = 8, 4, 29
CHUNK_BYTES, PAGE_TOKENS, WINDOW = 32 << 20, 1 << 16, 1024
TRAIN_TOKENS, SCORE_TOKENS = 1 << 19, 1 << 21  # that advance together
END = "\n"  # no word holds a line end
HELD_OUT = (5, 1)
UNKNOWN = 0  # class of words that training has not met

_READ = ("chunk long, kind string, local int, word string, n long, "
         "ids array<long>, held array<boolean>, sizes array<long>, tokens binary")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else b"%d" % doc_id) % HELD_OUT[0] == HELD_OUT[1]


def _pack(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(numbers.astype("<u4").tobytes())


def _unpack(page: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(page), dtype="<u4")


class _Chunk:
    """Texts as numbers of their own list of words; number 0 is the end of a text."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.words: dict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.words[END.encode()]
        self.docs: list[tuple[int | None, bool, np.ndarray]] = []

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = text.lower().split()
        numbers = np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words))
        self.docs.append((doc_id, held_out(doc_id), np.append(numbers, np.uint32(0))))
        self.bytes += len(text)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Words with their counts in training texts, then pages of texts ordered by length."""
        schema = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("local", pa.int32()), ("word", pa.string()), ("n", pa.int64()),
                            ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary())])

        def batch(rows: int, **columns) -> pa.RecordBatch:
            columns |= {"chunk": pa.array([self.number] * rows, pa.int64())}
            return pa.record_batch([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)

        counts, words = np.zeros(len(self.words), dtype=np.int64), list(self.words)
        for _, out, numbers in self.docs:
            if not out:
                np.add.at(counts, numbers, 1)
        for low in range(0, len(words), 50_000):
            part = words[low:low + 50_000]
            yield batch(len(part), kind=pa.array(["word"] * len(part)), local=pa.array(range(low, low + len(part)), pa.int32()),
                        word=pa.array(part, pa.binary()).cast(pa.string()), n=pa.array(counts[low:low + len(part)]))
        self.docs.sort(key=lambda d: -len(d[2]))
        low = 0
        while low < len(self.docs):
            high, size = low, 0
            while high < len(self.docs) and (not size or size + len(self.docs[high][2]) <= PAGE_TOKENS):
                size += len(self.docs[high][2])
                high += 1
            page = self.docs[low:high]
            yield batch(1, kind=pa.array(["page"]), ids=pa.array([[d[0] for d in page]], pa.list_(pa.int64())),
                        held=pa.array([[d[1] for d in page]], pa.list_(pa.bool_())),
                        sizes=pa.array([[len(d[2]) for d in page]], pa.list_(pa.int64())),
                        tokens=pa.array([_pack(np.concatenate([d[2] for d in page]))], pa.binary()))
            low = high


def _read(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, chunk = (TaskContext.get().partitionId() << 32), None
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py() or b""
                if chunk is not None and chunk.bytes + len(text) > chunk_bytes:
                    yield from chunk.rows()
                    number, chunk = number + 1, None
                chunk = chunk or _Chunk(number)
                chunk.add(doc_id, text)
        if chunk is not None:
            yield from chunk.rows()

    return run


@dataclass
class Corpus:
    """Pages with a class for each token, and what the classes are."""

    pages: DataFrame  # ids, held, sizes, known, base, given, classes
    tokens: int  # of training texts
    types: np.ndarray  # distinct words of each class


def read_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Corpus:
    """Reads the texts, counts the words of the training texts and puts the words in classes."""
    spark = docs.sparkSession
    for_texts(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    read = materialize(rows.mapInArrow(_read(chunk_bytes), _READ), "chunks")
    lists = read.filter("kind = 'word'").select("chunk", "local", "word", "n")
    # One row of a word stands for it: the one of the smallest place.
    same = Window.partitionBy("word")
    lists = lists.withColumn("place", F.struct("chunk", "local"))
    lists = lists.withColumns({"c": F.sum("n").over(same), "first": F.min("place").over(same) == F.col("place")})
    letters = F.regexp_replace("word", r"[!-/:-@\[-`{-~]+$", "")
    ending = F.pmod(F.xxhash64(F.expr("right(__letters, 3)")), F.lit(2**31)).cast("long")
    lists = lists.withColumn("__letters", letters).withColumn("ending", ending).drop("__letters", "n", "place")
    lists = materialize(lists, "lists")
    tokens = lists.filter("first").agg(F.sum("c")).first()[0] or 0
    least, shared = max(2, math.isqrt(tokens)), max(16, math.isqrt(tokens) // 2)
    frequent = lists.filter(F.col("first") & (F.col("c") >= least)).select("word")  # at most the root of all tokens
    frequent = frequent.select("word", F.row_number().over(Window.orderBy("word")).alias("nth"))
    frequent = materialize(frequent, "frequent")
    lists = lists.join(F.broadcast(frequent), "word", "left")
    group = (F.when(F.col("c") == 0, F.lit(UNKNOWN)).when(F.col("nth").isNotNull(), F.col("nth") + shared)
             .otherwise(F.pmod("ending", F.lit(shared)) + 1).cast("int"))
    lists = lists.select("chunk", "local", "c", "first", group.alias("class"))
    sums = lists.filter("first and c > 0").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("t")).collect()
    count, types = np.zeros(shared + 1 + frequent.count()), np.zeros(shared + 1 + frequent.count())
    for row in sums:  # a row for each class
        count[row["class"]], types[row["class"]] = row["c"], row["t"]
    types[UNKNOWN] = 1
    schema = ("ids array<long>, held array<boolean>, sizes array<long>, known array<long>, base array<double>, "
              "given array<double>, classes binary")
    pages = read.filter("kind = 'page'").select("chunk", "ids", "held", "sizes", "tokens")
    coded = pages.groupBy("chunk").cogroup(lists.drop("first").groupBy("chunk")).applyInArrow(_coded(count, types), schema)
    return Corpus(materialize(coded, "pages"), int(tokens), types)


def _coded(count: np.ndarray, types: np.ndarray):
    whole = count.sum() + 0.5 * types.sum()

    def run(pages: pa.Table, lists: pa.Table) -> pa.Table:
        local = lists["local"].to_numpy()
        c, group = np.empty(len(local)), np.empty(len(local), dtype=np.uint32)
        c[local], group[local] = lists["c"].to_numpy(), lists["class"].to_numpy()
        base, given = np.log10((c + 0.5) / whole), np.log10((c + 0.5) / (count + 0.5 * types)[group])
        out = {"ids": pages["ids"].cast(pa.list_(pa.int64())), "held": pages["held"].cast(pa.list_(pa.bool_())),
               "sizes": pages["sizes"].cast(pa.list_(pa.int64()))}
        known, of_base, of_given, classes = [], [], [], []
        for sizes, page in zip(pages["sizes"].to_pylist(), pages["tokens"].to_pylist()):
            numbers, first = _unpack(page), np.cumsum([0, *sizes[:-1]])
            known.append(np.add.reduceat((c[numbers] > 0).astype(np.int64), first))
            of_base.append(np.add.reduceat(base[numbers], first))
            of_given.append(np.add.reduceat(given[numbers], first))
            classes.append(_pack(group[numbers]))
        return pa.table(out | {
            "known": pa.array(known, pa.list_(pa.int64())), "base": pa.array(of_base, pa.list_(pa.float64())),
            "given": pa.array(of_given, pa.list_(pa.float64())), "classes": pa.array(classes, pa.binary())})

    return run


@dataclass
class Model:
    """Start and moves of the states, and emission (classes, states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def _forward(self, tokens: np.ndarray, first: np.ndarray, active: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The log-likelihood of texts that begin at ``first``, longest first; ``keep`` gets the states of every step."""
        log, pred = np.zeros(len(first)), np.tile(self.start, (len(first), 1))
        for t, n in enumerate(active.tolist()):
            x = pred[:n] * self.emit[tokens[first[:n] + t]]
            scale = x.sum(axis=1)
            x /= scale[:, None]
            log[:n] += np.log(scale)
            if keep is not None:
                keep.append((x, scale))
            pred = x @ self.move
        return log

    def likelihood(self, tokens: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural logarithm of the likelihood of each text, by the scaled forward recursion."""
        order, active = _schedule(sizes)
        log = np.empty(len(sizes))
        log[order] = self._forward(tokens, first[order], active)
        return log

    def expect(self, tokens: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, moves and emissions, and the log-likelihood of all texts."""
        k = len(self.start)
        moves, emits = np.zeros((k, k)), np.zeros_like(self.emit)
        order, active = _schedule(sizes)
        first, kept = first[order], []
        total = self._forward(tokens, first, active, kept).sum()
        met, shares = [], []
        ahead = np.empty((0, k))  # of the step to the right: emission times what follows, over the scale
        for t in range(len(active) - 1, -1, -1):
            x, scale = kept.pop()
            after = np.ones_like(x)
            after[:len(ahead)] = ahead @ self.move.T
            moves += x[:len(ahead)].T @ ahead
            token = tokens[first[:active[t]] + t]
            met.append(token)
            shares.append(x * after)
            after *= self.emit[token]
            after /= scale[:, None]
            ahead = after
        starts, met, shares = shares[-1].sum(axis=0), np.concatenate(met), np.concatenate(shares)
        for state in range(k):
            emits[:, state] = np.bincount(met, weights=shares[:, state], minlength=len(emits))
        return starts, moves * self.move, emits, total


def _schedule(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling length, and how many of them reach each step."""
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max(initial=0))
    return order, len(sizes) - np.searchsorted(np.sort(sizes), np.arange(steps), side="right")


def first_model(corpus: Corpus, states: int = STATES, seed: int = SEED) -> Model:
    """Sticky states whose emissions differ at random."""
    draw = np.random.default_rng(seed)
    counts = (draw.random((len(corpus.types), states)) + 0.5) if states > 1 else np.ones((len(corpus.types), 1))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    emit = counts * np.maximum(corpus.types, 1e-9)[:, None]
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _panels(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], most: int, window: int = 0):
    """Tokens, first positions, sizes and other columns of several pages together; with ``window``, only training texts in windows."""
    def panel():
        sizes = np.concatenate([p[1] for p in held])
        return np.concatenate([p[0] for p in held]), np.cumsum(sizes) - sizes, sizes, [sum((p[2][i] for p in held), []) for i in range(len(columns))]

    held, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            tokens, sizes = _unpack(row["classes"]), np.array(row["sizes"])
            if window:
                keep = ~np.array(row["held"])
                tokens, sizes = tokens[np.repeat(keep, sizes)], sizes[keep]
                parts = -(-sizes // window)
                sizes, last = np.full(parts.sum(), window), sizes - (parts - 1) * window
                sizes[np.cumsum(parts) - 1] = last
            if len(sizes):
                held.append((tokens, sizes, [row[c] for c in columns]))
                size += len(tokens)
            if size >= most:
                yield panel()
                held, size = [], 0
    if held:
        yield panel()


def _expected(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for tokens, first, sizes, _ in _panels(batches, (), TRAIN_TOKENS, WINDOW):
            new = model.expect(tokens, first, sizes)
            sums = new if sums is None else [a + b for a, b in zip(sums, new)]
        if sums is not None:
            starts, moves, emits, total = sums
            table = np.concatenate([emits, moves, starts[None], np.full((1, len(starts)), total)])
            yield pa.record_batch([pa.array(range(len(table)), pa.int32()), *[pa.array(x) for x in table.T]],
                                  names=["row", *[f"s{i}" for i in range(len(starts))]])

    return run


def improved(corpus: Corpus, model: Model) -> tuple[Model, float]:
    """One round of Baum-Welch over all training texts, and the log-likelihood before it."""
    k, classes = len(model.start), len(model.emit)
    names = [f"s{i}" for i in range(k)]
    sums = corpus.pages.select("held", "sizes", "classes").mapInArrow(_expected(model), "row int, " + ", ".join(f"{n} double" for n in names))
    table = np.zeros((classes + k + 2, k))
    for row in sums.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).collect():  # a row for each class
        table[row["row"]] = row[1:]
    emits, moves, starts = table[:classes], table[classes:classes + k], table[classes + k]
    emits = emits + 0.5 * corpus.types[:, None] / k
    moves, starts = moves + 0.5, starts + 0.5
    return Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0)), float(table[-1, 0])


def train(corpus: Corpus, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Baum-Welch for a number of rounds."""
    model = first_model(corpus, states, seed)
    for _ in range(rounds):
        model, _ = improved(corpus, model)
    return model


def _scored(model: Model):
    columns = ("ids", "held", "known", "base", "given")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, first, sizes, (ids, held, known, base, given) in _panels(batches, columns, SCORE_TOKENS):
            log = model.likelihood(tokens, first, sizes) / math.log(10)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()),
                                   pa.array(base, pa.float64()), pa.array(log + np.array(given))],
                                  names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(corpus: Corpus, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every text."""
    pages = corpus.pages.select("ids", "held", "known", "base", "given", "sizes", "classes")
    out = pages.mapInArrow(_scored(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Trains on the texts that are not held out and scores all."""
    ship_package(docs.sparkSession)
    corpus = read_corpus(docs, id_col, text_col)
    return score(corpus, train(corpus, states, rounds, seed))
