"""Spelling variants by composing a vocabulary acceptor, a one-edit transducer and the acceptor again.

Words that differ by one edit share their first or their last half: with ``m``
code points in the shorter one and ``k = m // 2``, an edit behind the first ``k``
leaves these equal, and any other leaves the last ``k`` equal. Reading an equal
part takes the composed machine from its start to a state (p, no edit, p), and
the words that share the part are all it can accept from there. These states are
the partitions: each word goes to the partitions of its halves, for ``m`` its own
length and one less. A partition above ``most`` words, or with more than
``longest`` code points left in a word, is halved again in the same way.

A task builds the minimised acceptors of its partitions over one register of
states, so equal endings are stored once, and walks the composition from every
start: pairs of states of the two acceptors with the edit still to come or done.
A pair of words is accepted once, at its leftmost difference, and in one
partition only. The languages that two states share are worked out once for each
pair of states. A task sums up what it found for each word before it goes on.

Defined cases: a null text has no words; a null id counts as an empty one in the
hash; forms of equal count are taken in code-point order; links lead to a word of
at least twice the count, so they end; other columns play no part; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.llm.words import for_texts
from voxelweave.session import materialize, ship_package

LETTERS = re.compile("[a-zÀ-ÿ]+")  # A to Z are lower-cased before
ONE_IN = 97
LEAST_POINTS, LEAST_COUNT = 5, 3
MOST, LONGEST = 20_000, 64
HELD_WORDS, HELD_POINTS, AT_ONCE = 400_000, 32_000_000, 40_000
NO_LIMIT = 2**31 - 1


def doc_words(doc_id: int | None, text: bytes) -> Iterator[tuple[str, int]]:
    """Words of a text in UTF-8 with their counts; of one run in ``ONE_IN`` a letter is lost."""
    found: dict[str, int] = defaultdict(int)
    for run in LETTERS.findall(text.lower().decode()):
        found[run] += 1
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= LEAST_POINTS:
            yield run, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = defaultdict(int)
    points = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            if text.as_py():
                before = len(counts)
                for word, n in doc_words(doc_id, text.as_py()):
                    counts[word] += n
                    if len(counts) > before:
                        before, points = len(counts), points + len(word)
            if len(counts) >= HELD_WORDS or points >= HELD_POINTS:
                yield from _flushed(counts)
                counts.clear()
                points = 0
    yield from _flushed(counts)


def _flushed(counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
    words, n = list(counts), list(counts.values())
    for low in range(0, len(words), 50_000):
        yield pa.record_batch([pa.array(words[low:low + 50_000], pa.string()), pa.array(n[low:low + 50_000], pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``LEAST_POINTS`` code points and ``LEAST_COUNT`` occurrences."""
    for_texts(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    counted = rows.mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """Minimal deterministic acceptors over one register of states.

    The words of a state are numbered in code-point order; an arc has the number
    of the first word that takes it.
    """

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.arcs: list[dict[str, tuple[int, int]]] = []  # letter -> (state, first number)
        self.size: list[int] = []
        self.shared: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def state(self, words: list[str], low: int, high: int, depth: int) -> int:
        """The state that accepts what follows ``depth`` letters in sorted, distinct words of one length."""
        arcs = []
        if depth < len(words[low]):
            i = low
            while i < high:
                letter, j = words[i][depth], i + 1
                while j < high and words[j][depth] == letter:
                    j += 1
                arcs.append((letter, self.state(words, i, j, depth + 1), i - low))
                i = j
        key = tuple(arcs)
        found = self.register.get(key)
        if found is None:
            found = self.register[key] = len(self.arcs)
            self.arcs.append({letter: (to, first) for letter, to, first in arcs})
            self.size.append(high - low)
        return found

    def both(self, p: int, q: int) -> list[tuple[int, int]]:
        """Numbers in p and in q of the words that both accept: the composition after its edit."""
        if p == q:
            return [(i, i) for i in range(self.size[p])]
        key = (p, q)
        found = self.shared.get(key)
        if found is None:
            found, there = [], self.arcs[q]
            for letter, (to, first) in self.arcs[p].items():
                arc = there.get(letter)
                if arc is not None:
                    found += [(first + i, arc[1] + j) for i, j in self.both(to, arc[0])]
            self.shared[key] = found
        return found


def replaced(machine: Acceptor, start: int, until: int) -> Iterator[tuple[int, int]]:
    """Pairs of words of one length with one letter replaced among the first ``until``."""
    todo = [(start, 0, 0)]
    while todo:
        p, first, depth = todo.pop()
        if depth >= until:
            continue
        arcs = list(machine.arcs[p].values())
        for x, (a, i0) in enumerate(arcs):
            todo.append((a, first + i0, depth + 1))
            for b, j0 in arcs[:x]:
                for i, j in machine.both(a, b):
                    yield first + i0 + i, first + j0 + j


def deleted(machine: Acceptor, long: int, short: int, until: int) -> Iterator[tuple[int, int]]:
    """Pairs (longer, shorter) with one letter of the longer one lost, first differing among the first ``until``."""
    todo = [(long, short, 0, 0, 0)]
    while todo:
        p, q, i0, j0, depth = todo.pop()
        if depth >= until:
            continue
        there = machine.arcs[q]
        for letter, (a, i1) in machine.arcs[p].items():
            if letter in there:
                b, j1 = there[letter]
                todo.append((a, b, i0 + i1, j0 + j1, depth + 1))
            if not there and not machine.arcs[a]:
                yield i0 + i1, j0  # the longer one's last letter
            for after, (c, i2) in machine.arcs[a].items():
                if after != letter and after in there:  # else they differ further right
                    d, j1 = there[after]
                    for i, j in machine.both(c, d):
                        yield i0 + i1 + i2 + i, j0 + j1 + j


_KEY = ["m", "a", "b", "until", "head", "tail"]


def _halved(rows: DataFrame) -> DataFrame:
    """Each word in the two halves of its partition.

    ``a`` and ``b`` code points at the ends are known to be equal, and a pair's
    first difference lies before ``until``.
    """
    half = F.expr("(m - a - b) div 2")
    both = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b"), F.col("until")),
                   F.struct(F.col("a"), (F.col("b") + half).alias("b"), (F.col("a") + half).alias("until")))
    rows = rows.select("word", "n", "m", F.explode(both).alias("x")).select("word", "n", "m", "x.*")
    return rows.withColumns({"head": F.expr("substring(word, 1, a)"), "tail": F.expr("right(word, b)")})


def partitions(words: DataFrame, most: int = MOST, longest: int = LONGEST) -> DataFrame:
    """Words with the partitions in which they may meet a near word."""
    size = F.length("word")
    rows = words.withColumn("m", F.explode(F.array(size, size - 1))).filter(F.col("m") >= LEAST_POINTS)
    rows = _halved(rows.withColumns({"a": F.lit(0), "b": F.lit(0), "until": F.lit(NO_LIMIT)}))
    out = None
    while True:
        here = Window.partitionBy(*_KEY)
        rows = rows.withColumns({"__n": F.count("*").over(here), "__short": F.count_if(F.length("word") == F.col("m")).over(here)})
        rows = rows.filter("__n > 1 and __short > 0")
        left = F.col("m") - F.col("a") - F.col("b")
        rows = materialize(rows.withColumn("__big", (left > 1) & ((F.col("__n") > most) | (left > longest))), "halves")
        done = rows.filter("not __big").select("word", "n", *_KEY)
        out = done if out is None else out.unionByName(done)
        big = rows.filter("__big")
        if big.isEmpty():
            return out
        rows = _halved(big.select("word", "n", "m", "a", "b", "until"))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the near words of each word are in whole partitions, which follow each other."""
    kept: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "word", "n"))):
            if len(kept) >= AT_ONCE and row[:6] != kept[-1][:6]:
                yield _accepted(kept)
                kept = []
            kept.append(row)
    if kept:
        yield _accepted(kept)


def _accepted(rows: list[tuple]) -> pa.RecordBatch:
    machine, found = Acceptor(), {}

    def meet(x: tuple, y: tuple) -> None:
        for (word, n), (other, count) in ((x, y), (y, x)):
            old = found.get(word)
            if old is None:
                found[word] = [1, count, other]
            else:
                old[0] += 1
                if count > old[1] or count == old[1] and other < old[2]:
                    old[1:] = count, other

    low = 0
    while low < len(rows):
        key, high = rows[low][:6], low + 1
        while high < len(rows) and rows[high][:6] == key:
            high += 1
        m, a, b, until = key[:4]
        short, long = [], []
        for *_, word, n in rows[low:high]:
            (short if len(word) == m else long).append((word[a:len(word) - b], word, n))
        short.sort()
        one = [(word, n) for _, word, n in short]
        p = machine.state([x[0] for x in short], 0, len(short), 0)
        for i, j in replaced(machine, p, until - a):
            meet(one[i], one[j])
        if long:
            long.sort()
            q = machine.state([x[0] for x in long], 0, len(long), 0)
            for i, j in deleted(machine, q, p, until - a):
                meet(long[i][1:], one[j])
        low = high
    return pa.record_batch([
        pa.array(list(found), pa.string()), pa.array([x[0] for x in found.values()], pa.int64()),
        pa.array([x[1] for x in found.values()], pa.int64()), pa.array([x[2] for x in found.values()], pa.string()),
    ], names=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame, most: int = MOST, longest: int = LONGEST) -> DataFrame:
    """(word, n_near, form_n, form) of words with near ones; ``form`` is the most frequent of these."""
    spark = words.sparkSession
    ship_package(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = partitions(words, most, longest).repartition(tasks, *_KEY).sortWithinPartitions(*_KEY)
    parts = dealt.mapInArrow(_near, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form"))).alias("x")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("x.minus")).alias("form_n"), F.col("x.form").alias("form"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) end. Counts double along a link, so a few doublings of the step suffice."""
    now = materialize(links.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                 F.col("next").isNotNull().alias("moved")), "links")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, longest: int = LONGEST) -> DataFrame:
    """One row for each word: word, form, root, n, n_near and form_n."""
    words = materialize(vocabulary(docs, id_col, text_col), "words")
    found = words.join(near_words(words, most, longest), "word", "left")
    linked = F.col("form_n") >= 2 * F.col("n")
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                     F.when(linked, F.col("form")).alias("form"), F.when(linked, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(found.filter("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
