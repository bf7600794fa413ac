"""Byte-level BPE by recursive queries.

Spark deals out the texts; in each task an in-process DuckDB holds the merge
table. Every match of the pattern is a word; its bytes become rows (word,
position, token). A recursive query joins neighbouring rows with the merge table
and contracts each word's leftmost pair of lowest rank until no pair is left.
Decoding joins the ids with the vocabulary and aggregates the bytes in order.

A worker remembers the ids of the space-separated pieces it has met, so each
piece is merged once while it stays in the bounded memory. Words above
``LONG_WORD`` bytes contract all places of the lowest pair in one step where no
merge of the new token ranks below it, which gives the same result.

Words above ``PIECES`` bytes are cut into pieces that are merged on their own.
Then the tokens around each cut are merged anew as one word. A run of tokens is the
result for its bytes if each two neighbours are the result for theirs; so a cut is
closed if the first and last token of what was merged anew stay as they were.
Otherwise more tokens on both sides are taken in. Queries take words by the rows
that all their steps can have, so memory does not grow with words.

Defined cases: a null text counts as empty and gives no ids and no bytes; an
empty table gives no rows; all input columns stay, so ``ids`` and ``decoded``
replace columns of these names. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelweave.llm.words import Memory, for_texts, slices

LONG_WORD = 256
PIECES, PIECE, AROUND = 2048, 64, 32  # bytes
AT_ONCE = 16_384  # words in one query
ROWS_AT_ONCE = 6_000_000  # rows of all steps of a query
UNITS = 800_000  # pieces that a worker remembers
SLICE = 8_000_000  # bytes of text at a time
STEPS = 48  # contractions of long words in one query; what is left goes into the next
SHIFT = 20  # places for a token id

# A row is known by word * 512 + position, so the neighbour's key is one higher.
SHORT_SQL = f"""
WITH RECURSIVE s AS (
  SELECT k, t, 0 AS step FROM words
  UNION ALL
  SELECT s.k - (s.k > b.k)::INT, CASE WHEN s.k = b.k THEN b.r ELSE s.t END, s.step + 1
  FROM s JOIN (
    SELECT w, (best & {(1 << 24) - 1})::INT AS k, (best >> 24)::INT AS r FROM (
      SELECT x.k >> 9 AS w, min((m.r::BIGINT << 24) | x.k) AS best
      FROM s x JOIN s y ON y.k = x.k + 1 JOIN merges m ON m.pair = (x.t::BIGINT << {SHIFT}) | y.t
      GROUP BY x.k >> 9)) b ON s.k >> 9 = b.w AND s.k <> b.k + 1
)
SELECT k, t, step FROM s"""

LONG_SQL = f"""
WITH RECURSIVE s AS (
  SELECT w, p, t, 0 AS step FROM words
  UNION ALL
  SELECT w, (p - coalesce(before, 0))::INT, CASE WHEN chosen THEN r ELSE t END, step + 1 FROM (
    SELECT *, lag(chosen) OVER (PARTITION BY w ORDER BY p) AS gone, sum(chosen::INT) OVER (
        PARTITION BY w ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
      SELECT *, here AND CASE WHEN safe THEN row_number() OVER (PARTITION BY w, here, p - nth ORDER BY p) % 2 = 1
          ELSE nth = 1 END AS chosen FROM (
        SELECT *, row_number() OVER (PARTITION BY w, here ORDER BY p) AS nth FROM (
          SELECT *, coalesce(r = best, false) AS here FROM (
            SELECT *, min(r) OVER (PARTITION BY w) AS best FROM (
              SELECT x.w, x.p, x.t, x.step, m.r, m.safe
              FROM (SELECT *, lead(t) OVER (PARTITION BY w ORDER BY p) AS u FROM s WHERE step < {{steps}}) x
              LEFT JOIN merges m ON m.pair = (x.t::BIGINT << {SHIFT}) | x.u))))))
  WHERE best IS NOT NULL AND gone IS NOT TRUE
)
SELECT w, p, t, step FROM (SELECT *, max(step) OVER (PARTITION BY w) AS latest FROM s) WHERE step = latest"""

DECODE_SQL = """
SELECT i, string_agg(v.hex, '' ORDER BY p) AS hex
FROM tokens JOIN vocabulary v USING (t) GROUP BY i ORDER BY i"""


class Codec:
    """One vocabulary in an in-process DuckDB."""

    def __init__(self, path: str, pattern: str, most_units: int = UNITS):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.lengths = np.zeros(max(self.ranks.values()) + 1, dtype=np.int64)
        self.lengths[list(self.ranks.values())] = list(map(len, self.ranks))
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        left, right, rank = (np.array(x, dtype=np.int64) for x in (left, right, rank))
        safe = np.ones(max(self.ranks.values()) + 1, dtype=bool)
        for side in (left, right):  # a token is unsafe if a merge with it ranks below it
            safe[side[rank < side]] = False
        made = pa.table({"pair": (left << SHIFT) | right, "r": rank.astype(np.int32), "safe": safe[rank]})
        words = pa.table({
            "t": pa.array(list(self.ranks.values()), pa.int32()), "hex": [token.hex() for token in self.ranks],
        })
        for name, table in (("merges", made), ("vocabulary", words)):
            self.db.register("incoming", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
            self.db.unregister("incoming")
        self.memory = Memory(self._units, np.int32, most_units, AT_ONCE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        left: list[int] = []
        for i, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            else:
                left.append(i)
        sizes = np.array([len(words[i]) for i in left], dtype=np.int64)
        kinds = ((sizes <= LONG_WORD, self._contract_short, sizes * sizes // 2),
                 ((sizes > LONG_WORD) & (sizes <= PIECES), self._contract_long, sizes * STEPS))
        for which, contract, rows in kinds:
            for part in _batches(np.flatnonzero(which), rows):
                for k, ids in zip(part, contract([words[left[k]] for k in part])):
                    out[left[k]] = ids
        for k in np.flatnonzero(sizes > PIECES):
            out[left[k]] = self._contract_pieces(words[left[k]])
        return out

    def _contract_pieces(self, word: bytes) -> bytes:
        """A long word: pieces are merged on their own, then the tokens around each cut."""
        parts = [np.frombuffer(x, "<i4") for x in self.merge([word[i:i + PIECE] for i in range(0, len(word), PIECE)])]
        tokens = np.concatenate(parts)
        cuts, around = np.cumsum([len(x) for x in parts])[:-1], AROUND
        while len(cuts):
            ends = np.cumsum(self.lengths[tokens])  # bytes up to and with each token
            at = ends[cuts - 1]
            low = np.searchsorted(ends, at - around, side="right")
            high = np.minimum(np.searchsorted(ends, at + around) + 1, len(tokens))
            # Windows that touch are one.
            new = np.concatenate([[True], low[1:] >= np.maximum.accumulate(high)[:-1]])
            low, high = low[new], np.maximum.reduceat(high, np.flatnonzero(new))
            begin = np.where(low > 0, ends[low - 1], 0)
            again = [np.frombuffer(x, "<i4") for x in self._whole_words([word[a:b] for a, b in zip(begin, ends[high - 1])])]
            kept, cuts, past, size = [], [], 0, 0
            for a, b, x in zip(low.tolist(), high.tolist(), again):
                fits = (a == 0 or x[0] == tokens[a]) and (b == len(tokens) or x[-1] == tokens[b - 1])
                kept += [tokens[past:a], x if fits else tokens[a:b]]
                size += a - past
                if not fits:
                    cuts.append(size + (b - a) // 2)
                size += len(kept[-1])
                past = b
            tokens = np.concatenate([*kept, tokens[past:]])
            cuts, around = np.array(cuts, dtype=np.int64), around * 4
        return tokens.astype("<i4").tobytes()

    def _whole_words(self, words: list[bytes]) -> list[bytes]:
        """As :meth:`merge`, but long words are not cut."""
        out: list[bytes] = [b""] * len(words)
        small = [i for i, w in enumerate(words) if len(w) <= PIECES]
        for i, ids in zip(small, self.merge([words[i] for i in small])):
            out[i] = ids
        for i, w in enumerate(words):
            if len(w) > PIECES:
                out[i] = self._contract_long([w])[0]
        return out

    def _rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row (word, position, token) for each byte."""
        sizes = np.array([len(w) for w in words])
        w = np.repeat(np.arange(len(words)), sizes)
        p = np.arange(len(w)) - (np.cumsum(sizes) - sizes)[w]
        return w.astype(np.int32), p.astype(np.int32), self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]

    def _query(self, sql: str, **columns: np.ndarray) -> list[np.ndarray]:
        self.db.register("words", pa.table(columns))
        got = self.db.sql(sql).fetchnumpy()
        self.db.unregister("words")
        return [np.asarray(x) for x in got.values()]

    def _contract_short(self, words: list[bytes]) -> list[bytes]:
        w, p, t = self._rows(words)
        k, t, step = self._query(SHORT_SQL, k=w * 512 + p, t=t)
        w, latest = k >> 9, np.zeros(len(words), dtype=step.dtype)
        np.maximum.at(latest, w, step)
        last = np.nonzero(latest[w] == step)[0]
        order = last[np.argsort(k[last])]
        return _split(w[order], t[order], len(words))

    def _contract_long(self, words: list[bytes]) -> list[bytes]:
        w, p, t = self._rows(words)
        out: list[bytes] = [b""] * len(words)
        while len(w):
            steps = max(1, min(STEPS, ROWS_AT_ONCE // 8 // len(w)))
            w, p, t, step = self._query(LONG_SQL.format(steps=steps), w=w, p=p, t=t)
            order = np.lexsort((p, w))
            w, p, t, step = w[order], p[order], t[order], step[order]
            ended = step < steps
            for i, ids in enumerate(_split(w[ended], t[ended], len(words))):
                out[i] = ids or out[i]
            w, p, t = w[~ended], p[~ended], t[~ended]
        return out

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces; size -1 for a piece whose ends are white space, which its neighbours may change."""
        found: dict[str, int] = {}
        split: list[list[int] | None] = []
        for u in units:
            core = u[1:] if u[:1] == " " else u
            if u != "\n" and (not core or core[0].isspace() or core[-1].isspace()):
                split.append(None)
            else:
                split.append([found.setdefault(x, len(found)) for x in self.pattern.findall(u)])
        ids = self.merge([x.encode() for x in found])
        raw = [None if parts is None else ids[parts[0]] if len(parts) == 1 else b"".join([ids[i] for i in parts]) for parts in split]
        size = np.array([-1 if x is None else len(x) // 4 for x in raw], dtype=np.int64)
        return np.frombuffer(b"".join([x or b"" for x in raw]), dtype="<i4"), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        ids, sizes = [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.int64)]
        texts = pc.fill_null(texts, "")
        for low, high in slices(texts, SLICE):
            part = texts.slice(low, high - low)
            got, size, spoilt = self.memory.encode_lists(_pieces(part))
            spoilt |= pc.match_substring(part, "\0").to_numpy(zero_copy_only=False)
            if spoilt.any():
                runs = np.split(got, np.cumsum(size)[:-1])
                for i in np.nonzero(spoilt)[0]:
                    runs[i] = self._whole(part[int(i)].as_py())
                got, size = np.concatenate(runs), np.array([len(x) for x in runs])
            ids.append(got)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _whole(self, text: str) -> np.ndarray:
        words = [x.encode() for x in self.pattern.findall(text)]
        found = {x: i for i, x in enumerate(dict.fromkeys(words))}
        ids = self.merge(list(found))
        return np.frombuffer(b"".join([ids[found[x]] for x in words]), dtype="<i4")

    def decode(self, ids: np.ndarray, sizes: np.ndarray, step: int = 300_000) -> list[bytes]:
        """The bytes of each run of ids."""
        out: list[bytes] = [b""] * len(sizes)
        ends = np.cumsum(sizes)
        low = 0
        while low < len(sizes):
            base = int(ends[low] - sizes[low])
            high = max(low + 1, int(np.searchsorted(ends, base + step, side="right")))
            part = sizes[low:high]
            i = np.repeat(np.arange(low, high, dtype=np.int32), part)
            self.db.register("tokens", pa.table({
                "i": i, "p": np.arange(len(i), dtype=np.int32), "t": ids[base:base + len(i)],
            }))
            for at, text in self.db.sql(DECODE_SQL).fetchall():
                out[at] = bytes.fromhex(text)
            self.db.unregister("tokens")
            low = high
        return out


def _pieces(texts: pa.Array) -> pa.ListArray:
    """The texts cut before single spaces and around line ends."""
    cut = pc.replace_substring(pc.replace_substring(texts, pattern=" ", replacement="\0 "), pattern="\n", replacement="\0\n\0")
    return pc.split_pattern(cut, pattern="\0")


def _batches(which: np.ndarray, rows: np.ndarray) -> Iterator[list[int]]:
    """Parts of at most ``AT_ONCE`` words and about ``ROWS_AT_ONCE`` rows."""
    part, total = [], 0
    for k in which.tolist():
        if part and (len(part) >= AT_ONCE or total + rows[k] > ROWS_AT_ONCE):
            yield part
            part, total = [], 0
        part.append(k)
        total += rows[k]
    if part:
        yield part


def _split(w: np.ndarray, t: np.ndarray, n: int) -> list[bytes]:
    """Tokens, sorted by word, as bytes for each of n words."""
    raw = t.astype("<i4").tobytes()
    edges = (np.searchsorted(w, np.arange(n + 1)) * 4).tolist()
    return [raw[a:b] for a, b in zip(edges, edges[1:])]


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(path: str, pattern: str, most_units: int = UNITS) -> Codec:
    """The worker's codec; a vocabulary is loaded once for each worker."""
    if (path, pattern, most_units) not in _codecs:
        _codecs[path, pattern, most_units] = Codec(path, pattern, most_units)
    return _codecs[path, pattern, most_units]


def forget() -> None:
    """Gives back the memory of the worker's codecs."""
    while _codecs:
        _codecs.popitem()[1].db.close()
    pa.default_memory_pool().release_unused()


def _run(docs: DataFrame, path: str, pattern: str, text_col: str | None, ids_col: str | None, most_units: int = UNITS,
         slice_bytes: int = SLICE, remember: bool = True) -> DataFrame:
    keep = [f for f in docs.schema.fields if not (text_col and f.name in ("ids", "decoded")) and f.name != "decoded"]
    fields = list(keep)
    given = not text_col or any(f.name == text_col and isinstance(f.dataType, T.StringType) for f in keep)
    read = text_col if given else "__text"
    if text_col:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    if not text_col or ids_col:
        fields.append(T.StructField("decoded", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern, most_units)
        for batch in parts(batches):
            columns = [batch.column(f.name) for f in keep]
            if text_col:
                ids, sizes = tool.encode(batch.column(read))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids)))
            else:
                lists = batch.column(ids_col)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
            if not text_col or ids_col:
                columns.append(pa.array(tool.decode(ids, sizes), pa.binary()))
            yield pa.record_batch(columns, names=[f.name for f in fields])
        if not remember:
            del tool
            forget()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """With texts, a few megabytes at a time."""
        for batch in batches:
            for low, high in slices(batch.column(read), slice_bytes) if text_col else [(0, batch.num_rows)]:
                yield batch.slice(low, high - low)

    for_texts(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{f.name}`") for f in keep], *([] if given else [F.col(text_col).cast("string").alias("__text")]))
    return rows.mapInArrow(run, T.StructType(fields))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds ``ids``, the token ids of the text."""
    return _run(docs, path, pattern, text_col, None)


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for."""
    return _run(docs, path, pattern, None, ids_col)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", most_units: int = UNITS,
               slice_bytes: int = SLICE, remember: bool = True) -> DataFrame:
    """Adds ``ids`` and, decoded from them, ``decoded``, in one pass over the texts.

    A worker remembers up to ``most_units`` pieces and takes texts of up to
    ``slice_bytes`` together; neither changes the result. Unless it is to
    ``remember``, it gives its memory back at the end of each task.
    """
    return _run(docs, path, pattern, text_col, "ids", most_units, slice_bytes, remember)
