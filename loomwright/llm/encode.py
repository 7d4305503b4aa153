"""Encoding of a corpus with a byte-level BPE vocabulary by recursive queries.

Every task holds the merge table in an in-process DuckDB. Texts are split into words by the
tokenizer's pattern, and words into pieces between bytes that stand side by side in no token of the
vocabulary, across which no merge can reach. Distinct pieces become token-position rows (one row a
byte at first). A recursive query joins neighbouring rows to the merge table, finds each piece's
pair of minimum rank and contracts it from the left wherever it stands, until no piece has a pair
left; an ordered aggregation gives a piece's ids. A merge makes only pairs of higher rank than its
own, so that the leftmost pair of minimum rank again and again is the same pair until it is used up:
a round does all of these at once. A task remembers the ids of the words it has met.

Defined results: null and empty texts give an empty list; strings that look like special tokens
are ordinary text; every input row gives one output row, repeated rows as often as they come;
extra columns are ignored. Texts and words of any length are encoded whole: the recursion runs
in rounds of bounded depth, an unfinished word's state being the start of the next round.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.tokens import SPLIT_PATTERN
from loomwright.runtime import map_arrow, slices, spread, strings

#: Where the vocabulary and its merges lie; a parameter.
MODEL_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: Rows a round may keep: token positions times depth.
ROUND_ROWS = 3_000_000
#: Bytes of new words after which a task runs a query.
CHUNK_BYTES = 150_000
#: Words that a task remembers.
MEMO_WORDS = 300_000

CONTRACT = """
WITH RECURSIVE state(word, pos, tok, depth) AS (
  SELECT word, pos, tok, 0 FROM start
  UNION ALL
  SELECT * FROM (
    WITH near AS (
      SELECT word, pos, tok, depth, lead(tok) OVER w AS next_tok FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), ranked AS (
      SELECT near.*, merge.rank, merge.made, min(merge.rank) OVER (PARTITION BY word) AS best
      FROM near LEFT JOIN merge ON near.tok = merge.head AND near.next_tok = merge.tail WHERE near.depth < $depth
    ), runs AS (
      SELECT *, coalesce(rank = best, false) AS hit, row_number() OVER (PARTITION BY word ORDER BY pos) - row_number() OVER (PARTITION BY word, coalesce(rank = best, false) ORDER BY pos) AS run
      FROM ranked WHERE best IS NOT NULL
    ), taken AS (
      -- of overlapping occurrences (a token twice) every second one, from the left
      SELECT *, hit AND (row_number() OVER (PARTITION BY word, hit, run ORDER BY pos)) % 2 = 1 AS first FROM runs
    ), kept AS (
      SELECT *, lag(first, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone FROM taken
    )
    SELECT word, pos, CASE WHEN first THEN made ELSE tok END, depth + 1 FROM kept WHERE NOT gone
  )
)
SELECT word, any_value(depth) AS depth, list(tok ORDER BY pos) AS ids
FROM (SELECT *, max(depth) OVER (PARTITION BY word) AS last FROM state) WHERE depth = last GROUP BY word
"""


def printable_bytes() -> dict[int, str]:
    """The characters by which byte-level vocabularies write the 256 bytes: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    shifted = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class RecursiveBpe:
    """A merge table in DuckDB and the words already encoded."""

    def __init__(self, path: str = MODEL_PATH):
        import duckdb
        import numpy as np
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.first = np.zeros(256, np.int32)
        for b, c in printable_bytes().items():
            self.first[b] = vocab[c]
        self.joined = np.zeros((256, 256), bool)
        value = {c: b for b, c in printable_bytes().items()}
        for token in vocab:
            data = [value[c] for c in token if c in value]
            self.joined[data[:-1], data[1:]] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        merges = pa.table({k: pa.array(v, pa.int32()) for k, v in (("head", [vocab[a] for a, _ in pairs]), ("tail", [vocab[b] for _, b in pairs]), ("made", [vocab[a + b] for a, b in pairs]), ("rank", range(len(pairs))))})
        self.db.register("merges", merges)
        self.db.execute("CREATE TABLE merge AS SELECT * FROM merges")
        self.db.unregister("merges")
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.pieces: dict[bytes, list[int]] = {}

    def _contract(self, tokens: list, into: list) -> None:
        """Encode words, given as arrays of token ids, into the same places of ``into``."""
        import numpy as np

        pending, states = list(range(len(tokens))), tokens
        while pending:
            lengths = np.array([len(states[i]) for i in pending])
            total = int(lengths.sum())
            depth = max(4, min(int(lengths.max()), ROUND_ROWS // max(1, total)))
            offsets = np.cumsum(lengths) - lengths
            start = pa.table({
                "word": np.repeat(np.arange(len(pending), dtype=np.int32), lengths),
                "pos": (np.arange(total) - np.repeat(offsets, lengths)).astype(np.int32),
                "tok": np.concatenate([np.asarray(states[i], dtype=np.int32) for i in pending]),
            })
            self.db.register("start", start)
            result = self.db.execute(CONTRACT, {"depth": depth}).fetchall()
            self.db.unregister("start")
            unfinished = []
            for word, reached, ids in result:
                if reached >= depth and len(ids) > 1:
                    unfinished.append(pending[word])
                    states[pending[word]] = ids
                else:
                    into[pending[word]] = ids
            pending = unfinished

    def cut(self, data: bytes) -> list[bytes]:
        """Pieces of a word between bytes that are neighbours in no token."""
        import numpy as np

        codes = np.frombuffer(data, np.uint8)
        at = [0, *(np.flatnonzero(~self.joined[codes[:-1], codes[1:]]) + 1).tolist(), len(data)]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def learn(self, words: list[str]) -> None:
        import numpy as np

        cut = {word: self.cut(word.encode("utf-8", "replace")) for word in words}
        fresh = sorted({p for pieces in cut.values() for p in pieces if p not in self.pieces}, key=len)
        chunk, size = [], 0
        for i, piece in enumerate(fresh):
            chunk.append(piece)
            size += len(piece)
            if size >= CHUNK_BYTES or i == len(fresh) - 1:
                out: list = [None] * len(chunk)
                self._contract([self.first[np.frombuffer(p, np.uint8)] for p in chunk], out)
                self.pieces.update(zip(chunk, out))
                chunk, size = [], 0
        for word, pieces in cut.items():
            self.known[word] = self.pieces[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in self.pieces[p]]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.known) + len(self.pieces) > MEMO_WORDS:
            self.known.clear()
            self.pieces.clear()
        split = [self.split(t) if t else [] for t in texts]
        fresh = {w for words in split for w in words if w not in self.known}
        if fresh:
            self.learn(list(fresh))
        known = self.known
        return [[i for w in words for i in known[w]] for words in split]


_models: dict[str, RecursiveBpe] = {}


def encode_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL_PATH) -> DataFrame:
    """(key, ids array<int>) of every row; no shuffle beyond spreading a scan of few splits."""
    flat = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = df.select(F.col(key), F.array(F.lit(0)).alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _models:
            _models[path] = RecursiveBpe(path)
        model = _models[path]
        for batch in batches:
            for part in slices(batch, 1, 2_000):
                ids = model.encode(strings(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return map_arrow(spread(flat), run, schema)
