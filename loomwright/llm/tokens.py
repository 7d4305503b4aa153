"""Token counts under a public tokenizer, a table of counts by content, and token budgets.

Counts are kept by (content hash, tokenizer hash), so that a text is encoded once for a
tokenizer and never again while its content stays. Budget cubes over source, language and
domain change by signed deltas: an added row adds its count, a removed row takes it away and
a changed row does both; ``deliver`` finds them from a delivery alone, and ``prune_counts`` takes
content that no row holds any more out of the count table.

Defined results: a null or empty text has 0 tokens; strings that look like special tokens are
ordinary text; a row id that arrives several times counts once, as it arrived first; extra
columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.runtime import cut, map_arrow, spread, strings

#: Where the tokenizer's ranks lie; a parameter of every function here.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A task remembers the counts of so many distinct texts (16-byte digests).
MEMO_TEXTS = 200_000


def tokenizer_hash(path: str = RANKS_PATH) -> str:
    """Identity of a tokenizer: the digest of its rank file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, keep: list[str], out: str = "n_tokens", path: str = RANKS_PATH) -> DataFrame:
    """``keep`` columns and the token count of ``text`` as ``out``; the text itself doesn't travel on.

    Map-side only. Equal texts of a task are encoded once.
    """
    schema = df.select(*keep, F.lit(0).cast("bigint").alias(out)).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        encode, digest = _encoding(path).encode_ordinary, xxhash.xxh3_128_digest
        memo: dict[bytes, int] = {}
        for batch in batches:
            counts = []
            for s in strings(batch.column(batch.num_columns - 1)):
                if not s:
                    counts.append(0)
                    continue
                key = digest(s.encode("utf-8", "replace"))
                n = memo.get(key)
                if n is None:
                    n = len(encode(s))
                    if len(memo) < MEMO_TEXTS:
                        memo[key] = n
                counts.append(n)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*keep, out])

    return map_arrow(spread(df.select(*keep, F.col(text).alias("__text"))), count, schema)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def once(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """A row a key, as it arrived first; ties by the values themselves."""
    first = F.min(F.struct(F.col(at), *columns)).alias("first")
    return df.groupBy(key).agg(first).select(key, *[F.col("first")[c].alias(c) for c in columns])


def update_counts(table: DataFrame | None, rows: DataFrame, text: str = "text", path: str = RANKS_PATH) -> DataFrame:
    """The count table (content_hash, tokenizer_hash, n_tokens) after ``rows`` arrived.

    Only content that the table doesn't have under this tokenizer is encoded. ``rows`` is a
    delivery, so the anti join moves the delivery's texts, not the corpus; a first call, without
    a table, moves no text at all.
    """
    tokenizer = tokenizer_hash(path)
    fresh = rows.select(content_hash(F.col(text)).alias("content_hash"), F.col(text).alias("__t"))
    if table is not None:
        known = table.filter(F.col("tokenizer_hash") == tokenizer).select("content_hash")
        fresh = fresh.join(known, "content_hash", "left_anti")
    counted = with_token_counts(fresh, "__t", ["content_hash"], path=path).dropDuplicates(["content_hash"])
    counted = counted.select("content_hash", F.lit(tokenizer).alias("tokenizer_hash"), "n_tokens")
    return counted if table is None else table.select(*counted.columns).unionByName(counted)


def complete_counts(table: DataFrame | None, rows: DataFrame, path: str = RANKS_PATH) -> DataFrame:
    """(content_hash, n_tokens) under this tokenizer from the count table, content it lacks encoded; written once."""
    counts = update_counts(table, rows, path=path)
    return cut(counts.filter(F.col("tokenizer_hash") == tokenizer_hash(path)).select("content_hash", "n_tokens"))


def members(rows: DataFrame, corpora: DataFrame, path: str = RANKS_PATH, counts: DataFrame | None = None) -> DataFrame:
    """What each row id adds to the budget: source, language, domain, content hash and tokens."""
    domains = corpora.select(F.col("corpus").alias("source"), F.col("domain")).dropDuplicates(["source"])
    flat = rows.select("row_id", "ingested_at", "source", F.col("language").alias("language"), content_hash(F.col("text")).alias("content_hash"))
    kept = once(flat, "row_id", "ingested_at", "source", "language", "content_hash").join(complete_counts(counts, rows, path), "content_hash")
    # the corpora table is fixed and small; Spark broadcasts it by its measured size
    return kept.join(domains, "source", "left").select("row_id", "source", "language", "domain", "content_hash", "n_tokens")


CUBE_KEYS = ["source", "language", "domain"]


def cube_delta(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed change of the finest cube cells between two states of the corpus."""
    signed = []
    for state, sign in ((before, -1), (after, 1)):
        if state is not None:
            signed.append(state.select(*CUBE_KEYS, "row_id", "content_hash", (F.col("n_tokens") * sign).alias("tokens"), F.lit(sign).alias("rows")))
    if not signed:
        raise ValueError("neither state is given")
    both = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    # unchanged rows cancel within their cell; groups keep null keys apart
    return both.groupBy(*CUBE_KEYS).agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).filter("tokens <> 0 OR rows <> 0")


def deliver(state: DataFrame, arrived: DataFrame | None, removed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(signed cells, new state) of a delivery: arrived members replace rows of their id, removed ids go.

    Only the delivery's ids are looked up in the state, so unchanged rows are neither aggregated
    nor moved; a row that arrives as it stood cancels itself.
    """
    ids = [df.select("row_id") for df in (arrived, removed) if df is not None]
    if not ids:
        raise ValueError("nothing is delivered")
    touched = (ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])).filter("row_id IS NOT NULL").distinct()
    left, gone = state.join(touched, "row_id", "left_anti"), state.join(touched, "row_id", "left_semi")
    if arrived is None:
        return cube_delta(gone, None), left
    came = arrived if removed is None else arrived.join(removed.select("row_id"), "row_id", "left_anti")
    return cube_delta(gone, came), left.unionByName(came.select(*left.columns))


def prune_counts(table: DataFrame, state: DataFrame) -> DataFrame:
    """The count table without content that no member holds any more."""
    return table.join(state.select("content_hash").distinct(), "content_hash", "left_semi")


def apply_delta(cube: DataFrame | None, delta: DataFrame) -> DataFrame:
    """The finest cells after a delta; cells without rows go."""
    every = delta if cube is None else cube.select(*delta.columns).unionByName(delta)
    return every.groupBy(*CUBE_KEYS).agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).filter("rows <> 0 OR tokens <> 0")


def roll_up(cells: DataFrame) -> DataFrame:
    """Totals by every subset of source, language and domain; ``level`` names the kept keys."""
    rolled = cells.cube(*CUBE_KEYS).agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"), F.grouping_id().alias("gid"))
    kept = [F.when(F.col("gid").bitwiseAND(4 >> i) == 0, F.lit(k)) for i, k in enumerate(CUBE_KEYS)]
    return rolled.select(F.concat_ws(",", *kept).alias("level"), *CUBE_KEYS, "tokens", "rows")


def wrong_counts(rows: DataFrame, path: str = RANKS_PATH) -> DataFrame:
    """Row ids whose token_count is null, or over twice or under half the tokens of the text."""
    flat = rows.select("row_id", "ingested_at", "token_count", content_hash(F.col("text")).alias("content_hash"))
    counted = flat.join(complete_counts(None, rows, path), "content_hash")
    told = once(counted, "row_id", "ingested_at", "token_count", "n_tokens")
    said, real = F.col("token_count").cast("decimal(20,0)"), F.col("n_tokens")
    return told.filter(said.isNull() | (said > 2 * real) | (2 * said < real)).select("row_id")
