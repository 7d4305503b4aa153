"""Training view: order, repetition, interleaving, tokens with loss masks, and packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import hashing
from loomwright.runtime import running_before

#: Ids of the byte codec.
PAD, BOS, EOS, OFFSET, VOCABULARY = 0, 1, 2, 3, 259
#: Largest weight of a corpus in an interleave; its square has to fit a long.
MOST_WEIGHT = 1_000_000_000


def selection_id(shard: Column, position: Column) -> Column:
    """Identity of a record in a training set: its shard's digest and its row."""
    return F.concat_ws(":", shard, position.cast("string"))


def training_records(rows: DataFrame) -> DataFrame:
    """The training view of canonical rows: (selection_id, id, text, source, license, language, corpus, messages, unreadable).

    ``rows`` has shard_sha256, position and corpus beside the canonical columns, and ``conversation``
    where rows may be encoded conversations; one that can't be decoded is told, not dropped.
    """
    talk = F.col("conversation") if "conversation" in rows.columns else F.lit(False)
    messages = F.when(talk, F.from_json("text", "messages array<struct<role: string, content: string>>")["messages"])
    return rows.select(
        selection_id(F.col("shard_sha256"), F.col("position")).alias("selection_id"), F.sha2("text", 256).alias("id"), "text", "source", "license", F.coalesce("language", F.lit("")).alias("language"), "corpus",
        messages.alias("messages"), (talk & messages.isNull()).alias("unreadable"),
    )


def ordered_shards(shards: DataFrame) -> DataFrame:
    """(sha256, path, position): shards in the order in which they are read, by digest and path."""
    return running_before(shards.select("sha256", "path"), ["sha256", "path"], F.lit(1), "position")


def steps_within(sequences: DataFrame, batch: int, requested: int) -> DataFrame:
    """(steps, reached): steps that the sequences suffice for, counted no further than asked; the scan stops there."""
    some = sequences.select(F.lit(1).alias("one")).limit(batch * requested)
    return some.agg(F.least(F.ceil(F.count(F.lit(1)) / F.lit(batch)), F.lit(requested)).cast("bigint").alias("steps")).withColumn("reached", F.col("steps") >= requested)


def epochs(rows: DataFrame, n: int) -> DataFrame:
    """Every row once an epoch."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def byte_tokens(text: Column) -> Column:
    """Byte codec: each byte's value and three special ids below."""
    data = F.encode(text, "UTF-8")
    at = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: (F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int") + OFFSET))


def byte_targets(rows: DataFrame, text: str = "text") -> DataFrame:
    """Targets of one epoch: bytes and an end of every record, but the first."""
    return rows.agg((F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(1)) - 1).cast("bigint").alias("targets"))


def byte_targets_for(one_epoch: Column, n: int) -> Column:
    return (one_epoch + 1) * n - 1


def partition_targets(rows: DataFrame, text: str = "text") -> DataFrame:
    """Targets summed by record, that is without the first token of each following record."""
    return rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint").alias("targets"))


def interleaved(rows: DataFrame, weights: DataFrame, order: list[str], corpus: str = "corpus", length: str = "tokens") -> DataFrame:
    """Weighted merge of corpora: always the corpus that emitted the least for its weight, ties by name.

    A corpus's key, tokens emitted before the record over the weight, only grows, so sorting by it
    is the greedy merge. Keys are compared exactly: two fractions under MOST_WEIGHT differ by more
    than one part of its square, so whole quotient and fraction in such parts order them as they are.
    """
    weight, emitted, parts = F.col("weight"), F.col("emitted"), F.lit(MOST_WEIGHT**2).cast("decimal(19,0)")
    valid = F.when(F.coalesce(weight.between(1, MOST_WEIGHT), F.lit(False)), weight.cast("bigint")).otherwise(F.raise_error(F.lit(f"weights lie between 1 and {MOST_WEIGHT}")).cast("bigint"))
    weighed = running_before(rows.join(weights.withColumn("weight", valid), corpus), order, F.col(length) + 1, "emitted", [corpus])
    whole = F.call_function("div", emitted, weight).cast("decimal(19,0)") * parts
    fraction = F.call_function("div", (emitted % weight).cast("decimal(10,0)") * parts, weight.cast("decimal(10,0)"))
    return weighed.withColumn("merge_key", (whole + fraction).cast("decimal(38,0)"))


def weighted_rank(merged: DataFrame, order: list[str], corpus: str = "corpus") -> DataFrame:
    """Position of every record in the merge, in one global order, from 1."""
    return running_before(merged, ["merge_key", corpus, *order], F.lit(1), "position").withColumn("position", F.col("position") + 1)


def token_offsets(rows: DataFrame, order: list[str], length: str = "tokens", group: str | None = None) -> DataFrame:
    """Start of every record in the continuous stream of records and their ends."""
    return running_before(rows, order, F.col(length) + 1, "offset", [group] if group else [])


def packed_sequences(total_tokens: Column, length: int) -> Column:
    """Sequences of length + 1 tokens with stride length, the last one partial; none without a target."""
    return F.when(total_tokens < 2, F.lit(0)).otherwise(F.ceil((total_tokens - 1) / F.lit(length))).cast("bigint")


def step_capacity(sequences: Column, batch: int) -> Column:
    return F.ceil(sequences / F.lit(batch)).cast("bigint")


def windows(stream: DataFrame, length: int, token: str = "token", position: str = "position", supervised: str = "supervised") -> DataFrame:
    """Packed windows of a token stream: (window, tokens, mask), padded, windows without a target left out.

    A token belongs to the window it starts and, at a window's first position, also ends the
    window before; so windows are groups of at most length + 1 tokens.
    """
    at = F.col(position)
    mine = F.floor(at / length)
    both = F.when((at % length == 0) & (at > 0), F.array(mine - 1, mine)).otherwise(F.array(mine))
    each = stream.withColumn("window", F.explode(both))
    rows = each.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(position, token, supervised))).alias("t"))
    mask = F.transform(F.slice("t", 2, length), lambda x: x[supervised])
    padded = lambda a, fill: F.concat(a, F.array_repeat(fill, F.greatest(F.lit(0), F.lit(length + 1) - F.size(a)).cast("int")))
    out = rows.filter(F.exists(mask, lambda x: x))
    return out.select("window", padded(F.transform("t", lambda x: x[token]), F.lit(PAD)).alias("tokens"), F.concat(mask, F.array_repeat(F.lit(False), F.greatest(F.lit(0), F.lit(length) - F.size(mask)).cast("int"))).alias("mask"))


def record_windows(tokens: Column, length: int) -> Column:
    """Evaluation packing: a record's own windows."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 2, F.lit(0)), F.lit(length))
    return F.transform(starts, lambda s: F.slice(tokens, s + 1, length + 1))


def consumption(packed: DataFrame) -> DataFrame:
    """Supervised targets by corpus; ``packed`` has (corpus, mask)."""
    return packed.groupBy("corpus").agg(F.sum(F.size(F.filter("mask", lambda x: x))).alias("targets"))


def shuffled(rows: DataFrame, seed: int, epoch: int, key: str) -> DataFrame:
    """Order by a seeded digest of the key: the same as a shuffle for statistics, and distributed."""
    state = (seed + epoch * hashing.GOLDEN) & hashing.MASK
    return rows.withColumn("shuffle_key", hashing.evaluation_score(state, F.col(key).cast("string")))


def bounded_shuffle(group: pd.DataFrame, seed: int, epoch: int, most_records: int, most_bytes: int) -> pd.DataFrame:
    """Reservoir shuffle of one ordered group by records and bytes; a record over the bytes goes straight through."""
    numbers = hashing.split_mix(seed ^ hashing.RESERVOIR_SEED ^ (epoch * hashing.MIX_A & hashing.MASK))
    held: list[int] = []
    used, out = 0, []
    size = group["bytes"].tolist()
    for i, n in enumerate(size):
        if n > most_bytes:
            out.append(i)
            continue
        while held and (len(held) >= most_records or used + n > most_bytes):
            j = next(numbers) % len(held)
            held[j], held[-1] = held[-1], held[j]
            used -= size[held[-1]]
            out.append(held.pop())
        held.append(i)
        used += n
    while held:
        j = next(numbers) % len(held)
        held[j], held[-1] = held[-1], held[j]
        out.append(held.pop())
    return group.iloc[out].assign(position=range(len(out)))


def bounded_shuffled(rows: DataFrame, group: str, order: list[str], seed: int, epoch: int = 0, most_records: int = 1024, most_bytes: int = 64 << 20, parts: int = 64) -> DataFrame:
    """Bounded shuffles within seeded parts of every group, and the group's parts in a seeded order: (.., position) is total in a group.

    The policy stands in for a shuffle of a group's shards and a reservoir over their stream:
    parts take the place of shards (rows fall to them by a seeded hash), so a hot group is many
    parts, each a task's worth of rows; a part's first position follows from the sizes of the
    parts before it, which are counted without moving a row.
    """
    kept = rows.columns
    state = F.lit((seed + epoch * hashing.GOLDEN & hashing.MASK) - (1 << 63))
    part = F.pmod(F.xxhash64(state, *order), F.lit(parts))
    salted = rows.withColumn("part", part)
    # each group's parts in an order of its own
    sizes = salted.groupBy(group, "part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy(F.xxhash64(state, group, "part"), "part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(group).alias("__group"), F.col("part").alias("__part"), F.coalesce(before, F.lit(0)).alias("__start"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return bounded_shuffle(pdf.sort_values(order, kind="stable"), seed, epoch, most_records, most_bytes)[[*kept, "part", "position"]]

    schema = salted.withColumn("position", F.lit(0).cast("bigint")).schema
    shuffled_parts = salted.groupBy(group, "part").applyInPandas(run, schema)
    placed = shuffled_parts.join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("part") == F.col("__part")))
    return placed.select(*kept, (F.col("__start") + F.col("position")).alias("position"))


# ---- conversations -------------------------------------------------------------------------


def rendered(messages: Column, template: str) -> Column:
    """Text of a conversation under a template; messages are structs of role and content."""
    title = lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))
    if template == "user-assistant-v1":
        part = lambda m: F.concat(title(m["role"]), F.lit(":"), F.when(m["role"] != "assistant", F.lit(" ")).otherwise(F.lit("")), m["content"])
        return F.array_join(F.transform(messages, part), "\n\n")
    if template == "chatml-v1":
        return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    raise ValueError(f"unknown template {template!r}")


def with_tools(messages: Column, tools: Column) -> Column:
    """Tools told in the leading system message, or in one of their own before the others."""
    said = F.concat(F.lit("Available tools:\n"), tools)
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    first = F.element_at(messages, 1)
    joined = F.concat(F.regexp_replace(first["content"], r"\n+\z", ""), F.lit("\n\n"), said)
    rest = F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))
    merged = F.concat(F.array(message(F.lit("system"), joined)), rest)
    return F.when(tools.isNull() | (tools == ""), messages).when((F.size(messages) > 0) & (first["role"] == "system"), merged).otherwise(F.concat(F.array(message(F.lit("system"), said)), messages))


def supervised_bytes(messages: Column, template: str, roles: list[str], whole: bool = False) -> tuple[Column, Column]:
    """Byte tokens of a rendered conversation with its end, and how many of them are supervised."""
    content = lambda m: F.octet_length(m["content"])
    trained = lambda m: m["role"].isin(roles)
    total = F.octet_length(rendered(messages, template)) + 1
    end = len("<|im_end|>\n") if template == "chatml-v1" else 0
    last = F.element_at(messages, -1)["role"].isin(roles)
    counted = F.aggregate(messages, F.lit(0), lambda a, m: a + F.when(trained(m), content(m) + end).otherwise(F.lit(0)))
    return total, (total if whole else counted + last.cast("int"))


def loss_mask(messages: Column, template: str, roles: list[str]) -> Column:
    """Of every byte token of a rendered conversation with its end, whether it is supervised: contents of the roles and what ends them."""
    chat = template == "chatml-v1"
    if not chat and template != "user-assistant-v1":
        raise ValueError(f"unknown template {template!r}")
    end = len("<|im_end|>\n") if chat else 0

    def of(m: Column, i: Column) -> Column:
        # the role's opening, or the gap before it, its name and colon
        before = F.octet_length(m["role"]) + (F.lit(len("<|im_start|>\n")) if chat else F.lit(1) + F.when(m["role"] != "assistant", 1).otherwise(0) + F.when(i > 0, 2).otherwise(0))
        return F.concat(F.array_repeat(F.lit(False), before), F.array_repeat(m["role"].isin(roles), F.octet_length(m["content"]) + end))

    last = F.coalesce(F.get(messages, F.size(messages) - 1)["role"].isin(roles), F.lit(False))
    return F.concat(F.flatten(F.transform(messages, of)), F.array(last))
