"""Schemas that drift between the files of a stream.

Rows are loaded as path-value maps of variants with their raw JSON types; statistics of every
path and type are aggregated by file; each file is compared with the one before it in its
stream; and one table of typed columns is projected, with a report of the casts that fail.
Everything stays in the JVM: no text leaves the executors' codegen stages and only statistics
(a row a file and path) are shuffled.

Paths are the top-level keys, and the keys of ``meta`` as ``meta.<key>``, whether ``meta`` is an
object or a string that holds one.

Defined results: null, broken and non-object payloads are unreadable and count nowhere, repeated
lines count once more but change nothing; JSON nulls are absent; a field whose values have
several types has the most frequent one (integers and doubles together are doubles, ties fall
to the type's name); a stream's first file has nothing to compare; files without rows, and rows
of unknown files, are left out of the comparison; ties of ``file_seq`` fall to ``file_id``;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.runtime import cut, spread

#: Distinct field names that the projection accepts; more is an error, not a sample.
MAX_NAMES = 5_000
#: Content distance from which two string fields don't hold the same content.
MAX_DISTANCE = 0.75

#: Mean characters from which numbers (dates, digests) tell content by themselves.
LONG_NUMBER = 3.8

_TYPES = {"BIGINT": "integer", "STRING": "string", "BOOLEAN": "boolean", "DOUBLE": "double", "FLOAT": "double"}


def _type(value: Column) -> Column:
    """Raw JSON type of a variant."""
    schema = F.schema_of_variant(value)
    out = F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema.startswith("DECIMAL"), "double")
    for raw, name in _TYPES.items():
        out = out.when(schema == raw, name)
    return out


def path_values(rows: DataFrame) -> DataFrame:
    """(file_id, line_no, path, value, type): the present values of every readable row."""
    view = spread(rows.select("file_id", "line_no", "payload")).select("file_id", "line_no", F.expr("try_parse_json(payload)").alias("doc"))
    view = view.filter(F.schema_of_variant("doc").startswith("OBJECT"))
    spark = rows.sparkSession
    exploded = spark.sql("SELECT d.file_id, d.line_no, e.key AS path, e.value FROM {docs} d, LATERAL variant_explode(d.doc) e", docs=view)
    exploded = exploded.filter(~F.expr("is_variant_null(value)"))
    inner = exploded.filter(F.col("path") == "meta").select("file_id", "line_no", F.expr("CASE WHEN schema_of_variant(value) = 'STRING' THEN try_parse_json(CAST(value AS STRING)) ELSE value END").alias("doc"))
    inner = inner.filter(F.schema_of_variant("doc").startswith("OBJECT"))
    nested = spark.sql("SELECT d.file_id, d.line_no, concat('meta.', e.key) AS path, e.value FROM {docs} d, LATERAL variant_explode(d.doc) e", docs=inner).filter(~F.expr("is_variant_null(value)"))
    every = exploded.unionByName(nested)
    return every.withColumn("type", _type(F.col("value"))).filter(F.col("type").isNotNull())


def _share(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("double")


def path_statistics(values: DataFrame) -> DataFrame:
    """A row a file and path: its type, how many values, and what their content looks like.

    Content is told by character shares, mean length and a 256-bit map of value hashes, so a
    field's statistics have a fixed size however many values it has.
    """
    text = F.expr("coalesce(try_cast(value AS STRING), to_json(value))")
    shaped = values.withColumn("s", text).select(
        "file_id", "path", "type", F.length("s").cast("double").alias("size"),
        _share(F.col("s"), "0-9").alias("digits"), _share(F.col("s"), "A-Z").alias("capitals"), _share(F.col("s"), "a-z").alias("smalls"), _share(F.col("s"), " ").alias("spaces"),
        F.pmod(F.xxhash64("s"), F.lit(256)).alias("bit"),
    )
    bits = [F.expr(f"bit_or(CASE WHEN bit DIV 64 = {k} THEN shiftleft(1L, CAST(bit % 64 AS INT)) ELSE 0L END)").alias(f"bits{k}") for k in range(4)]
    names = ["size", "digits", "capitals", "smalls", "spaces"]
    typed = shaped.groupBy("file_id", "path", "type").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names], *bits)
    n_of = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("n"))), F.lit(0))
    both = typed.groupBy("file_id", "path").agg(
        F.max(F.struct(F.col("n"), F.col("type"))).alias("top"), n_of("integer").alias("ints"), n_of("double").alias("doubles"), F.sum("n").alias("n"),
        *[F.sum(c).alias(c) for c in names], *[F.bit_or(f"bits{k}").alias(f"bits{k}") for k in range(4)],
    )
    numbers = F.col("ints") + F.col("doubles")
    kind = F.when((F.col("doubles") > 0) & (numbers >= F.col("top.n")), "double").otherwise(F.col("top.type"))
    return both.select("file_id", "path", kind.alias("type"), "n", (F.col("size") / F.col("n")).alias("size"), *[(F.col(c) / F.greatest(F.col("size"), F.lit(1.0))).alias(c) for c in names[1:]], *[f"bits{k}" for k in range(4)])


def neighbours(files: DataFrame, stats: DataFrame) -> DataFrame:
    """(file_id, before): each readable file and the readable file before it in its stream."""
    readable = stats.select("file_id").distinct()
    known = files.select("file_id", "stream", "file_seq").dropDuplicates(["file_id"]).join(readable, "file_id", "left_semi")
    order = Window.partitionBy("stream").orderBy("file_seq", "file_id")
    return known.withColumn("before", F.lag("file_id").over(order)).filter(F.col("before").isNotNull()).select("file_id", "before")


def _alike(old: str, new: str) -> tuple[Column, Column]:
    """Whether two fields of one type hold the same content, and how surely."""
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    shape = sum((F.abs(o(c) - n(c)) for c in ("digits", "capitals", "smalls", "spaces")), F.lit(0.0)) + 0.35 * F.abs(F.log((o("size") + 1) / (n("size") + 1)))
    union = sum((F.bit_count(o(f"bits{k}").bitwiseOR(n(f"bits{k}"))) for k in range(4)), F.lit(0))
    shared = sum((F.bit_count(o(f"bits{k}").bitwiseAND(n(f"bits{k}"))) for k in range(4)), F.lit(0))
    overlap = shared / F.greatest(union, F.lit(1))
    stems = lambda c: F.transform(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: F.substring(x, 1, 4))
    related = F.arrays_overlap(stems(o("path")), stems(n("path")))
    # short numbers and flags look alike whatever they count, so they need a related name too
    long = (o("size") >= LONG_NUMBER) & (n("size") >= LONG_NUMBER) & (shape < 0.1)
    told = F.when(o("type").isin("string", "array", "object"), shape < MAX_DISTANCE).otherwise((related & (shape < 2 * MAX_DISTANCE)) | long)
    return told, overlap - shape + F.when(related, 1.0).otherwise(0.0)


def statistics_once(rows: DataFrame) -> DataFrame:
    """Path statistics behind a checkpoint, so that payloads are parsed once however often they are used."""
    return cut(path_statistics(path_values(rows)))


def changes(files: DataFrame, stats: DataFrame) -> DataFrame:
    """(file_id, change, old_field, new_field) of every file against the one before it."""
    pairs = neighbours(files, stats)
    fields = [c for c in stats.columns if c != "file_id"]
    now = stats.join(pairs, "file_id").select("file_id", F.struct(*fields).alias("new"), F.col("path").alias("p"))
    then = pairs.join(stats.withColumnRenamed("file_id", "before"), "before").select("file_id", F.struct(*fields).alias("old"), F.col("path").alias("p"))
    # a row a file and changed field; read four times below, so it is written once
    changed = "new IS NULL OR old IS NULL OR new.type <> old.type"
    both = cut(now.join(then, ["file_id", "p"], "full_outer").filter(changed))
    row = lambda df, change, old, new: df.select("file_id", F.lit(change).alias("change"), old.alias("old_field"), new.alias("new_field"))
    retyped = row(both.filter("new IS NOT NULL AND old IS NOT NULL"), "retyped", F.col("p"), F.col("p"))
    came, went = both.filter("old IS NULL").select("file_id", "new"), both.filter("new IS NULL").select("file_id", "old")
    told, score = _alike("old", "new")
    top = ~F.col("new.path").startswith("meta.") & ~F.col("old.path").startswith("meta.") & (F.col("new.type") == F.col("old.type"))
    # pairs within one file only: their number is bounded by two schemas
    cand = came.join(went, "file_id").filter(top & told).select("file_id", F.col("old.path").alias("old_field"), F.col("new.path").alias("new_field"), score.alias("score"))
    best = lambda *k: Window.partitionBy("file_id", *k).orderBy(F.desc("score"), "old_field", "new_field")
    ranked = cand.withColumn("a", F.row_number().over(best("old_field"))).withColumn("b", F.row_number().over(best("new_field")))
    pairs_found = cut(ranked.filter("a = 1 AND b = 1").select("file_id", "old_field", "new_field"))
    renamed = row(pairs_found, "renamed", F.col("old_field"), F.col("new_field"))
    new_left = came.select("file_id", F.col("new.path").alias("new_field")).join(pairs_found, ["file_id", "new_field"], "left_anti")
    old_left = went.select("file_id", F.col("old.path").alias("old_field")).join(pairs_found, ["file_id", "old_field"], "left_anti")
    added, removed = row(new_left, "added", F.lit(""), F.col("new_field")), row(old_left, "removed", F.col("old_field"), F.lit(""))
    return retyped.unionByName(renamed).unionByName(added).unionByName(removed)


class Projection:
    """One consistent set of typed columns: canonical names, their aliases and types.

    Fitted from the statistics and the renames of all files. Only distinct names with their
    types and rename pairs reach the driver, at most ``MAX_NAMES`` of them.
    """

    WIDEN = {"integer": "bigint", "double": "double", "boolean": "boolean", "string": "string"}

    def __init__(self, stats: DataFrame, found: DataFrame):
        names = stats.groupBy("path", "type").agg(F.count(F.lit(1)).alias("files")).limit(MAX_NAMES + 1).collect()
        edges = found.filter("change = 'renamed'").groupBy("old_field", "new_field").agg(F.count(F.lit(1)).alias("n")).filter("n > 0").limit(MAX_NAMES + 1).collect()
        if len(names) > MAX_NAMES or len(edges) > MAX_NAMES:
            raise ValueError(f"more than {MAX_NAMES} distinct fields")
        support: dict[str, int] = {}
        kinds: dict[str, dict[str, int]] = {}
        for r in names:
            support[r.path] = support.get(r.path, 0) + r.files
            kinds.setdefault(r.path, {})[r.type] = r.files
        group = {p: p for p in support}

        def root(p: str) -> str:
            while group[p] != p:
                p = group[p]
            return p

        for e in edges:
            a, b = root(e.old_field), root(e.new_field)
            if a != b:
                group[max(a, b)] = min(a, b)
        members: dict[str, list[str]] = {}
        for p in support:
            members.setdefault(root(p), []).append(p)
        self.aliases: dict[str, list[str]] = {}
        self.types: dict[str, str] = {}
        for every in members.values():
            every.sort(key=lambda p: (-support[p], p))
            votes: dict[str, int] = {}
            for p in every:
                for k, n in kinds[p].items():
                    votes[k] = votes.get(k, 0) + n
            kind = max(sorted(votes), key=votes.get)
            if kind in ("integer", "double"):
                kind = "double" if "double" in votes else "integer"
            self.aliases[every[0]] = every
            self.types[every[0]] = self.WIDEN.get(kind, "string")

    def _raw(self, path: str) -> Column:
        """Value of a field; a key is one segment, whatever dots, quotes or apostrophes it holds."""
        nested = path.startswith("meta.")
        key = path[len("meta.") :] if nested else path
        at = '$["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'
        return F.element_at(F.col("meta_map" if nested else "doc_map"), F.lit(key)) if '"' in key or "\\" in key else F.try_variant_get(F.col("meta_doc" if nested else "doc"), at, "variant")

    def column_names(self) -> dict[str, str]:
        """Field by column name: dots become underscores, a clash takes a number."""
        out: dict[str, str] = {}
        taken = {"file_id", "line_no", "failed_casts", "unreadable"}
        for name in sorted(self.aliases):
            base = column = name.replace(".", "_")
            n = 2
            while column.lower() in taken:
                column, n = f"{base}_{n}", n + 1
            taken.add(column.lower())
            out[column] = name
        return out

    def table(self, rows: DataFrame, keep_unreadable: bool = False) -> DataFrame:
        """(file_id, line_no, <a typed column a canonical field>, failed_casts array<struct<field, raw, type>>).

        With ``keep_unreadable`` null, broken and non-object payloads stay as rows without values
        whose only failed cast is the payload itself.
        """
        view = rows.select("file_id", "line_no", "payload", F.expr("try_parse_json(payload)").alias("doc"))
        readable = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
        view = view.withColumn("readable", readable).withColumn("doc", F.when(F.col("readable"), F.col("doc")))
        if not keep_unreadable:
            view = view.filter("readable")
        meta = F.try_variant_get("doc", "$.meta", "variant")
        kind = F.schema_of_variant(meta)
        view = view.withColumn("meta_doc", F.when(kind == "STRING", F.expr("try_parse_json(CAST(try_variant_get(doc, '$.meta', 'variant') AS STRING))")).when(kind.startswith("OBJECT"), meta))
        as_map = "map<string,variant>"
        view = view.withColumn("doc_map", F.try_variant_get("doc", "$", as_map)).withColumn("meta_map", F.try_variant_get("meta_doc", "$", as_map))
        columns, failures = [], []
        for column, name in self.column_names().items():
            raw = F.coalesce(*[self._raw(p) for p in self.aliases[name]])
            kind = self.types[name]
            value = F.try_variant_get(raw, "$", kind) if kind != "string" else F.coalesce(F.try_variant_get(raw, "$", "string"), F.to_json(raw))
            columns.append(value.alias(column))
            told = F.struct(F.lit(name).alias("field"), F.to_json(raw).alias("raw"), F.lit(kind).alias("type"))
            failures.append(F.when(raw.isNotNull() & ~F.is_variant_null(raw) & value.isNull(), told))
        failures.append(F.when(~F.col("readable"), F.struct(F.lit("").alias("field"), F.col("payload").alias("raw"), F.lit("object").alias("type"))))
        return view.select("file_id", "line_no", *columns, F.filter(F.array(*failures), lambda x: x.isNotNull()).alias("failed_casts"))
