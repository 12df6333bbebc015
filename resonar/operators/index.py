"""Index: one row for each text, with its normal form and its further search keys."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KEY_WEIGHTS, SearchConfig
from ..functions.languages import BACKENDS, Backend, chinese, japanese
from ..functions.languages.backends import cap_keys
from ..functions.languages.mapped import Key
from ..functions.normalize import fold_col, is_ascii, normalize, normalize_col
from ..shared import spread, stored

SPAN = "struct<start_char:int,end_char:int>"
#: Keys other than the text and its normal form; norm is the key's own normal form.
EXTRA = f"array<struct<text:string,kind:string,weight:int,norm:string,source_map:array<{SPAN}>>>"
_SPAN_TYPE = pa.struct([("start_char", pa.int32()), ("end_char", pa.int32())])
_KEY_TYPE = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.string()), ("weight", pa.int32()), ("norm", pa.string()), ("source_map", pa.list_(_SPAN_TYPE))]))
INDEX = f"id long, display string, norm string, case_fold_only boolean, keys {EXTRA}"


def with_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """Numbers from 0 in the order of the input. Counts of partitions go to the driver, rows do not.

    df is read twice, once to count, and must have the same partitions each time.
    """
    part, nth = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    counts = sorted(df.groupBy(part.alias("p")).count().collect())  # one row for each partition
    starts, at = [], 0
    for p, n in counts:
        starts.append((p, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    numbered = df.select("*", part.alias("_part"), nth.alias("_nth"))
    return numbered.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_start") + F.col("_nth")).alias(name))


def extra_keys_of(text: str, backend: Backend, config: SearchConfig) -> list[Key]:
    base = [Key(text, "Original")] + [Key(normalize(text), "Normalized")] * config.normalize
    return cap_keys(base + backend.keys(text, config), config)[len(base) :]


def _key_array(rows: list[list[Key]]) -> pa.Array:
    """Keys of rows as an array of EXTRA, made column by column."""
    keys = [k for own in rows for k in own]
    spans = [s for k in keys if k.spans is not None for s in k.spans]
    none = pa.array([s is None for s in spans], pa.bool_())
    span = pa.StructArray.from_arrays([pa.array([s and s[n] for s in spans], pa.int32()) for n in (0, 1)], fields=list(_SPAN_TYPE), mask=none)
    ends = np.cumsum([0, *(0 if k.spans is None else len(k.spans) for k in keys)], dtype=np.int32)
    source = pa.ListArray.from_arrays(pa.array(ends), span, mask=pa.array([k.spans is None for k in keys], pa.bool_()))
    columns = [
        pa.array([k.text for k in keys], pa.string()), pa.array([k.kind for k in keys], pa.string()), pa.array([KEY_WEIGHTS[k.kind] for k in keys], pa.int32()),
        pa.array([normalize(k.text) for k in keys], pa.string()), source,
    ]
    flat = pa.StructArray.from_arrays(columns, fields=list(_KEY_TYPE.value_type))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)], dtype=np.int32)), flat)


def _keys_udf(backend: Backend, config: SearchConfig):
    def run(text: pa.Array) -> pa.Array:
        return _key_array([[] if t is None else extra_keys_of(t, backend, config) for t in text.to_pylist()])

    def call(text: pa.Array) -> pa.Array:
        return run(text)

    # not deterministic, says the plan: else a filter on the keys would be pushed below the spread and make them twice
    return F.arrow_udf(call, EXTRA).asNondeterministic()


def build_index(items: DataFrame, text: str = "search_text", *, id: str = "id", backend: Backend = BACKENDS["plain"], config: SearchConfig = SearchConfig()) -> DataFrame:
    """id, display, norm, case_fold_only, keys. Only texts with characters outside ASCII reach a Python worker; null texts go.

    Where a backend makes keys, rows are spread over all tasks first.
    """
    if backend.name in ("zh", "all") and backend.zh_table is None:
        backend = replace(backend, zh_table=chinese.shared_table(items.sparkSession))
    own = F.col("display")
    base = items.where(F.col(text).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("display"))
    keys = F.array().cast(EXTRA)
    if backend.has_keys:
        base = spread(base)
        keys = F.when(is_ascii(own), keys).otherwise(_keys_udf(backend, config)(F.when(~is_ascii(own), own)))
    base = base.withColumn("norm", normalize_col(own)).withColumn("keys", keys)
    return base.select("id", "display", "norm", (fold_col(own) == F.col("norm")).alias("case_fold_only"), "keys")


def _runs(batches):
    for batch in batches:
        rows = [(k, run) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for run in sorted(japanese.runs_to_read(text))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["row", "run"])


_WORDS = "array<struct<surface:string,readings:array<string>,start:int,end:int>>"


def _read_once(tokenizer):
    def run(batches):
        kind = pa.list_(pa.struct([("surface", pa.string()), ("readings", pa.list_(pa.string())), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            words = [[dict(zip(("surface", "readings", "start", "end"), w, strict=True)) for w in tokenizer(text)] for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, kind)], names=["run", "words"])

    return run


def build_index_by_runs(items: DataFrame, text: str = "search_text", *, id: str = "id", backend: Backend, config: SearchConfig = SearchConfig()) -> DataFrame:
    """build_index for a backend with readings, where the tokenizer is called once for each different run of the table.

    Runs are taken out of the texts, made distinct by a shuffle, read, and joined back by what they are. A run that a third
    of the rows hold is one row of the read side, and its rows are split by the adaptive join. Rows are told apart by a number of
    their own, so ids may repeat.
    """
    if backend.name in ("zh", "all") and backend.zh_table is None:
        backend = replace(backend, zh_table=chinese.shared_table(items.sparkSession))
    given = stored(items.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.col(text).alias("display")), "runs")
    some = given.where(~is_ascii(F.col("display")))
    held = some.select("row", "display").mapInArrow(_runs, "row long, run string")
    read = held.select("run").distinct().mapInArrow(_read_once(backend.tokenizer or japanese.default_tokenizer()), f"run string, words {_WORDS}")
    per_row = held.join(read, "run").groupBy("row").agg(F.collect_list(F.struct("run", "words")).alias("runs"))  # of one text
    kind = f"row long, keys {EXTRA}"

    def keys(batches):
        for batch in batches:
            out = []
            for own, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                known = {r["run"]: [(w["surface"], w["readings"], w["start"], w["end"]) for w in r["words"]] for r in runs or ()}
                out.append(extra_keys_of(own, replace(backend, tokenizer=known.__getitem__), config))
            yield pa.RecordBatch.from_arrays([batch.column(0), _key_array(out)], names=["row", "keys"])

    made = some.select("row", "display").join(per_row, "row", "left").select("row", "display", "runs").mapInArrow(keys, kind)
    both = given.join(made, "row", "left").withColumn("norm", normalize_col(F.col("display"))).withColumn("keys", F.coalesce("keys", F.array().cast(EXTRA)))
    return both.select("id", "display", "norm", (fold_col(F.col("display")) == F.col("norm")).alias("case_fold_only"), "keys")


def apply_aliases(index: DataFrame, items: DataFrame, aliases: DataFrame, *, config: SearchConfig = SearchConfig(), first_only: bool = True) -> DataFrame:
    """Adds a LearnedAlias key where an alias's display equals a row's original, display or search text.

    aliases has query and display. With first_only an alias goes to the row of the smallest id alone, as for a table
    that is complete; a stream gives it to every such row.
    """
    texts = items.select(F.col("id"), F.explode(F.array_distinct(F.array("original", "display", "search_text"))).alias("name")).where("name IS NOT NULL")
    hits = texts.join(aliases.select("query", F.col("display").alias("name")).distinct(), "name").select("query", "name", "id").distinct()
    if first_only:
        hits = hits.groupBy("query", "name").agg(F.min("id").alias("id"))
    hits = hits.withColumn("norm", normalize_col(F.col("query")))
    per_row = hits.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("query", "norm"))).alias("aliases"))
    out = index.join(per_row, "id", "left")
    key = lambda q: F.struct(q["query"].alias("text"), F.lit("LearnedAlias").alias("kind"), F.lit(KEY_WEIGHTS["LearnedAlias"]).alias("weight"), q["norm"].alias("norm"), F.lit(None).cast(f"array<{SPAN}>").alias("source_map"))
    base = 2 if config.normalize else 1
    start = F.octet_length("display") + (F.octet_length("norm") if config.normalize else 0)
    size = lambda keys: start + F.aggregate(keys, F.lit(0), lambda a, k: a + F.octet_length(k["text"]))
    fits = lambda keys, q: (F.size(keys) + base < config.max_search_keys_per_candidate) & (size(keys) + F.octet_length(q["query"]) <= config.max_total_key_bytes_per_candidate)
    added = F.aggregate(F.coalesce("aliases", F.array().cast("array<struct<query:string,norm:string>>")), F.col("keys"), lambda keys, q: F.when(fits(keys, q), F.concat(keys, F.array(key(q)).cast(EXTRA))).otherwise(keys))
    return out.withColumn("keys", added).drop("aliases").select(*index.columns)


def all_keys(config: SearchConfig = SearchConfig()) -> Column:
    """The whole list of a row's keys, base keys first."""
    one = lambda text, kind, flag: F.struct(text.alias("text"), F.lit(kind).alias("kind"), F.lit(KEY_WEIGHTS[kind]).alias("weight"), flag.alias("case_fold_only"))
    base = [one(F.col("display"), "Original", F.lit(False))] + [one(F.col("norm"), "Normalized", F.col("case_fold_only"))] * config.normalize
    more = F.transform("keys", lambda k: F.struct(k["text"].alias("text"), k["kind"].alias("kind"), k["weight"].alias("weight"), F.lit(False).alias("case_fold_only")))
    return F.concat(F.array(*base), more)


def newest_first(lines: DataFrame, line: str = "line", position: str = "pos") -> DataFrame:
    """Each line once, at its newest place, newest first. A line's places are reduced before they are shuffled."""
    newest = lines.groupBy(line).agg(F.max_by(F.struct(*lines.columns), position).alias("_newest"))
    return newest.select("_newest.*").orderBy(F.desc(position))
