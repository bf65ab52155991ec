"""Chunks of blocks with context for outside workers, and the check and repair of what they return."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.scalars import repair_block
from ..schema import CHUNK_BLOCKS, CONTEXT_BLOCKS, SMALL_CHUNK, SMALL_FILE


def chunk_size(n: Column, size: int = CHUNK_BLOCKS) -> Column:
    return F.when(n < SMALL_FILE, F.lit(min(size, SMALL_CHUNK))).otherwise(F.lit(size))


def with_chunks(blocks: DataFrame, key: Sequence[str], size: int = CHUNK_BLOCKS) -> DataFrame:
    """Adds n_blocks and chunk_id to blocks numbered from 0 by pos."""
    d = blocks.withColumn("n_blocks", F.count(F.lit(1)).over(W.partitionBy(*key)))
    return d.withColumn("__size", chunk_size(F.col("n_blocks"), size)).withColumn("chunk_id", F.floor(F.col("pos") / F.col("__size")).cast("int")).drop("__size")


def chunks_with_context(blocks: DataFrame, key: Sequence[str], size: int = CHUNK_BLOCKS, context: int = CONTEXT_BLOCKS) -> DataFrame:
    """A row for each chunk: start_block, end_block (exclusive), num_blocks, before, core, after (texts).

    A block is sent to its own chunk and, near an edge, to the neighbour as context: one exchange and no range
    join. Core texts are flattened to one line each, context texts are not.
    """
    d = with_chunks(blocks, key, size).withColumn("__size", chunk_size(F.col("n_blocks"), size))
    at = F.col("pos") % F.col("__size")
    role = lambda name, chunk: F.struct(F.lit(name).alias("role"), chunk.cast("int").alias("to"))
    follows = (F.col("chunk_id") + 1) * F.col("__size") < F.col("n_blocks")
    roles = F.array_compact(F.array(
        role("core", F.col("chunk_id")),
        F.when((at >= F.col("__size") - context) & follows, role("before", F.col("chunk_id") + 1)),
        F.when((at < context) & (F.col("chunk_id") > 0), role("after", F.col("chunk_id") - 1)),
    ))
    sent = d.withColumn("__r", F.explode(roles))

    def texts(role_name: str, flat: bool) -> Column:
        body = F.replace("text", F.lit("\n"), F.lit(" ")) if flat else F.col("text")
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("__r.role") == role_name, F.struct("pos", F.coalesce(body, F.lit("")).alias("t"))))), lambda x: x["t"])

    core = F.col("__r.role") == "core"
    return sent.groupBy(*key, F.col("__r.to").alias("chunk_id")).agg(
        F.min(F.when(core, F.col("pos"))).alias("start_block"), (F.max(F.when(core, F.col("pos"))) + 1).alias("end_block"), F.count(F.when(core, 1)).cast("int").alias("num_blocks"),
        texts("before", False).alias("before"), texts("core", True).alias("core"), texts("after", False).alias("after"),
    )


def render_chunk(before: Column, core: Column, after: Column, marker: str = "=====") -> Column:
    """A chunk as the text that a worker reads: context, marked blocks, context."""
    part = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"[{title}]\n"), F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(part("before", before), F.lit("[blocks]\n"), F.array_join(core, f"\n{marker}\n"), F.lit("\n\n"), part("after", after))


def process_chunks(chunks: DataFrame, worker: Callable[[list[str], list[str], list[str]], list[str]], key: Sequence[str]) -> DataFrame:
    """Call ``worker(before, core, after)`` for each chunk where its rows are; gives the key, chunk_id, output (block texts)."""
    columns = [*key, "chunk_id"]

    def run(frames):
        for f in frames:
            yield f[columns].assign(output=[worker(list(b), list(c), list(a)) for b, c, a in zip(f["before"], f["core"], f["after"])])

    schema = T.StructType([*(chunks.schema[c] for c in columns), T.StructField("output", T.ArrayType(T.StringType()))])
    return chunks.select(*columns, "before", "core", "after").mapInPandas(run, schema)


def check_chunks(chunks: DataFrame, outputs: DataFrame, key: Sequence[str]) -> DataFrame:
    """State of each chunk: "missing" without output, "mismatch" if its number of blocks differs, else "ok".

    Any mismatch is reported, a single block too; what was returned is still put together.
    """
    found = outputs.select(*key, "chunk_id", F.size("output").alias("n_found"))
    state = F.when(F.col("n_found").isNull(), "missing").when(F.col("n_found") != F.col("num_blocks"), "mismatch").otherwise("ok")
    return chunks.join(found, [*key, "chunk_id"], "left").select(*key, "chunk_id", "num_blocks", "n_found", state.alias("state"))


def failed_chunks(states: DataFrame, key: Sequence[str]) -> DataFrame:
    """The numbers of each key's missing and mismatched chunks, in order, from check_chunks."""
    of = lambda state: F.array_sort(F.collect_list(F.when(F.col("state") == state, F.col("chunk_id"))))
    return states.groupBy(*key).agg(of("missing").alias("missing"), of("mismatch").alias("mismatched"))


def reassemble(blocks: DataFrame, chunks: DataFrame, outputs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Blocks with the returned text of their place, repaired; '' where none came back."""
    placed = chunks.join(outputs, [*key, "chunk_id"]).select(*key, "start_block", F.posexplode(F.slice("output", F.lit(1), F.col("num_blocks"))).alias("i", "new"))
    placed = placed.select(*key, (F.col("start_block") + F.col("i")).cast("int").alias("pos"), "new")
    two = F.instr(F.coalesce("text", F.lit("")), "\n") > 0
    return blocks.join(placed, [*key, "pos"], "left").withColumn("text", repair_block(F.coalesce("new", F.lit("")), two)).drop("new")
