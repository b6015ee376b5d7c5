"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm import batches as B
from lectern.llm.tokens import encoder

#: Lengths whose sums one task forms; sums of blocks are then added.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", id_col: str | None = None) -> DataFrame:
    """n_tokens of each text (0 for null and empty ones) and, if asked for, its id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encode = encoder(tokenizer).encode
            n = pa.array([len(encode(t or "")) // 4 for t in batch["__text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*([batch["__id"]] if id_col else []), n], names=[*([id_col] if id_col else []), "n_tokens"])

    columns = [F.col(text_col).alias("__text"), *([F.col(id_col).cast("long").alias("__id")] if id_col else [])]
    return docs.select(columns).mapInArrow(count, (f"`{id_col}` bigint, " if id_col else "") + "n_tokens bigint")


def length_table(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row for each length that occurs, which is also read as a context limit.

    n_tokens, docs and tokens (of that length), docs_at_least and tokens_at_least (of
    that length or more), truncated_tokens (of all documents cut to that length),
    docs_up_to and quantile (share of the documents of that length or less; the least
    n_tokens whose quantile is q or more is the q-quantile), total_docs, total_tokens.
    Null lengths are left out, length 0 counts like any other.  An empty table gives an
    empty table.  The sums over blocks are formed in one task, from one row for each
    BLOCK possible lengths: they are as many as the longest text is long, however many
    texts there are.
    """
    counts = lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))
    counts = B.checkpoint(counts)  # read twice below; the texts are encoded once
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), zero).alias("docs_after"), F.coalesce(F.sum("t").over(later), zero).alias("tokens_after"), F.sum("d").over(Window.partitionBy()).alias("total_docs"), F.sum("t").over(Window.partitionBy()).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("d", F.sum("docs").over(inside)).withColumn("t", F.sum("tokens").over(inside)).join(blocks, "block")
    at_least, tokens = F.col("d") + F.col("docs_after"), F.col("t") + F.col("tokens_after")
    up_to = F.col("total_docs") - at_least + F.col("docs")
    return summed.select("n_tokens", "docs", "tokens", at_least.alias("docs_at_least"), tokens.alias("tokens_at_least"), (F.col("total_tokens") - tokens + F.col("n_tokens") * at_least).alias("truncated_tokens"), up_to.alias("docs_up_to"), (up_to / F.col("total_docs")).alias("quantile"), "total_docs", "total_tokens")


def answers(table: DataFrame, limits: Sequence[int] = (), quantiles: Sequence[float] = ()) -> DataFrame:
    """For any context limits and quantiles: (question, asked, answer), from `length_table` alone.

    `truncated_tokens` of all documents cut to a limit, `docs_at_least` it, and the least
    length that has a share of at least q of the documents at or below it (`quantile`).
    Of an empty table the counts are 0 and the quantiles null.
    """
    n, zero = F.col("n_tokens"), F.lit(0).cast("long")
    asked = [("truncated_tokens", float(x), F.coalesce(F.sum(F.least(n, F.lit(x)) * F.col("docs")), zero)) for x in limits]
    asked += [("docs_at_least", float(x), F.coalesce(F.sum(F.when(n >= x, F.col("docs"))), zero)) for x in limits]
    asked += [("quantile", float(q), F.min(F.when(F.col("quantile") >= q, n))) for q in quantiles]
    if not asked:
        raise ValueError("no limits and no quantiles are asked for")
    row = F.array(*[F.struct(F.lit(name).alias("question"), F.lit(x).alias("asked"), c.cast("long").alias("answer")) for name, x, c in asked])
    return table.agg(row.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
