"""Segmentation: rows into pieces, lines into groups, nodes into ranges."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CHARS, MAX_CHARS, GROUP_BYTES = 1_000, 3_000, 400 * 1024
_SENTENCE = re.compile(r"(?<=[.!?。！？…])\s+|(?<=[.!?。！？…][\"”’』」)])\s+")


def greedy_pack(parts: list[str], limit: int, glue: str) -> list[str]:
    """Join parts in order while the result stays within the limit; a part over it stands alone."""
    out: list[str] = []
    current = ""
    for part in parts:
        joined = f"{current}{glue}{part}" if current else part
        if len(joined) > limit and current:
            out.append(current)
            current = part
        else:
            current = joined
    return [*out, current] if current else out


def chunks_of(text: str | None, limit: int = MAX_CHARS) -> list[str]:
    """Blocks packed up to the limit; a block over it by sentences (bracketed blocks by lines), the rest by size."""
    if not text or not text.strip():
        return []
    limit = max(limit if limit > 0 else MAX_CHARS, MIN_CHARS)
    clean = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text.replace("\r\n", "\n").replace("\r", "\n"))).strip()
    out: list[str] = []
    waiting: list[str] = []
    for block in (b.strip() for b in re.split(r"\n{2,}", clean)):
        if len(block) <= limit:
            waiting.append(block)
            continue
        out += greedy_pack([b for b in waiting if b], limit, "\n\n")
        waiting = []
        system = block.startswith("[") and block.endswith("]")
        pieces = [p.strip() for p in (block.split("\n") if system else _SENTENCE.split(block)) if p.strip()]
        cut = [p[i : i + limit] for p in pieces for i in range(0, len(p), limit)]
        out += greedy_pack(cut, limit, "\n" if system else " ")
    return [c for c in out + greedy_pack([b for b in waiting if b], limit, "\n\n") if c]


def chunk_text(df: DataFrame, id_col: str, text_col: str, limit: int = MAX_CHARS) -> DataFrame:
    """``id, chunk_index, chunk``: size-bounded chunks of each text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(key, i, c) for key, text in f.itertuples(index=False, name=None) for i, c in enumerate(chunks_of(text, limit))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "chunk"])

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, chunk_index int, chunk string")


def in_order(df: DataFrame, key: str, order: list[str], schema: str, step: Callable, start: Callable) -> DataFrame:
    """A sequential fold over each key's rows in order, streamed: one row and one state at a time are held.

    ``start()`` gives a new state, ``step(state, row)`` returns ``(state, output row)``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                if getattr(row, key) != current:
                    current, state = getattr(row, key), start()
                state, made = step(state, row)
                out.append(made)
            if out:
                yield pd.DataFrame(out, columns=[p.split()[0].strip("`") for p in schema.split(",")])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def group_by_size(df: DataFrame, key: str, order: str, size: Column, limit: int = GROUP_BYTES) -> DataFrame:
    """``key, order, size, group_no``: consecutive rows up to a size; a row over it closes its group."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}
    rows = df.select(key, order, F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))

    def step(state: list, row) -> tuple[list, tuple]:
        used, group, closed = state
        n = int(row[2])
        if used and (closed or used + n > limit):
            used, group = 0, group + 1
        return [used + n, group, n > limit], (row[0], row[1], n, group)

    return in_order(rows, key, [order], f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, size bigint, group_no int", step, lambda: [0, 0, False])


def marker_segments(df: DataFrame, key: list[str], order: list[str], is_marker: Column) -> DataFrame:
    """Every row with ``segment``: the number of markers up to it (0 before the first)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("segment", F.sum(F.when(F.coalesce(is_marker, F.lit(False)), 1).otherwise(0)).over(w))


def segment_texts(df: DataFrame, key: list[str], order: list[str], is_marker: Column, text: str, fallback: bool = True) -> DataFrame:
    """One row a segment: heading line and joined body. Rows before the first marker form a segment if ``fallback``."""
    rows = marker_segments(df, key, order, is_marker).withColumn("_marker", F.coalesce(is_marker, F.lit(False)))
    rows = rows if fallback else rows.where("segment > 0")
    body = F.array_sort(F.collect_list(F.when(~F.col("_marker"), F.struct(*order, text))))
    return rows.groupBy(*key, "segment").agg(F.max(F.when(F.col("_marker"), F.col(text))).alias("heading"), F.array_join(F.transform(body, lambda x: x[text]), "\n").alias("body"), F.count_if(~F.col("_marker")).alias("lines"))


def without_dense(df: DataFrame, key: list[str], page: str, is_heading: Column, most: int = 4) -> DataFrame:
    """Rows of pages with fewer headings than a table of contents has."""
    count = F.sum(F.when(is_heading, 1).otherwise(0)).over(Window.partitionBy(*key, page))
    return df.withColumn("_headings", count).where(F.col("_headings") < most).drop("_headings")


def ranges(starts: DataFrame, key: str, order: str, last: Column | None = None) -> DataFrame:
    """``[start, end)`` of each start: the end is the next start, or the document's end."""
    w = Window.partitionBy(key).orderBy(order)
    end = F.lead(order).over(w)
    return starts.withColumn("end_at", F.coalesce(end, last) if last is not None else end)


def assign_to_ranges(nodes: DataFrame, starts: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Each node with the label of the last start at or before it; an as-of join as one union and one window."""
    a = starts.select(key, order, F.lit(0).alias("_side"), F.col(label).alias("_label"))
    b = nodes.withColumn("_side", F.lit(1))
    both = b.unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(label, F.last("_label", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_label")


def range_texts(nodes: DataFrame, starts: DataFrame, key: str, order: str, label: str, text: str) -> DataFrame:
    """Texts of ranges, joined in order; nodes before the first start are left out."""
    inside = assign_to_ranges(nodes, starts, key, order, label).where(F.col(label).isNotNull())
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return inside.groupBy(key, label).agg(F.array_join(F.transform(parts, lambda x: x[text]), "\n").alias(text), F.count("*").alias("nodes"))


def range_problems(df: DataFrame, start: str, end: str, text: str) -> DataFrame:
    """Ranges with a code: same boundary, inverted, empty, or ok."""
    code = F.when(F.col(start) == F.col(end), "SAME_BOUNDARY").when(F.col(start) > F.col(end), "INVERTED").when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "EMPTY").otherwise("OK")
    return df.withColumn("code", code)


def before_first(df: DataFrame, key: str, order: str, is_boundary: Column) -> DataFrame:
    """Rows before each key's first boundary."""
    first = F.min(F.when(is_boundary, F.col(order))).over(Window.partitionBy(key))
    return df.withColumn("_first", first).where(F.col(order) < F.col("_first")).drop("_first")


def carry_forward(df: DataFrame, key: list[str], order: list[str], value: str, reset: Column | None = None) -> DataFrame:
    """``value`` filled from the last row that has it; a reset row starts anew (volumes, arcs with end markers)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if reset is None:
        return df.withColumn(value, F.last(value, ignorenulls=True).over(w))
    island = df.withColumn("_island", F.sum(F.when(F.col(value).isNotNull() | F.coalesce(reset, F.lit(False)), 1).otherwise(0)).over(w))
    return island.withColumn(value, F.first(value, ignorenulls=False).over(Window.partitionBy(*key, "_island").orderBy(*order))).drop("_island")


def last_per_number(df: DataFrame, key: list[str], number: str, order: str) -> DataFrame:
    w = Window.partitionBy(*key, number).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fixed_chunks(df: DataFrame, key: list[str], order: list[str], size: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("chunk_no", F.floor((n - 1) / size).cast("int"))


def protect(text: Column, names: list[str]) -> Column:
    """Names as numbered tokens, longest first; ``restore`` with the same list undoes it."""
    for i, n in enumerate(sorted(names, key=lambda x: (-len(x), x))):
        text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}])\Q{n}\E(?![\p{{L}}\p{{N}}])", f"⟦{i:04d}⟧")
    return text


def restore(text: Column, names: list[str]) -> Column:
    for i, n in enumerate(sorted(names, key=lambda x: (-len(x), x))):
        text = F.replace(text, F.lit(f"⟦{i:04d}⟧"), F.lit(n))
    return text
