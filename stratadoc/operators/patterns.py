"""Which of many strings are anywhere in which texts, by Aho-Corasick automata over bounded blocks of the strings."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the strings in one automaton; of those that a pass over the texts takes, and are sent to all tasks; of texts that a task holds.
BLOCK_CHARS, PASS_CHARS, HELD_CHARS = 1 << 20, 1 << 24, 1 << 24


def automaton(strings: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for s in strings:
        made.add_word(s, s)
    made.make_automaton()
    return made


def blocks(strings: list[str], most: int) -> list[list[str]]:
    """The strings in blocks of so many characters, one string at least."""
    out, size = [[]], 0
    for s in strings:
        if size and size + len(s) > most:
            out.append([])
            size = 0
        out[-1].append(s)
        size += len(s)
    return out


def held_strings(texts: DataFrame, strings: DataFrame, text_col: str = "text", string_col: str = "string") -> DataFrame:
    """The rows of texts without their text, once with each of the different strings that the text holds, as string_col.

    The strings are a stated set: each pass over the texts takes PASS_CHARS characters of them, which every task gets,
    and looks for them block by block in what it holds of the texts. So there is no join of texts and strings, and a
    string of any length or frequency is met where the texts lie. The empty string is in every text; null strings and
    texts hold and are held by none.
    """
    spark = texts.sparkSession
    own = strings.select(F.col(string_col).cast("string").alias("s")).where("s is not null").distinct()
    passes = max(1, -(-(own.agg(F.sum(F.char_length("s"))).first()[0] or 0) // PASS_CHARS))
    kept = [c for c in texts.columns if c != text_col]
    source = texts.where(F.col(text_col).isNotNull()).select(*kept, F.col(text_col).cast("string").alias(text_col))
    schema = source.drop(text_col).withColumn(string_col, F.lit("")).schema
    found, in_block, in_task = None, BLOCK_CHARS, HELD_CHARS
    for k in range(passes):
        part = [r.s for r in own.where(F.pmod(F.xxhash64("s"), F.lit(passes)) == k).collect()]  # PASS_CHARS of them
        sent = spark.sparkContext.broadcast(part)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            some = [s for s in sent.value if s]
            every = [s for s in sent.value if not s]
            parts = blocks(some, in_block)
            only = automaton(parts[0]) if some and len(parts) == 1 else None

            def out(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                table = pa.Table.from_batches(rows)
                values = table.column(text_col).to_pylist()
                others = table.drop_columns([text_col])
                for block in [*(parts if some else []), *([every] if every else [])]:
                    machine = None if block is every else only or automaton(block)
                    at, which = [], []
                    for i, text in enumerate(values):
                        hits = block if machine is None else {s for _, s in machine.iter(text)}
                        at += [i] * len(hits)
                        which += hits
                        if len(at) > 1 << 16:
                            yield from made(others, at, which)
                            at, which = [], []
                    yield from made(others, at, which)

            def made(others: pa.Table, at: list[int], which: list[str]) -> Iterator[pa.RecordBatch]:
                table = others.take(pa.array(at, pa.int64())).append_column(string_col, pa.array(which, pa.string()))
                yield from table.combine_chunks().to_batches()

            rows, size = [], 0
            for batch in batches:
                rows.append(batch)
                size += batch.column(batch.schema.get_field_index(text_col)).nbytes
                if size > in_task:
                    yield from out(rows)
                    rows, size = [], 0
            if rows:
                yield from out(rows)

        hits = source.mapInArrow(look, schema)
        found = hits if found is None else found.unionByName(hits)
    return found
