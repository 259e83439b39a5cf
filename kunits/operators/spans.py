"""Chunks of normalised texts that know where they stand in the source.

Normalising replaces or removes pieces of a text. A chunk carries the pieces
between, each with its place in the chunk and in the source; spans of
successive chunks join without a gap, and normalising a span gives the chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What is normalised by default: runs of white space become one space, other control characters go.
RULES: tuple[tuple[str, str], ...] = ((r"[ \t\n\x0b\f\r]+", " "), (r"[\x00-\x08\x0e-\x1f\x7f]+", ""))
MOST = 6000
_PIECE = "array<struct<at:int,source:int>>"


class Normaliser:
    """Rules (pattern, replacement) in one pass from left to right; patterns look at what they replace alone."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.by = [with_ for _, with_ in rules]
        self.pattern = re.compile("|".join(f"({p})" for p, _ in rules))
        if self.pattern.groups != len(rules):
            raise ValueError("patterns have no groups of their own")

    def __call__(self, text: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(normalised text, starts, sources, put): where its pieces begin, there and in the source, and which were put in place of others.

        A removed piece belongs to the piece before it.
        """
        out: list[str] = []
        starts, sources, put = [0], [0], [False]
        at = done = 0

        def begin(source: int, replaced: bool) -> None:
            if at == starts[-1]:
                sources[-1], put[-1] = source, replaced
            else:
                starts.append(at)
                sources.append(source)
                put.append(replaced)

        for m in self.pattern.finditer(text):
            if m.end() == m.start():
                continue
            new = self.by[m.lastindex - 1]
            if len(new) == 1 and m[0] == new:  # a space for a space: the piece goes on
                continue
            kept = text[done : m.start()]
            out += (kept, new)
            at += len(kept)
            if new:
                begin(m.start(), True)
            at += len(new)
            done = m.end()
            begin(done, False)
        out.append(text[done:])
        return "".join(out), np.array(starts, np.int64), np.array(sources, np.int64), np.array(put)


def chunks(docs: DataFrame, key: str, text: str = "text", most: int = MOST, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """key, chunk_no, chunk_id, chunk, source_start, source_end, bounded, pieces: chunks of at most *most* characters.

    Spans are in characters of the source, the end excluded; those of a
    document's chunks follow each other from 0 to its end. ``bounded``: the
    document has more than one chunk. ``pieces``: places within the chunk
    where a piece begins, with their place in the source (see
    :func:`source_place`). A null or empty text is one empty chunk. A
    replacement longer than one character is cut at its start, so that each
    span normalises to its chunk. Narrow: no shuffle.
    """
    if most < max((len(put) for _, put in rules), default=1) or most < 1:
        raise ValueError("a chunk must hold any replacement")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T.StructType.fromDDL(f"chunk_no int, chunk string, source_start int, source_end int, bounded boolean, pieces {_PIECE}").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = Normaliser(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                owner, rows = [], []
                for i, said in enumerate(part.column(1).to_pylist()):
                    found = list(spans(said or "", most, normal))
                    owner += [i] * len(found)
                    rows += found
                columns = [pa.array([r[c] for r in rows], arrow.field(c + 1).type) for c in range(6)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *columns], schema=arrow)

    made = docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
    chunk_id = F.concat(F.lit("chunk-"), F.substring(F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), "chunk_no", "chunk"), 256), 1, 24))
    return made.select(key, "chunk_no", chunk_id.alias("chunk_id"), "chunk", "source_start", "source_end", "bounded", "pieces")


def spans(text: str, most: int, normal: Normaliser) -> Iterator[tuple]:
    """(number, chunk, start and end in the source, bounded, pieces) of each chunk of a text."""
    whole, starts, sources, put = normal(text)
    ends = np.append(starts[1:], len(whole))
    places = [0]
    while places[-1] < len(whole):
        cut = min(places[-1] + most, len(whole))
        piece = int(np.searchsorted(starts, cut, "right")) - 1
        if put[piece] and places[-1] < starts[piece] < cut < ends[piece]:
            cut = int(starts[piece])  # never within a replacement
        places.append(cut)
    if len(places) == 1:
        places.append(0)
    source = lambda p: int(sources[i := int(np.searchsorted(starts, p, "right")) - 1] + p - starts[i])
    for n, (a, b) in enumerate(zip(places, places[1:], strict=False)):
        first, last = (int(np.searchsorted(starts, x, "right")) - 1 for x in (a, max(a, b - 1)))
        pieces = [{"at": max(int(starts[i]) - a, 0), "source": source(max(int(starts[i]), a))} for i in range(first, last + 1)]
        yield n, whole[a:b], source(a) if n else 0, source(b) if b < len(whole) else len(text), len(places) > 2, pieces


def source_place(pieces: Column, place: Column) -> Column:
    """Place in the source of a place in a chunk."""
    before = F.try_element_at(F.filter(pieces, lambda p: p["at"] <= place), F.lit(-1))
    return before["source"] + place - before["at"]


def gate(chunked: DataFrame, supported: DataFrame, key: str) -> DataFrame:
    """key, n_chunks, n_supported, status: whether a document's chunks may go on to be reduced.

    *supported* lists key and chunk_id of chunks with verified evidence.
    ``all_unsupported`` stops before anything is asked again, ``partial`` and
    ``complete`` go on. Ids of other documents' chunks don't count.
    """
    good = supported.select(key, "chunk_id").distinct().withColumn("_good", F.lit(1))
    rows = chunked.select(key, "chunk_id").join(good, [key, "chunk_id"], "left").groupBy(key).agg(F.count("*").alias("n_chunks"), F.count("_good").alias("n_supported"))
    status = F.when(F.col("n_supported") == 0, "all_unsupported").when(F.col("n_supported") < F.col("n_chunks"), "partial").otherwise("complete")
    return rows.withColumn("status", status)
