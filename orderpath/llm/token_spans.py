"""Token counts per section or field of a document, from one encoding of the whole document.

A document is encoded once. Byte-level tokens cover its bytes without gaps, so the running
sum of their lengths gives the span of each token, and sorted spans meet sorted section
bounds in one merge. A token that crosses a bound goes to one section by a named rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpath.llm.vocab import JSON_FILE, RANK_FILE, load

RULES = ("first", "last", "most")
SCHEMA = "doc_id long, section int, field string, start long, stop long, n_tokens long, n_crossing long"


def section_bounds(parts: list[str], split_lines: bool) -> tuple[list[int], list[int]]:
    """Byte ends of the sections and the field of each; a line feed belongs to the line it ends."""
    ends, fields, at = [], [], 0
    for i, part in enumerate(parts):
        data = part.encode()
        cuts = [at + len(data)]
        if split_lines and data:
            breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
            cuts = [at + int(b) for b in breaks if b < len(data)] + cuts
        ends += cuts
        fields += [i] * len(cuts)
        at += len(data)
    return ends, fields


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token and whether the token crosses a bound.

    ``first``/``last``: the section of the token's first/last byte. ``most``: the section
    that holds most of its bytes; the earliest of equal ones. Empty sections get no token.
    """
    token_starts = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)
    first = np.searchsorted(section_ends, token_starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    chosen = first.copy()
    starts = np.concatenate([[0], section_ends[:-1]])
    for t in np.flatnonzero(crossing):
        inside = np.arange(first[t], last[t] + 1)
        held = np.minimum(section_ends[inside], token_ends[t]) - np.maximum(starts[inside], token_starts[t])
        chosen[t] = inside[np.argmax(held)]
    return chosen, crossing


def count_tokens(
    docs: DataFrame,
    fields: Sequence[str] = ("text",),
    split_lines: bool = True,
    rule: str = "most",
    json_file: str = JSON_FILE,
    rank_file: str = RANK_FILE,
) -> DataFrame:
    """One row per section: its bytes ``[start, stop)`` in the document, its tokens and the crossing ones.

    The document is the concatenation of ``fields``; with ``split_lines`` each line of a field
    is a section of its own, else each field is one. The counts of a document add up to the
    tokens of the whole document. A null field counts as empty and still has one (empty)
    section; repeated rows are counted each; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = list(fields)
    parts = [F.coalesce(F.col(name).cast("string"), F.lit("")).alias(f"part_{i}") for i, name in enumerate(names)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(json_file, rank_file)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
            columns = [batch.column(i + 1).to_pylist() for i in range(len(names))]
            sizes = []
            for texts in zip(*columns):
                ends, owners = section_bounds(list(texts), split_lines)
                token_ends = np.cumsum(vocabulary.byte_lengths[vocabulary.encode("".join(texts))])
                bounds = np.array(ends, dtype=np.int64)
                section, crossing = allocate(token_ends, bounds, rule)
                n = len(bounds)
                sizes.append(n)
                out[1].append(np.arange(n))
                out[2].append(np.array(owners))
                out[3].append(np.concatenate([[0], bounds[:-1]]))
                out[4].append(bounds)
                out[5].append(np.bincount(section, minlength=n))
                out[6].append(np.bincount(section[crossing], minlength=n))
            if not sizes:
                continue
            flat = [np.concatenate(x) for x in out[1:]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                    pa.array(flat[0].astype(np.int32)),
                    pa.DictionaryArray.from_arrays(pa.array(flat[1].astype(np.int32)), pa.array(names)).dictionary_decode(),
                    *[pa.array(x.astype(np.int64)) for x in flat[2:]],
                ],
                ["doc_id", "section", "field", "start", "stop", "n_tokens", "n_crossing"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *parts).mapInArrow(work, SCHEMA)
