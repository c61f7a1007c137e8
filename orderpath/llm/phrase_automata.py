"""Repeated passages across documents, located by sharded Aho-Corasick automata.

A window is WINDOW consecutive words. Every window names one of its GRAM-word pieces, the one
with the smallest hash, from its own words alone: equal windows name equal pieces. Consecutive
windows that name the same piece form one segment of the text, which is what travels.

1. Documents are packed, compressed, into rows of bounded size, written once. Hashes of named
   pieces are counted in shards; a piece of a single document cannot be in a repeated window.
2. Packs emit the segments of pieces that recur, each distinct text once with the smallest and
   largest id that has it. A shard gets all segments of its pieces. Windows of very frequent
   pieces travel one by one to the shard of their own hash, so a common line with many
   surroundings is spread too.
3. A shard confirms, on the words themselves, which windows occur under two ids, compiles them
   into an automaton over coded words (pyahocorasick), and streams all its segments through it. Each
   hit is the place of a window and the smallest id that has it.
4. Packs turn hits into removed words of their documents.

A shard holds the segments of about PACKS_A_SHARD pack, as shards grow with the packs. A
passage in many documents is one entry a pack.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpath.llm.common import document_columns, small_batches, stage_table, texts_of
from orderpath.llm.setsketch import mixed

WINDOW, GRAM = 13, 5
PACK_BYTES, PACK_ROWS = 8 << 20, 8000
PACKS_A_SHARD = 1
FREQUENT = 2000
CHUNK = 1 << 20
NULL_ID = np.iinfo(np.int64).min
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
FACTORS = np.random.default_rng(7).integers(1, 1 << 63, size=GRAM, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

PACKS = "number long, docs long, ids binary, sizes binary, texts binary"
COUNTS = "shard long, pack long, keys binary, docs binary"
RECURRING = "pack long, keys binary, frequent binary"
SEGMENTS = "pack long, shard long, lows binary, highs binary, segments binary, places binary"
HITS = "pack long, shard long, hits binary"
HIT = np.dtype([("segment", "<u4"), ("first", "<u4"), ("last", "<u4"), ("owner", "<i8")])


def one_row(values: Sequence, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*[c.split() for c in schema.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[t]) for v, t in zip(values, types)], list(names))


def pack_documents(docs: DataFrame) -> DataFrame:
    """The documents in compressed packs; null texts count as empty, null ids as the smallest id."""

    def packed(number: int, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], dtype="<i8").tobytes()
        body = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        return one_row([number, len(ids), np.array(ids, dtype="<i8").tobytes(), sizes, body], PACKS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, texts = 0, 0, [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids.append(NULL_ID if doc_id is None else doc_id)
                texts.append(text.encode())
                held += len(texts[-1])
                if held >= PACK_BYTES or len(ids) >= PACK_ROWS:
                    yield packed(number, ids, texts)
                    number, held, ids, texts = number + 1, 0, [], []
        if ids:
            yield packed(number, ids, texts)

    packs = document_columns(small_batches(docs)).mapInArrow(work, PACKS)
    pack = F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("number")
    return stage_table(packs.select(pack.alias("pack"), "docs", "ids", "sizes", "texts"), "packs")


def unpacked(ids: bytes, sizes: bytes, texts: bytes) -> Iterator[tuple[int, bytes]]:
    body, at = zstandard.ZstdDecompressor().decompress(texts), 0
    for doc_id, size in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(sizes, "<i8").tolist()):
        yield doc_id, body[at : at + size]
        at += size


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Places:
    """Word hashes of a text, and the pieces its windows name; powers are kept between texts."""

    def __init__(self, window: int):
        self.window, self.width = window, window - GRAM + 1
        self.up, self.down = powers(BASE, 1), powers(BASE_INVERSE, 1)

    def chunk_hashes(self, text: bytes) -> np.ndarray:
        letters = np.frombuffer(text, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[letters], [True]])))
        starts, ends = edges[::2], edges[1::2]
        if len(letters) >= len(self.up):
            self.up, self.down = powers(BASE, len(letters) + 1), powers(BASE_INVERSE, len(letters) + 1)
        sums = np.zeros(len(letters) + 1, dtype=np.uint64)
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * self.up[: len(letters)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def word_hashes(self, text: bytes) -> np.ndarray:
        """One hash a word; long texts in chunks that end behind a word."""
        parts, at = [], 0
        while len(text) - at > CHUNK:
            end = at + CHUNK
            while end < len(text) and not SPACE[text[end]]:
                end += 1
            parts.append(self.chunk_hashes(text[at:end]))
            at = end
        parts.append(self.chunk_hashes(text[at:]))
        return np.concatenate(parts)

    def named(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Per window: the place of the piece it names (the leftmost of equal ones) and its hash."""
        if len(text) < 2 * self.window - 1:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        words = self.word_hashes(text)
        if len(words) < self.window:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        pieces = len(words) - GRAM + 1
        grams = np.zeros(pieces, dtype=np.uint64)
        for j in range(GRAM):
            grams += words[j : j + pieces] * FACTORS[j]
        grams = mixed(grams)
        places = sliding_window_view(grams, self.width).argmin(axis=1) + np.arange(pieces - self.width + 1)
        return places, grams[places]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def recurring_pieces(packs: DataFrame, shards: int, window: int, frequent: int) -> DataFrame:
    """``pack``, ``keys``, ``frequent``: hashes of named pieces that two documents have, for each pack with them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(window)
        for row in pack_rows(batches):
            found = [np.unique(places.named(text)[1]) for _, text in unpacked(row["ids"], row["sizes"], row["texts"])]
            keys, docs = np.unique(np.concatenate(found), return_counts=True)
            where = shard_of(keys, shards)
            order = np.argsort(where, kind="stable")
            keys, docs, where = keys[order], docs[order].astype("<u4"), where[order]
            cuts = np.flatnonzero(np.diff(where)) + 1
            for k, d, s in zip(np.split(keys, cuts), np.split(docs, cuts), np.split(where, cuts)):
                if len(k):
                    yield one_row([int(s[0]), row["pack"], k.tobytes(), d.tobytes()], COUNTS)

    def merge(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(v.as_buffer(), "<u8") for v in group.column("keys")]
        docs = [np.frombuffer(v.as_buffer(), "<u4") for v in group.column("docs")]
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(docs), minlength=len(distinct))[where]
        out, at = [], 0
        for pack, k in zip(group.column("pack").to_pylist(), keys):
            n = total[at : at + len(k)]
            at += len(k)
            if (n >= 2).any():
                out.append((pack, k[n >= 2].tobytes(), (n[n >= 2] > frequent).tobytes()))
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.table({"pack": pa.array(columns[0], pa.int64()), "keys": pa.array(columns[1], pa.binary()), "frequent": pa.array(columns[2], pa.binary())})

    counts = packs.select("pack", "ids", "sizes", "texts").mapInArrow(count, COUNTS)
    return counts.groupBy("shard").applyInArrow(merge, RECURRING)


def segment_rows(packs: DataFrame, pieces: DataFrame, shards: int, window: int) -> DataFrame:
    """Per pack and shard: distinct segments with their ids' range, and the places of each in the pack."""

    def spans(named: np.ndarray, recurs: np.ndarray, often: np.ndarray) -> Iterator[tuple[int, int, bool]]:
        """(first window, last window, alone) of the segments; windows of frequent pieces stand alone."""
        cut = np.flatnonzero((np.diff(named) != 0) | often[1:]) + 1
        firsts = np.concatenate([[0], cut])
        lasts = np.concatenate([cut, [len(named)]]) - 1
        for first, last, yes, alone in zip(firsts.tolist(), lasts.tolist(), recurs[firsts].tolist(), often[firsts].tolist()):
            if yes:
                yield first, last, alone

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(window)
        for row in pack_rows(batches):
            keys = np.frombuffer(b"".join(p["keys"] for p in row["pieces"]), "<u8")
            often = np.frombuffer(b"".join(p["frequent"] for p in row["pieces"]), bool)
            order = np.argsort(keys)
            keys, often = keys[order], often[order]
            found: dict[int, tuple[dict[bytes, int], list, list, list]] = {}
            for number, (doc_id, text) in enumerate(unpacked(row["ids"], row["sizes"], row["texts"])):
                named, hashes = places.named(text)
                if not len(named):
                    continue
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                recurs = keys[at] == hashes
                if not recurs.any():
                    continue
                words, home = text.split(), shard_of(hashes, shards).tolist()
                for first, last, alone in spans(named, recurs, often[at] & recurs):
                    segment = b" ".join(words[first : last + window])
                    shard = xxhash.xxh3_64_intdigest(segment) % shards if alone else home[first]
                    numbers, lows, highs, put = found.setdefault(shard, ({}, [], [], []))
                    n = numbers.setdefault(segment, len(numbers))
                    if n == len(lows):
                        lows.append(doc_id)
                        highs.append(doc_id)
                    else:
                        lows[n], highs[n] = min(lows[n], doc_id), max(highs[n], doc_id)
                    put += (n, number, first)
            for shard, (numbers, lows, highs, put) in found.items():
                body = zstandard.ZstdCompressor(level=1).compress(b"\n".join(numbers))
                blobs = np.array(lows, "<i8").tobytes(), np.array(highs, "<i8").tobytes(), body, np.array(put, "<u4").tobytes()
                yield one_row([row["pack"], shard, *blobs], SEGMENTS)

    lists = pieces.groupBy("pack").agg(F.collect_list(F.struct("keys", "frequent")).alias("pieces"))
    given = packs.select("pack", "ids", "sizes", "texts").join(lists, "pack")
    return stage_table(given.mapInArrow(emit, SEGMENTS), "segments")


def runs_of(hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first, last, owner) of consecutive places with one owner."""
    runs: list[tuple[int, int, int]] = []
    for place, owner in hits:
        if runs and runs[-1][1] == place - 1 and runs[-1][2] == owner:
            runs[-1] = (runs[-1][0], place, owner)
        else:
            runs.append((place, place, owner))
    return runs


def two_symbols(segments: Iterable[bytes]) -> dict[bytes, str]:
    """Every word as two symbols of about sqrt(words), the second ones apart from the first ones.

    A node of the automaton then has few children, which are searched one by one, and a match
    can only begin at a word.
    """
    numbers: dict[bytes, int] = {}
    for segment in segments:
        for word in segment.split(b" "):
            numbers.setdefault(word, len(numbers))
    base = math.isqrt(len(numbers)) + 1
    return {word: chr(n // base + 1) + chr(n % base + base + 1) for word, n in numbers.items()}


def located(segments: dict[bytes, list[int]], window: int) -> dict[bytes, list[tuple[int, int, int]]]:
    """Runs of windows that two ids have, for each segment; ``segments`` gives [smallest, largest id].

    The windows are confirmed on their words, put into an automaton, and found again in all
    segments by streaming them through it; an occurrence carries the window's smallest id.
    """
    symbols = two_symbols(segments)
    coded = {s: "".join([symbols[w] for w in s.split(b" ")]) for s in segments}
    symbols.clear()
    size = 2 * window
    ranges: dict[str, list[int]] = {}
    for segment, words in coded.items():
        low, high = segments[segment]
        for i in range(0, len(words) - size + 1, 2):
            known = ranges.setdefault(words[i : i + size], [low, high])
            if low < known[0]:
                known[0] = low
            if high > known[1]:
                known[1] = high
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for words, (low, high) in ranges.items():
        if low < high:
            automaton.add_word(words, low)
    ranges.clear()
    if not len(automaton):
        return {}
    automaton.make_automaton()
    found = {}
    for segment, words in coded.items():
        hits = [((end + 1) // 2 - window, owner) for end, owner in automaton.iter(words)]
        if hits:
            found[segment] = runs_of(hits)
    return found


def shard_hits(segments: DataFrame, window: int) -> DataFrame:
    """``pack``, ``shard``, ``hits``: runs of windows in the pack's segments that a smaller id has."""

    def work(group: pa.Table) -> pa.Table:
        rows, ranges = [], {}
        for i in range(group.num_rows):
            texts = zstandard.ZstdDecompressor().decompress(group.column("segments")[i].as_py()).split(b"\n")
            lows = np.frombuffer(group.column("lows")[i].as_buffer(), "<i8").tolist()
            highs = np.frombuffer(group.column("highs")[i].as_buffer(), "<i8").tolist()
            rows.append((texts, highs))
            for text, low, high in zip(texts, lows, highs):
                known = ranges.setdefault(text, [low, high])
                known[0], known[1] = min(known[0], low), max(known[1], high)
        found = located(ranges, window)
        out = []
        for (texts, highs), pack, shard in zip(rows, group.column("pack").to_pylist(), group.column("shard").to_pylist()):
            hits = [
                (n, first, last, owner)
                for n, (text, high) in enumerate(zip(texts, highs))
                for first, last, owner in found.get(text, ())
                if owner < high
            ]
            if hits:
                out.append((pack, shard, np.array(hits, dtype=HIT).tobytes()))
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.table({"pack": pa.array(columns[0], pa.int64()), "shard": pa.array(columns[1], pa.int64()), "hits": pa.array(columns[2], pa.binary())})

    return segments.select("pack", "shard", "lows", "highs", "segments").groupBy("shard").applyInArrow(work, HITS)


def removed_words(ids: np.ndarray, found: list[dict], window: int) -> dict[int, list[tuple[int, int]]]:
    """Per document of a pack, the merged word spans [start, end) under windows of smaller ids."""
    docs, starts, ends = [], [], []
    for shard in found:
        hits = np.frombuffer(shard["hits"], HIT)
        segment, doc, place = np.frombuffer(shard["places"], "<u4").reshape(-1, 3).astype(np.int64).T
        left, right = np.searchsorted(hits["segment"], segment), np.searchsorted(hits["segment"], segment, "right")
        times = right - left
        which = np.repeat(left, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        doc, place, hits = np.repeat(doc, times), np.repeat(place, times), hits[which]
        less = hits["owner"] < ids[doc]
        docs.append(doc[less])
        starts.append((place + hits["first"])[less])
        ends.append((place + hits["last"] + window)[less])
    spans: dict[int, list[tuple[int, int]]] = {}
    if not docs:
        return spans
    doc, start, end = np.concatenate(docs), np.concatenate(starts), np.concatenate(ends)
    order = np.lexsort((start, doc))
    for d, s, e in zip(doc[order].tolist(), start[order].tolist(), end[order].tolist()):
        mine = spans.setdefault(d, [])
        if mine and s <= mine[-1][1]:
            mine[-1] = (mine[-1][0], max(mine[-1][1], e))
        else:
            mine.append((s, e))
    return spans


RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, frequent: int = FREQUENT) -> DataFrame:
    """Every row without the words under a window that starts in a row of a smaller id too.

    ``doc_id``, ``n_words``, ``n_removed``, ``spans`` (removed words, [start, end)), ``kept`` (the
    other words, joined by one space). Windows are those of the input, and must have GRAM words
    or more. Words end at ``[\\x20\\x09-\\x0D]`` and are compared as they are. A null text has no words,
    a text shorter than a window loses none. Null ids are one id, smaller than all others; rows of one id
    do not remove words from each other. Extra columns are not read; an empty table gives no rows.
    """
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} words or more")
    packs = pack_documents(docs)
    shards = max(1, -(-packs.count() // PACKS_A_SHARD))
    segments = segment_rows(packs, recurring_pieces(packs, shards, window, frequent), shards, window)
    places = segments.select("pack", "shard", "places").join(shard_hits(segments, window), ["pack", "shard"])
    lists = places.groupBy("pack").agg(F.collect_list(F.struct("places", "hits")).alias("found"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", spans), ("kept", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pack_rows(batches):
            ids = np.frombuffer(row["ids"], "<i8")
            removed = removed_words(ids, row["found"] or [], window)
            out = []
            for number, (doc_id, text) in enumerate(unpacked(row["ids"], row["sizes"], row["texts"])):
                words, gone = text.split(), removed.get(number, [])
                kept, at = [], 0
                for start, end in gone:
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                lost = [{"start": s, "end": e} for s, e in gone]
                out.append((None if doc_id == NULL_ID else doc_id, len(words), len(words) - len(kept), lost, b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return packs.select("pack", "ids", "sizes", "texts").join(lists, "pack", "left").mapInArrow(work, RESULT)
