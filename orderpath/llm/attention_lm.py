"""Language-model scoring by causal self-attention over subword ids, trained here in numpy.

Text is the sequence of its words (A-Z lower-cased, split at white space) and one end. Each
word, with a space before it, becomes byte-level BPE ids. Learning has three parts, all over
the training documents:

* word counts, by a shuffle over every word of every training document;
* counts of ids, and of which class follows which id, from the BPE ids of each distinct word
  times its count; they are the network's starting point;
* the weights of the network, from windows that cover the text: every id, and every end, is
  predicted in one of them. Each round takes its share of the documents; workers train on
  windows dealt to them by a hash and their weights are averaged.

The network predicts a class of ids: frequent ids have a class each, the others share
classes by their first character, and an id inside its class has its share of the counts.
The shares of all ids of all classes sum to 1. The network's probability of a word is that of its
ids, given that a word or the end begins there, times that of another beginning (an id with a
space, or the end) behind them: over all words and the end these sum to 1 at most. The probability
of a word is WORD_SHARE times its share of all training words plus the rest times the network's.

Scoring cuts the ids of a document into overlapping windows. A window attends to itself under a
causal mask and scores only the tokens that no window before has scored, so every token is
scored once, with at least CONTEXT ids (or all there are) before it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpath.llm.common import document_columns, fold, stage_table
from orderpath.llm.vocab import END_ID, JSON_FILE, RANK_FILE, Vocabulary, load

SIZE, CLASSES, OWN_CLASSES, INPUTS = 16, 128, 96, 1024
WINDOW, CONTEXT = 24, 8
START_ID = 0xFFFF
ROUNDS, WORKERS, BATCH, RATE = 4, 12, 32, 0.01
# A worker's rate falls with the root of its own steps; its windows are bounded, workers grow with the text.
SLOW_STEPS, WORKER_WINDOWS = 200, 1 << 16
# Weights that are moved at a time, steps between two scalings of the optimizer's means.
PIECE, RESCALE = 1 << 16, 256
# Exponents within this need no largest value taken off; rows of a group added up side by side.
SAFE, LAYERS = 40.0, 8
BY_ROW = ("embed", "direct")
# Columns of queries, keys and values side by side.
PARTS = [slice(i * SIZE, (i + 1) * SIZE) for i in range(3)]
# Largest norm of a gradient, of a row of weights.
CLIP, NORM = 1.0, 8.0
PSEUDO, WORD_SHARE = 5.0, 0.6
HEAVY_WORDS, HEAVY_CHARS = 100_000, 64
LONG_WORD, END_MARK = 1000, "<|endoftext|>"
MEMO_WORDS = 200_000
WINDOWS_AT_ONCE = 256
WORDS_AT_ONCE = 1 << 16
LOG10 = np.log(10.0)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes.lower and bytes.split do just that."""
    return text.encode().lower().split()


# ---------------------------------------------------------------- counts


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (bytes), ``c``: how often each word stands in ``docs``; summed per batch before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"]
                )

    return docs.select("text").mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_ids(words: DataFrame, json_file: str, rank_file: str) -> np.ndarray:
    """Count of each id in the training documents, from the distinct words; one row per id returns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(json_file, rank_file)
        total = np.zeros(END_ID + 1, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                ids, sizes = encode_words(vocabulary, batch.column(0).to_pylist())
                each = np.repeat(batch.column(1).to_numpy(), sizes)
                total += np.bincount(ids, weights=each, minlength=len(total)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    rows = words.mapInArrow(work, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(END_ID + 1, dtype=np.int64)
    for row in rows:
        counts[row.id] = row.n
    return counts


def count_transitions(words: DataFrame, input_of: np.ndarray, class_of: np.ndarray, json_file: str, rank_file: str) -> np.ndarray:
    """INPUTS x CLASSES counts of which class follows which input row inside words.

    Two more rows: how often each class starts a word, and in the columns of a last block how often
    each input row ends a word (returned as a flat tail).
    """
    cells = INPUTS * CLASSES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(json_file, rank_file)
        total = np.zeros(cells + CLASSES + INPUTS, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, sizes = encode_words(vocabulary, batch.column(0).to_pylist())
            flat, times = flat.astype(np.int64), batch.column(1).to_numpy()
            last = np.cumsum(sizes) - 1
            inner = np.ones(len(flat), dtype=bool)
            inner[last] = False
            here = np.flatnonzero(inner)
            each = np.repeat(times, sizes)
            cell = input_of[flat[here]].astype(np.int64) * CLASSES + class_of[flat[here + 1]]
            # Sums stay exact: bincount adds doubles, and a batch holds far less than 2 ** 53.
            total[:cells] += np.bincount(cell, weights=each[here], minlength=cells).astype(np.int64)
            total[cells : cells + CLASSES] += np.bincount(class_of[flat[last - sizes + 1]], weights=times, minlength=CLASSES).astype(np.int64)
            total[cells + CLASSES :] += np.bincount(input_of[flat[last]], weights=times, minlength=INPUTS).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    counts = np.zeros(cells + CLASSES + INPUTS, dtype=np.float64)
    for row in words.mapInArrow(work, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return counts


def starting_table(counts: np.ndarray, class_share: np.ndarray, ends: int, end_class: int) -> np.ndarray:
    """Log probability of each class after each input row: inside words as counted, after a word
    as words start (or texts end) anywhere."""
    cells = INPUTS * CLASSES
    inside, firsts, lasts = counts[:cells].reshape(INPUTS, CLASSES), counts[cells : cells + CLASSES].copy(), counts[cells + CLASSES :]
    firsts[end_class] += ends
    firsts = (firsts + 0.5) / (firsts + 0.5).sum()
    table = inside + lasts[:, None] * firsts + PSEUDO * np.exp(class_share)
    table[INPUTS - 1] = firsts
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each with a space before it, one after the other, and how many each has.

    A space before a word ends the pre-token before it, so the words are encoded together and
    cut apart by their bytes; only words that hold other white space are encoded alone.
    """
    texts = [" " + word.decode() for word in words]
    alone = [i for i, text in enumerate(texts) if not text.isascii() and len(text.split()) != 1 or END_MARK in text or len(text) > LONG_WORD]
    apart = set(alone)
    joined = vocabulary.encode("".join(text for i, text in enumerate(texts) if i not in apart) if alone else "".join(texts))
    spans = np.array([len(word) + 1 for i, word in enumerate(words) if i not in apart], dtype=np.int64)
    starts = np.cumsum(vocabulary.byte_lengths[joined]) - vocabulary.byte_lengths[joined]
    sizes = np.bincount(np.searchsorted(np.cumsum(spans), starts, side="right"), minlength=len(spans))
    if not alone:
        return joined, sizes
    pieces: list[np.ndarray] = []
    together = iter(np.split(joined, np.cumsum(sizes)[:-1])) if len(spans) else iter(())
    for i, text in enumerate(texts):
        pieces.append(vocabulary.encode(text) if i in apart else next(together))
    return np.concatenate(pieces), np.array([len(piece) for piece in pieces])


class WordTable:
    """Numbers words as they come, with their ids and two values of a broadcast table side by side."""

    def __init__(self, vocabulary: Vocabulary, values: dict[bytes, tuple[float, float]]):
        self.vocabulary, self.values = vocabulary, values
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.starts, self.sizes = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.logs = np.zeros((1 << 15, 2))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        index = self.index
        out = np.fromiter(map(index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(out < 0).tolist()
        if new:
            missing = sorted({words[i] for i in new})
            if len(index) + len(missing) > MEMO_WORDS and index:
                self.reset()
                return self.numbers(words)
            self.add(missing)
            out[new] = [index[words[i]] for i in new]
        return out

    def add(self, words: list[bytes]) -> None:
        ids, sizes = encode_words(self.vocabulary, words)
        first, n = len(self.index), len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + n > len(self.starts):
            self.starts, self.sizes, self.logs = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.logs))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + n] = sizes
        nothing = (np.nan, -np.inf)
        self.logs[first : first + n] = [self.values.get(word, nothing) for word in words]
        self.used += len(ids)
        self.index.update(zip(words, range(first, first + n)))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start .. start + size - 1 of each, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


@dataclass
class Spelled:
    """Word numbers of texts (-1 for the end of each), which are ends, how many ids each word has, all ids, ids of each text."""

    numbers: np.ndarray
    last: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    text_sizes: np.ndarray


def spell(table: WordTable, texts: list[list[bytes]]) -> Spelled:
    counts = np.array([len(words) for words in texts])
    numbers = table.numbers([word for words in texts for word in words])
    ends = np.cumsum(counts)
    # The end of a text is one more word, numbered -1.
    numbers = np.insert(numbers, ends, -1)
    last = numbers < 0
    sizes = np.where(last, 1, table.sizes[numbers])
    ids = table.ids[ranges(table.starts[numbers], sizes)].astype(np.int64)
    ids[(np.cumsum(sizes) - sizes)[last]] = END_ID
    return Spelled(numbers, last, sizes, ids, np.add.reduceat(sizes, ends - counts + np.arange(len(texts))))


def text_parts(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """First row and words of parts of a batch; only the words of one part are held as objects."""
    part, held, first = [], 0, 0
    for i in range(len(texts)):
        part.append(words_of(texts[i].as_py()))
        held += len(part[-1]) + 1
        if held >= WORDS_AT_ONCE or i == len(texts) - 1:
            yield first, part
            part, held, first = [], 0, i + 1


# ---------------------------------------------------------------- network


@dataclass
class AttentionModel:
    """Weights, and the tables that place an id: input row, output class, log share in its class.

    ``begins`` is the share of a class that begins a word or ends the text.
    """

    weights: dict[str, np.ndarray]
    input_of: np.ndarray
    class_of: np.ndarray
    log_share: np.ndarray
    begins: np.ndarray

    def __post_init__(self):
        self.tables = tables(self.weights)

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of every id of every array, one after the other, and of a beginning
        at its place; each is scored once.

        Before its first id a text has CONTEXT start symbols, so each window scores its last
        WINDOW - CONTEXT places and attends to all places before them in the window.
        """
        step = WINDOW - CONTEXT
        sizes = np.array([len(ids) for ids in texts])
        counts = -(-sizes // step)
        spans = counts * step + CONTEXT
        offsets = np.concatenate([[0], np.cumsum(spans)])
        rows = np.full(offsets[-1] + 1, INPUTS - 1, dtype=np.int32)
        flat = np.concatenate(texts)
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        places = inside + np.repeat(offsets[:-1], sizes) + CONTEXT
        # The last id of a text is nobody's context: its place + 1 belongs to the next text.
        inner = np.ones(len(flat), dtype=bool)
        inner[np.cumsum(sizes) - 1] = False
        rows[places[inner] + 1] = self.input_of[flat[inner]]
        goals = np.zeros(offsets[-1], dtype=np.int64)
        goals[places] = self.class_of[flat]
        number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(offsets[:-1], counts) + number * step
        scored, begun = np.zeros(offsets[-1], dtype=np.float64), np.zeros(offsets[-1], dtype=np.float64)
        space = Space(min(len(starts), WINDOWS_AT_ONCE) * step)
        for i in range(0, len(starts), WINDOWS_AT_ONCE):
            window = starts[i : i + WINDOWS_AT_ONCE, None] + np.arange(WINDOW)
            last = window[:, CONTEXT:].ravel()
            inputs = rows[window]
            attended = attend(self.tables, inputs, CONTEXT)[0]
            logits, other = space.p[: len(last)], space.other[: len(last)]
            np.take(self.tables["direct"], inputs[:, CONTEXT:].ravel(), axis=0, mode="clip", out=logits)
            logits += np.matmul(attended.reshape(-1, SIZE), self.weights["mixed"], out=other)
            scored[last], begun[last] = picked(logits, goals[last], self.begins)
        return scored[places] + self.log_share[flat], begun[places]


def tables(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What each input row contributes, computed once for all."""
    out = {
        "query": w["embed"] @ w["query"] * np.float32(SIZE**-0.5),
        "key": w["embed"] @ w["key"],
        "value": w["embed"] @ w["value"],
        "direct": w["direct"] + w["bias"],
        "distance": w["distance"],
    }
    return out


def gather(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return table.take(rows, axis=0, mode="clip")


def picked(logits: np.ndarray, goals: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log softmax of each row at its goal, and the log of the mass that begins; overwrites ``logits``."""
    chosen = logits[np.arange(len(goals)), goals]
    if not_safe(logits, chosen):
        logits -= logits.max(axis=-1, keepdims=True)
        chosen = logits[np.arange(len(goals)), goals]
    total, begun = (np.exp(logits, out=logits) @ np.column_stack([np.ones(len(begins)), begins]).astype(logits.dtype)).T
    return chosen - np.log(total), np.log(np.maximum(begun / total, 1e-30))


def not_safe(exponents: np.ndarray, one_of_each_sum: np.ndarray) -> bool:
    """Whether the largest exponent of each sum has to be taken off; not where all are small and every sum is far from 0."""
    return exponents.size > 0 and bool(exponents.max() > SAFE or one_of_each_sum.min() < -SAFE)


def attend(t: dict[str, np.ndarray], rows: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention output, unscaled weights and their sums of the places from ``first`` on; a place sees itself and those before."""
    return attend_to(t["distance"], gather(t["query"], rows[:, first:]), gather(t["key"], rows), gather(t["value"], rows), first)


@cache
def distances(first: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each place lies before each place from ``first`` on, and whether it is seen from there."""
    distance = np.arange(first, length)[:, None] - np.arange(length)[None]
    return distance, distance >= 0


def attend_to(
    by_distance: np.ndarray, query: np.ndarray, key: np.ndarray, value: np.ndarray, first: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``attend`` on the queries of the places from ``first`` on and the keys and values of all."""
    length = key.shape[1]
    distance, seen = distances(first, length)
    offset = np.where(seen, by_distance.take(distance, mode="clip"), np.float32(-1e9))
    scores = query @ key.transpose(0, 2, 1)
    scores += offset
    # A place sees itself.
    if not_safe(scores, np.diagonal(scores, first, 1, 2)):
        scores -= scores.max(axis=-1, keepdims=True)
    np.exp(scores, out=scores)
    total = (scores @ np.ones(length, np.float32))[..., None]
    return scores @ value / total, scores, total


def start_weights(direct: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (0.3 * rng.standard_normal(shape)).astype(np.float32)
    return {
        "embed": draw(INPUTS, SIZE),
        "query": draw(SIZE, SIZE),
        "key": draw(SIZE, SIZE),
        "value": draw(SIZE, SIZE),
        "distance": np.linspace(0, -2, WINDOW + 1).astype(np.float32),
        "direct": direct,
        "mixed": draw(SIZE, CLASSES) * np.float32(0.1),
        "bias": np.zeros(CLASSES, dtype=np.float32),
    }


class Space:
    """Arrays that every step of a worker uses again, for up to ``places`` places."""

    def __init__(self, places: int):
        self.p, self.other = (np.empty((places, CLASSES), np.float32) for _ in range(2))
        # The last column is 1 throughout: it meets the bias, which follows ``mixed``.
        self.attended = np.ones((places, SIZE + 1), np.float32)


def sums_by_row(values: np.ndarray, order: np.ndarray, firsts: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` over groups that begin at ``firsts`` of ``order``; ``ordered`` is scratch.

    One addition takes the j-th row of all groups that have one; what is long is added up group by group.
    """
    np.take(values, order, axis=0, mode="clip", out=ordered)
    sizes = np.append(firsts[1:], len(order)) - firsts
    by_size = np.argsort(-sizes)
    starts, sizes = firsts[by_size], sizes[by_size]
    longer = (sizes > np.arange(LAYERS + 1)[:, None]).sum(axis=1).tolist()
    out = ordered[starts]
    for j in range(1, LAYERS):
        out[: longer[j]] += ordered[starts[: longer[j]] + j]
    for i in range(longer[LAYERS]):
        out[i] += ordered[starts[i] + LAYERS : starts[i] + sizes[i]].sum(axis=0)
    back = np.empty_like(out)
    back[by_size] = out
    return back


def row_gradients(
    w: dict[str, np.ndarray], rows: np.ndarray, goals: np.ndarray, real: np.ndarray, space: Space
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean log loss over the real places of a batch of windows; ``embed`` and
    ``direct`` have those of the input rows that occur, which are named beside them."""
    places, length = rows.size, rows.shape[1]
    flat = lambda a: a.reshape(-1, a.shape[-1])
    at, shape = rows.ravel(), (*rows.shape, SIZE)
    x, inner = gather(w["embed"], at), np.concatenate([w["query"], w["key"], w["value"]], axis=1)
    inner[:, :SIZE] *= np.float32(SIZE**-0.5)
    projected = x @ inner
    query, key, value = (projected[:, part].reshape(shape) for part in PARTS)
    attended, alpha, total = attend_to(w["distance"], query, key, value, 0)
    alpha /= total
    outputs = space.attended[:places]
    outputs[:, :SIZE] = flat(attended)
    # From logits to the gradient at the logits, in place
    p, other = space.p[:places], space.other[:places]
    np.take(w["direct"], at, axis=0, mode="clip", out=p)
    p += np.matmul(outputs, np.vstack([w["mixed"], w["bias"]]), out=other)
    goal = (np.arange(places), goals.ravel())
    if not_safe(p, p[goal]):
        p -= p.max(axis=-1, keepdims=True)
    np.exp(p, out=p)
    share = real.ravel() / np.float32(max(real.sum(), 1))
    p *= (share / (p @ np.ones(CLASSES, np.float32)))[:, None]
    p[goal] -= share
    mixed = (p.T @ outputs).T
    grads = {"mixed": mixed[:SIZE], "bias": mixed[SIZE]}
    d_attended = (p @ w["mixed"].T).reshape(attended.shape)
    d_scores = d_attended @ value.transpose(0, 2, 1)
    d_scores -= np.einsum("bij,bij->bi", d_scores, alpha)[..., None]
    d_scores *= alpha
    d_all = np.empty((places, 3 * SIZE), np.float32)
    d_query, d_key, d_value = (d_all[:, part].reshape(shape) for part in PARTS)
    np.matmul(d_scores, key, out=d_query)
    np.matmul(d_scores.transpose(0, 2, 1), query, out=d_key)
    np.matmul(alpha.transpose(0, 2, 1), d_attended, out=d_value)
    back, seen = distances(0, length)
    grads["distance"] = np.bincount(back[seen], weights=d_scores.sum(axis=0)[seen], minlength=WINDOW + 1).astype(np.float32)
    d_x, d_inner = d_all @ inner.T, x.T @ d_all
    # ``inner`` holds the queries over the root of SIZE, the keys have seen them so.
    d_inner[:, :SIZE] *= np.float32(SIZE**-0.5)
    for name, part in zip(("query", "key", "value"), PARTS):
        grads[name] = d_inner[:, part]
    order = np.argsort(at.astype(np.int16), kind="stable")
    ordered = at[order]
    firsts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    grads["embed"] = np.add.reduceat(d_x[order], firsts, axis=0)
    grads["direct"] = sums_by_row(p, order, firsts, other)
    return grads, ordered[firsts]


def gradients(w: dict[str, np.ndarray], rows: np.ndarray, goals: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
    """``row_gradients`` in the shapes of ``w``: input rows that do not occur have 0."""
    grads, occurring = row_gradients(w, rows, goals, real, Space(rows.size))
    for k in BY_ROW:
        some, grads[k] = grads[k], np.zeros_like(w[k])
        grads[k][occurring] = some
    return grads


def bounded(w: dict[str, np.ndarray]) -> None:
    """Shorten rows of weights to NORM, so that no product of them leaves the range of a float."""
    for k in ("embed", "query", "key", "value", "mixed"):
        # No row is longer than its largest entry times the root of its size.
        if max(w[k].max(), -w[k].min()) * w[k].shape[1] ** 0.5 > 0.99 * NORM:
            length = np.sqrt(np.einsum("ij,ij->i", w[k], w[k]))[:, None]
            if length.max() > NORM:
                w[k] *= np.minimum(1, NORM / np.maximum(length, 1e-6))
    for k in ("direct", "bias", "distance"):
        if max(w[k].max(), -w[k].min()) > 4 * NORM:
            np.clip(w[k], -4 * NORM, 4 * NORM, out=w[k])


def views(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parts of one vector in the shapes of ``like``, one after the other."""
    out, at = {}, 0
    for k, x in like.items():
        out[k] = vector[at : at + x.size].reshape(x.shape)
        at += x.size
    return out


class Adam:
    """The optimizer Adam over weights that lie in one vector, a step in proportion to the rows that occur.

    The mean of the gradients is held over 0.9 ** k, that of their squares over 0.99 ** k, k steps
    after they were last scaled back. So a gradient of 0 changes neither, and input rows
    that do not occur in a batch are read only where the weights move.
    """

    def __init__(self, w: dict[str, np.ndarray]):
        # What is not held by input row comes first and is one part.
        w = dict(sorted(w.items(), key=lambda item: item[0] in BY_ROW))
        self.vector = np.concatenate([x.ravel() for x in w.values()])
        self.weights = views(self.vector, w)
        self.mean, self.square, self.root, self.spare = (np.zeros_like(self.vector) for _ in range(4))
        self.small = [k for k in w if k not in BY_ROW]
        parts = {"small": np.zeros(sum(w[k].size for k in self.small)), **{k: w[k] for k in BY_ROW}}
        self.parts = [views(x, parts) for x in (self.mean, self.square, self.root)]
        self.t = self.k = 0

    def step(self, grads: dict[str, np.ndarray], occurring: np.ndarray, rate: float) -> None:
        """Clip the gradients together to CLIP and move all weights."""
        if self.k == RESCALE:
            for held, factor in ((self.mean, 0.9**self.k), (self.square, 0.99**self.k), (self.root, 0.99 ** (self.k / 2))):
                held *= np.float32(factor)
            self.k = 0
        self.t, self.k = self.t + 1, self.k + 1
        small = np.concatenate([grads[k].ravel() for k in self.small])
        found = {"small": (slice(None), small), **{k: (occurring, grads[k]) for k in BY_ROW}}
        length = np.sqrt(sum(float(np.vdot(g, g)) for _, g in found.values()))
        shorter = min(1.0, CLIP / max(length, 1e-12))
        for name, (at, g) in found.items():
            mean, square, root = (held[name] for held in self.parts)
            mean[at] += np.float32(0.1 * shorter / 0.9**self.k) * g
            g *= np.float32(0.1 * shorter / 0.99 ** (self.k / 2))
            g *= g
            g += square[at]
            square[at] = g
            root[at] = np.sqrt(g, out=g)
        scale = np.sqrt(0.99**self.k / (1 - 0.99**self.t))
        rate *= 0.9**self.k / (1 - 0.9**self.t) / scale
        for i in range(0, len(self.vector), PIECE):
            moved = np.add(self.root[i : i + PIECE], np.float32(1e-8 / scale), out=self.spare[i : i + PIECE])
            np.divide(self.mean[i : i + PIECE], moved, out=moved)
            moved *= np.float32(rate)
            self.vector[i : i + PIECE] -= moved


def train_worker(w: dict[str, np.ndarray], rows: np.ndarray, goals: np.ndarray, real: np.ndarray, rate: float, before: int = 0) -> dict[str, np.ndarray]:
    """One pass of Adam over a worker's windows, in a fixed order.

    Gradients are clipped and weights bounded after each step; the rate falls with the steps
    that the worker has made, ``before`` of them earlier.
    """
    adam, space = Adam(w), Space(BATCH * rows.shape[1])
    for t, i in enumerate(range(0, len(rows), BATCH), 1):
        grads, occurring = row_gradients(adam.weights, rows[i : i + BATCH], goals[i : i + BATCH], real[i : i + BATCH], space)
        adam.step(grads, occurring, rate / np.sqrt(1 + (before + t) / SLOW_STEPS))
        bounded(adam.weights)
    return adam.weights


# ---------------------------------------------------------------- learning


def place_ids(counts: np.ndarray, token_bytes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input row, class and log share of every id, and the log share of every class."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    input_of = np.full(len(counts), INPUTS - 2, dtype=np.int32)
    input_of[order[: INPUTS - 2]] = np.arange(INPUTS - 2)
    class_of = np.empty(len(counts), dtype=np.int16)
    for i, token in enumerate(token_bytes):
        mark = token[:1] != b" "
        first = (token.lstrip(b" ") or b" ")[0]
        class_of[i] = OWN_CLASSES + (first * 2 + mark) % (CLASSES - OWN_CLASSES)
    class_of[order[:OWN_CLASSES]] = np.arange(OWN_CLASSES)
    smoothed = counts + 0.5
    in_class = np.bincount(class_of, weights=smoothed, minlength=CLASSES)
    log_share = np.log(smoothed) - np.log(in_class[class_of])
    return input_of, class_of, log_share, np.log((in_class + 0.5) / (in_class + 0.5).sum())


def beginnings(log_share: np.ndarray, class_of: np.ndarray, token_bytes: list[bytes]) -> np.ndarray:
    """Share of each class in ids that begin a word (with a space) or end the text."""
    begins = np.array([token[:1] == b" " for token in token_bytes])
    begins[END_ID] = True
    return np.bincount(class_of, weights=np.exp(log_share) * begins, minlength=CLASSES)


def of_round(docs: DataFrame, i: int) -> DataFrame:
    """The documents of round ``i``; every row is in one round."""
    return docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == i)


def draw_windows(docs: DataFrame, json_file: str, rank_file: str) -> DataFrame:
    """``at``, ``ids``: windows that cover the documents, at hashed places in the order of training.

    ``ids`` holds the id before the window and its WINDOW ids as two bytes each; START_ID stands
    for the CONTEXT start symbols of a text, which has its first id after them, and fills up its last window.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(load(json_file, rank_file), {})
        for batch in batches:
            for first, part in text_parts(batch.column(1)):
                keys = batch.column(0).slice(first, len(part)).to_pylist()
                windows, counts = cover(spell(table, part))
                # Copies have windows alike; with the id in the seed they do not meet in one worker.
                seeds = [[zlib.crc32(b" ".join(words)), (key or 0) % (1 << 63)] for words, key in zip(part, keys)]
                at = np.concatenate([np.random.default_rng(seed).integers(1 << 62, size=n) for seed, n in zip(seeds, counts)])
                data = pa.py_buffer(windows.astype("<u2").tobytes())
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * (WINDOW + 1)), len(windows), [None, data])
                yield pa.RecordBatch.from_arrays([pa.array(at), fixed.cast(pa.binary())], ["at", "ids"])

    return docs.select("doc_id", "text").mapInArrow(work, "at long, ids binary")


def cover(spelled: Spelled) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts, one after the other, and how many each text has."""
    sizes = spelled.text_sizes
    counts = -(-(sizes + CONTEXT) // WINDOW)
    offsets = np.cumsum(counts) - counts
    goals = np.full((counts.sum(), WINDOW), START_ID, dtype=np.int64)
    goals.ravel()[ranges(offsets * WINDOW + CONTEXT, sizes)] = spelled.ids
    before = np.concatenate([[START_ID], goals[:-1, -1]])
    before[offsets] = START_ID
    return np.column_stack([before, goals]), counts


def placed(ids: np.ndarray, input_of: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input rows, goals and real places of windows."""
    start = ids == START_ID
    known = np.where(start, 0, ids)
    rows = np.where(start, INPUTS - 1, input_of[known])[:, :-1].astype(np.int32)
    return rows, class_of[known][:, 1:].astype(np.int64), (~start[:, 1:]).astype(np.float32)


def average_round(
    windows: DataFrame, w: dict[str, np.ndarray], rate: float, input_of: np.ndarray, class_of: np.ndarray
) -> dict[str, np.ndarray]:
    """Each worker trains from ``w`` on its windows; the weights are averaged by windows seen."""
    names = list(w)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seen = w, 0
        for batch in batches:
            if batch.num_rows:
                ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2").reshape(-1, WINDOW + 1)
                state = train_worker(state, *placed(ids, input_of, class_of), rate, seen // BATCH)
                seen += batch.num_rows
        if seen:
            blob = np.concatenate([state[k].ravel() for k in names]).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([blob], pa.binary())], ["seen", "blob"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0.0, 0
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                total, seen = total + n * np.frombuffer(blob.as_buffer(), "<f4").astype(np.float64), seen + n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([(total / seen).astype("<f4").tobytes()], pa.binary())], ["seen", "blob"])

    # One set of weights per worker meets in one task; one returns to the driver.
    trained = windows.select("ids").mapInArrow(work, "seen long, blob binary")
    results = trained.repartition(1).mapInArrow(average, "seen long, blob binary")
    results = results.collect()
    if not results:
        return w
    mean = np.frombuffer(results[0].blob, "<f4")
    out, at = {}, 0
    for k in names:
        out[k] = mean[at : at + w[k].size].reshape(w[k].shape).astype(np.float32)
        at += w[k].size
    return out


@dataclass
class Learned:
    model: AttentionModel
    words: DataFrame
    train_tokens: int
    distinct_tokens: int


def learn(train: DataFrame, json_file: str = JSON_FILE, rank_file: str = RANK_FILE) -> Learned:
    """Counts and network of the training documents (``doc_id``, ``text`` without nulls)."""
    words = stage_table(count_words(train), "word-counts")
    ends = train.count()
    total = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    counts = count_ids(words, json_file, rank_file)
    counts[END_ID] += ends
    input_of, class_of, log_share, class_share = place_ids(counts, load(json_file, rank_file).token_bytes)
    follows = count_transitions(words, input_of, class_of, json_file, rank_file)
    weights = start_weights(starting_table(follows, class_share, ends, int(class_of[END_ID])))
    begins = beginnings(log_share, class_of, load(json_file, rank_file).token_bytes)
    workers = max(WORKERS, int(-(-counts.sum() // (ROUNDS * WINDOW * WORKER_WINDOWS))))
    for i in range(ROUNDS):
        windows = draw_windows(of_round(train, i), json_file, rank_file)
        dealt = windows.repartition(workers, "at").sortWithinPartitions("at")
        weights = average_round(dealt, weights, RATE * (1 - i / ROUNDS), input_of, class_of)
    return Learned(AttentionModel(weights, input_of, class_of, log_share, begins), words, (total.n or 0) + ends, total.v + (ends > 0))


# ---------------------------------------------------------------- scoring


def score_documents(docs: DataFrame, learned: Learned, json_file: str = JSON_FILE, rank_file: str = RANK_FILE) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    ``base_score`` adds up log10((c + 1) / (N + V + 1)) over words and end. The counts of at
    most HEAVY_WORDS frequent short words are broadcast and looked up while the text is read;
    only the other words are shuffled to their counts. A null text is empty and has the end
    alone; repeated rows are scored each; nothing learned (no training rows) gives uniform
    counts and an untrained network.
    """
    n, v = learned.train_tokens, learned.distinct_tokens
    ends = learned_ends(learned)
    frequent = learned.words.where((F.octet_length("word") <= HEAVY_CHARS) & (F.col("c") * HEAVY_WORDS > n)).collect()
    total = float(n + v + 1)
    heavy = {bytes(r.word): (float(np.log10((r.c + 1) / total)), float(np.log(r.c / n))) for r in frequent}
    end_logs = (float(np.log10((ends + 1) / total)), float(np.log(ends / n)) if ends else -np.inf)
    model = learned.model

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(json_file, rank_file)
        table = WordTable(vocabulary, heavy)
        for batch in batches:
            for first, part in text_parts(batch.column(1)):
                columns = score_part(model, table, part, end_logs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), *columns], names)

    schema = "doc_id long, n_tokens long, known long, base double, score double, rare array<binary>, spelled array<float>"
    names = [part.split()[0] for part in schema.split(", ")]
    scored = document_columns(docs).mapInArrow(work, schema).withColumn("row", F.monotonically_increasing_id())
    scored = stage_table(scored, "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "spelled")).alias("w"))
    rare = rare.select("row", F.col("w.rare").alias("word"), F.col("w.spelled").alias("spelled"))
    found = rare.join(learned.words, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    share, spelled = F.col("c") / F.lit(float(max(n, 1))), F.col("spelled") + F.lit(float(np.log10(1 - WORD_SHARE)))
    # log10 of a sum whose second part may be too small for a double
    mixed = F.when(F.col("c") == 0, spelled).otherwise(F.log10(WORD_SHARE * share + F.pow(F.lit(10.0), spelled)))
    sums = found.groupBy("row").agg(
        F.sum(F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("rest"),
        F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("more"),
        F.sum(mixed).alias("rest_score"),
    )
    return scored.drop("rare", "spelled").join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"),
    )


def score_part(model: AttentionModel, table: WordTable, texts: list[list[bytes]], end_logs: tuple[float, float]) -> list[pa.Array]:
    """Of each text: tokens, known frequent words, their base and mixed sums, and the other words
    with the log10 probability that the network gives their ids."""
    counts = np.array([len(words) for words in texts])
    flat = [word for words in texts for word in words]
    ends = np.cumsum(counts)
    spelled = spell(table, texts)
    numbers, last = spelled.numbers, spelled.last
    firsts = np.cumsum(spelled.sizes) - spelled.sizes
    by_id, begun = model.score(np.split(spelled.ids, np.cumsum(spelled.text_sizes)[:-1]))
    by_word = word_logs(by_id, begun, firsts, last) / LOG10
    logs = table.logs[numbers]
    logs[last] = end_logs
    rare = np.isnan(logs[:, 0])
    mixed = np.logaddexp((by_word + np.log10(1 - WORD_SHARE)) * LOG10, logs[:, 1] + np.log(WORD_SHARE)) / LOG10
    starts = ends - counts + np.arange(len(texts))
    known = np.add.reduceat(np.where(rare | (last & (end_logs[1] == -np.inf)), 0, 1), starts)
    base = np.add.reduceat(np.where(rare, 0.0, logs[:, 0]), starts)
    score = np.add.reduceat(np.where(rare, 0.0, mixed), starts)
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(rare.astype(np.int64), starts))]).astype(np.int32))
    words = pa.array([flat[i] for i in np.flatnonzero(rare[~last])], pa.binary())
    return [
        pa.array(counts + 1),
        pa.array(known.astype(np.int64)),
        pa.array(base),
        pa.array(score),
        pa.ListArray.from_arrays(offsets, words),
        pa.ListArray.from_arrays(offsets, pa.array(by_word[rare].astype(np.float32))),
    ]


def word_logs(by_id: np.ndarray, begun: np.ndarray, firsts: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Log probability of each word and end: its ids, given a beginning, and a beginning behind a word."""
    behind = np.append(begun[firsts[1:]], 0.0)
    return np.add.reduceat(by_id, firsts) - begun[firsts] + np.where(last, 0.0, behind)


def learned_ends(learned: Learned) -> int:
    """Ends in training: all tokens but the words."""
    return learned.train_tokens - (learned.words.agg(F.sum("c").alias("n")).first().n or 0)


def train_and_score(docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """Learn from the rows that ``keep`` allows (crc32(doc_id) mod 7 other than 2) and score all."""
    keep = fold(F.col("doc_id"), 7) != 2 if keep is None else keep
    return score_documents(docs, learn(document_columns(docs).where(keep)))
