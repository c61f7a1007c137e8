"""Toxicity by a learned lexicon trie, Levenshtein automata and context windows.

Learning: in a bounded sample of labelled documents every word prefix is counted by label.
Prefixes that toxic documents hold much more often than clean ones become entries, whole words
or stems, weighted by the log of the ratio. Clean words of the sample within the edit distance of
an entry are known words, not misspellings of it.

Scoring: a word is matched by walking the trie of the entries together with the states of
the Levenshtein automaton of the word, so all entries within the distance are found in one
walk. The words around a hit tell abuse from quotation or mention: inside quotation marks, or
near a word that reports speech, a hit weighs less. A logistic curve over the number, the weight
and the density of hits, fitted on the sample, gives the probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpath.llm.common import document_columns, fold, labelled_sample, small_batches, texts_of

WORD = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"“”„«»]")
# English words that report speech or name a word.
REPORTING = frozenset("said says wrote called calling quote quoted quotes word words term insult slur tweeted yelled".split())
SAMPLE_ROWS = {1: 6000, 0: 12000}
STEM_CHARS = range(3, 13)
LEAST_SHARE, LEAST_ROWS, LEAST_RATIO = 0.02, 4, 5.0
MOST_WEIGHT = 40.0
DISTANCE, FUZZY_CHARS, FUZZY_WEIGHT = 1, 5, 0.85
QUOTED_WEIGHT, REPORTED_WEIGHT = 0.3, 0.5
WINDOW_WORDS = 4
MEMO_WORDS = 100_000
FEATURES = 8


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    entry: str | None = None


@dataclass
class Lexicon:
    """``words``/``stems`` map an entry to its weight; ``known`` words are never misspellings."""

    words: dict[str, float]
    stems: dict[str, float]
    curve: np.ndarray
    known: frozenset[str] = frozenset()

    def __post_init__(self):
        self.root, self.memo = Node(), {}
        for word in self.words:
            if len(word) >= FUZZY_CHARS:
                node = self.root
                for letter in word:
                    node = node.children.setdefault(letter, Node())
                node.entry = word
        self.stem_sizes = sorted({len(stem) for stem in self.stems})
        # One edit leaves one half of an entry as it is, at the start or at the end of the word.
        fuzzy = [word for word in self.words if len(word) >= FUZZY_CHARS]
        self.starts = tuple({word[: len(word) // 2] for word in fuzzy})
        self.ends = tuple({word[len(word) // 2 :] for word in fuzzy})
        self.least, self.most = min(map(len, fuzzy), default=0) - 1, max(map(len, fuzzy), default=-2) + 1

    def near(self, word: str) -> tuple[int, str] | None:
        """The closest entry within one edit and its distance, ties by name; None if there is none.

        Each trie step advances the automaton's state, the row of edit distances to all
        prefixes of ``word``; a branch ends when no distance in it is small enough.
        """
        best: tuple[int, str] | None = None
        stack = [(self.root, tuple(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            if node.entry is not None and row[-1] <= DISTANCE:
                best = min(best or (row[-1], node.entry), (row[-1], node.entry))
            for letter, child in node.children.items():
                state = [row[0] + 1]
                for i, other in enumerate(word):
                    state.append(min(state[i] + 1, row[i + 1] + 1, row[i] + (letter != other)))
                if min(state) <= DISTANCE:
                    stack.append((child, tuple(state)))
        return best

    def weigh(self, word: str) -> float:
        """Weight of a lower-case word, 0 if it hits nothing."""
        if word in self.words:
            return self.words[word]
        for size in self.stem_sizes:
            if size <= len(word) and word[:size] in self.stems:
                return self.stems[word[:size]]
        if self.may_be_near(word) and word not in self.known:
            found = self.near(word)
            if found and found[0]:
                return FUZZY_WEIGHT * self.words[found[1]]
        return 0.0

    def may_be_near(self, word: str) -> bool:
        """A cheap test that no word within one edit of an entry fails."""
        return self.least <= len(word) <= self.most and (word.startswith(self.starts) or word.endswith(self.ends))

    def features(self, text: str) -> list[float]:
        """Constant, hits (first, second, third, more), their total and largest weight, weight per 100 words."""
        lower = text.lower()
        words, memo = WORD.findall(lower), self.memo
        hits = set()
        for word in set(words):
            weight = memo.get(word)
            if weight is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                weight = memo[word] = self.weigh(word)
            if weight:
                hits.add(word)
        count = total = top = 0.0
        for word, start, around in occurrences(lower, hits) if hits else ():
            context = 1.0
            if inside_quotes(lower, start):
                context = QUOTED_WEIGHT
            elif REPORTING.intersection(around):
                context = REPORTED_WEIGHT
            weight = context * self.weigh(word)
            count, total, top = count + context, total + weight, max(top, weight)
        steps = [min(max(count - k, 0.0), 1.0) for k in range(3)]
        total = min(total, MOST_WEIGHT)
        return [1.0, *steps, math.log1p(count), total / 10, top / 10, min(100 * total / (len(words) + 20), 100.0) / 10]

    def score(self, text: str) -> float:
        z = float(np.dot(self.curve, self.features(text)))
        return 1.0 / (1.0 + math.exp(-min(max(z, -30.0), 30.0)))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the constant is not shrunk."""
    beta = np.zeros(x.shape[1])
    shrink = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - shrink @ beta
        beta = beta + np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + shrink, slope)
    return beta


def occurrences(text: str, wanted: set[str]) -> Iterator[tuple[str, int, list[str]]]:
    """Wanted words with their place and the words of the window before and after."""
    found = [(m.group(), m.start()) for m in WORD.finditer(text)]
    for i, (word, start) in enumerate(found):
        if word in wanted:
            yield word, start, [w for w, _ in found[max(0, i - WINDOW_WORDS) : i + WINDOW_WORDS + 1]]


def inside_quotes(text: str, at: int) -> bool:
    """Whether an odd number of quotation marks stands before ``at`` in its line and one after it."""
    start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
    before = len(QUOTES.findall(text, start, at))
    return before % 2 == 1 and QUOTES.search(text, at, len(text) if end < 0 else end) is not None


def prefixes(words: Iterable[str]) -> set[tuple[str, bool]]:
    """(string, whole word?) of all words and their stems."""
    out = set()
    for word in words:
        out.add((word, True))
        for n in STEM_CHARS:
            if n <= len(word):
                out.add((word[:n], False))
    return out


def count_prefixes(sample: DataFrame) -> DataFrame:
    """``entry``, ``whole``, ``toxic``, ``clean``: documents of the sample that hold it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label].update(prefixes(set(WORD.findall(text.lower()))))
            keys = [k for k in counts[1] | counts[0]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.bool_()),
                    pa.array([counts[1][k] for k in keys], pa.int64()),
                    pa.array([counts[0][k] for k in keys], pa.int64()),
                ],
                ["entry", "whole", "toxic", "clean"],
            )

    counted = sample.select("text", "label").mapInArrow(work, "entry string, whole boolean, toxic long, clean long")
    return counted.groupBy("entry", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_entries(rows: list[tuple[str, bool, int, int]], n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log ratio, from the prefixes that pass the thresholds.

    Those with the largest documents times log ratio come first, and no entry is a prefix of
    another, so a stem stands for its words only where it tells more than each of them.
    """
    ratio = lambda t, c: math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
    scored = sorted((-t * ratio(t, c), not w, e, ratio(t, c)) for e, w, t, c in rows)
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    taken: set[str] = set()
    for _, is_stem, entry, weight in scored:
        if entry in taken or any(entry[:n] in stems for n in range(1, len(entry) + 1)):
            continue
        (stems if is_stem else words)[entry] = weight
        taken.update(entry[:n] for n in range(1, len(entry) + 1))
    return words, stems


def without_copies(sample: DataFrame) -> DataFrame:
    """Of the rows of a label with the same text, up to case and white space, that of the smallest id."""
    plain = F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " "))
    keyed = sample.withColumn("_copy", F.sha2(plain, 256)).cache()
    firsts = keyed.groupBy("_copy", "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return keyed.join(F.broadcast(firsts), "doc_id", "left_semi").drop("_copy")


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample_rows: dict[int, int] | None = None) -> Lexicon:
    """Learn from labelled rows with crc32(doc_id) mod 3 other than 1, at most ``sample_rows`` of each class.

    Copies inflate counts, so of documents with the same text, up to case and white space, one is used.
    """
    keep = fold(F.col("doc_id"), 3) != 1
    sample = labelled_sample(docs, labels, "toxic", keep, sample_rows or SAMPLE_ROWS)
    sample = without_copies(sample).cache()
    try:
        size = dict(sample.groupBy("label").count().collect())
        n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
        least = max(LEAST_ROWS, math.ceil(LEAST_SHARE * n_toxic))
        often = (F.col("toxic") + 0.5) * (n_clean + 1) >= LEAST_RATIO * (F.col("clean") + 0.5) * (n_toxic + 1)
        passed = count_prefixes(sample).where((F.col("toxic") >= least) & often)
        words, stems = choose_entries([(r.entry, r.whole, r.toxic, r.clean) for r in passed.collect()], n_toxic, n_clean)
        lexicon = Lexicon(words, stems, np.zeros(FEATURES))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vocabulary = {w for text in texts_of(batch.column(0)) for w in WORD.findall(text.lower())}
                near = [w for w in vocabulary if lexicon.may_be_near(w) and w not in lexicon.words and lexicon.near(w)]
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["word"])

        clean = sample.where("label = 0").select("text").mapInArrow(work, "word string").distinct()
        lexicon.known = frozenset(r.word for r in clean.collect())

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [lexicon.features(text) for text in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

        points = sample.select("text", "label").mapInArrow(describe, "x array<double>, label int").collect()
        points = sorted((list(r.x), r.label) for r in points)
        counted = labels.where(keep & F.col("toxic").isNotNull()).groupBy(F.col("toxic").cast("int").alias("c")).count()
        shares = {r.c: r["count"] for r in counted.collect()}
        scale = {c: shares.get(c, 0) / max(n, 1) for c, n in ((0, n_clean), (1, n_toxic))}
        y = np.array([label for _, label in points], dtype=float)
        weight = np.array([scale[label] for _, label in points])
        # Without labelled rows every text gets the same low score.
        lexicon.curve = fit_curve(np.array([x for x, _ in points]), y, weight / weight.mean()) if points else np.array([-1.0] + [0.0] * (FEATURES - 1))
    finally:
        sample.unpersist()
    return lexicon


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id``, ``score`` of every row, one pass without a shuffle.

    Null and empty texts get the score of a text without hits; repeated rows and null ids are kept.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [lexicon.score(text) for text in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return document_columns(small_batches(docs)).mapInArrow(work, "doc_id long, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that reach the threshold; all columns as they are.

    Each row is judged in place, so nothing is shuffled and repeated ids do no harm. A null
    text counts as empty, as in :func:`score_documents`.
    """
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            keep = [lexicon.score(text or "") < threshold for text in texts_of(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # Numbered names: Python functions over rows read a dot in a name as a path.
    plain = small_batches(docs).toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(work, plain.schema).toDF(*names)
