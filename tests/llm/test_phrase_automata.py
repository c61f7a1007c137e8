"""Removal of repeated passages against direct comparison of all windows."""

import hashlib
import random

import pytest

from orderpath.llm import phrase_automata as A
from orderpath.llm.queries import op12

SCHEMA = "doc_id long, text string, source string, pack long, n_words string"
rng = random.Random(3)
WORDS = ["".join(rng.choices("abcdeéß,.", k=rng.randint(1, 6))) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def direct(rows, window=A.WINDOW):
    """(doc_id, n_words, n_removed, kept) by definition; a null id is smaller than all others."""
    split = [(-1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        out.append((None if i == -1 else i, len(words), len(gone), kept))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "clash") for i, t in rows], SCHEMA).repartition(3)


def result(df):
    rows = df.collect()
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows], key=str)


PASSAGE = prose(60, 1)
ROWS = [
    (5, None),
    (6, ""),
    (7, " \t\n\x0b\x0c\r "),
    (8, prose(12, 9)),
    (9, prose(12, 9)),
    (10, prose(13, 8)),
    (11, prose(13, 8).replace(" ", "\n\t ")),
    (12, prose(20, 2) + " " + PASSAGE + " " + prose(20, 3)),
    (13, PASSAGE),
    (14, "x " + PASSAGE[: len(PASSAGE) // 2] + " y " + prose(30, 4)),
    (3, prose(5, 5) + " " + PASSAGE),
    (15, "a " * 500),
    (16, "a " * 40 + "b"),
    (17, "a b " * 20),
    (18, "A " * 40),
    (19, prose(13, 6) + " " + prose(13, 6)),
    (20, "y" * 30000 + " " + PASSAGE),
    (21, prose(9000, 7)),
    (22, prose(9000, 7)[9:]),
    (13, PASSAGE),
    (13, PASSAGE + " other"),
    (None, prose(40, 11)),
    (None, prose(40, 11)),
    (2, prose(40, 11)),
]


def test_awkward_rows(spark):
    assert result(A.remove_repeats(table(spark, ROWS))) == direct(ROWS)


@pytest.mark.parametrize("frequent", [0, 1, 3])
def test_windows_of_frequent_pieces_travel_alone(spark, frequent):
    line = prose(9, 12)
    rows = ROWS + [(100 + i, f"{prose(8, 200 + i % 9)} {line} {prose(8, 300 + i % 5)}") for i in range(60)]
    assert result(A.remove_repeats(table(spark, rows), frequent=frequent)) == direct(rows)


@pytest.mark.parametrize("window", [5, 6, 20])
def test_other_windows(spark, window):
    assert result(A.remove_repeats(table(spark, ROWS), window=window)) == direct(ROWS, window)


def test_many_packs(spark, monkeypatch):
    """Small packs: passages cross packs and shards."""
    monkeypatch.setattr(A, "PACK_ROWS", 3)
    pieces = [prose(15, 500 + i) for i in range(30)]
    rows = [(i, " ".join(random.Random(i).choices(pieces, k=5))) for i in range(120)]
    packs = A.pack_documents(table(spark, rows))
    shards = 7
    assert packs.count() >= 3
    segments = A.segment_rows(packs, A.recurring_pieces(packs, shards, 13, 4), shards, 13)
    assert segments.select("shard").distinct().count() > 3
    assert result(A.remove_repeats(table(spark, rows))) == direct(rows)


def test_query(spark, tmp_path):
    table(spark, ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted([tuple(r) for r in op12(spark, str(tmp_path)).collect()], key=str)
    assert rows == sorted([(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in direct(ROWS)], key=str)


def test_empty_table(spark):
    assert result(A.remove_repeats(table(spark, []))) == []


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    text = (prose(2000, 1) + "  \n" + "z" * 500 + " end").encode()
    whole = A.Places(13).word_hashes(text)
    assert len(whole) == len(text.split()) and len(set(whole.tolist())) == len(set(text.split()))
    monkeypatch.setattr(A, "CHUNK", 100)
    assert A.Places(13).word_hashes(text).tolist() == whole.tolist()
