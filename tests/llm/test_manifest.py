"""The Merkle manifest against a direct construction, over several stages and awkward rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from orderpath.llm import merkle
from orderpath.llm.queries import op13

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, _id int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def ascii_lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf(row, lowered=False):
    doc_id, text, lang, source, n_chars = row[:5]
    return digest(*map(framed, (doc_id, source, lang, n_chars, ascii_lower(text) if lowered else text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for nodes in tree[:-1]:
        start = i // 16 * 16
        yield nodes[start:i], nodes[i + 1 : start + 16]
        i //= 16


def direct(rows):
    """Sorted rows of the contract, one per row."""
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for group in sources.values():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in sources[s]]) for s in order]
    top = levels([tree[-1][0] for tree in trees])
    root = top[-1][0] if trees else None
    out = []
    for k, s in enumerate(order):
        for i, row in enumerate(sources[s]):
            steps = [*siblings(trees[k], i), *siblings(top, k)]
            node = leaf(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0)
            for left, right in steps:
                node = digest(*left, node, *right)
            proof = digest(*[x for left, right in steps for x in left + right])
            out.append((row[0], trees[k][0][i], trees[k][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def rows_of(spark, tmp_path, rows):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return sorted(map(tuple, op13(spark, str(tmp_path)).collect()), key=str)


def test_awkward_rows(spark, tmp_path):
    rows = [
        (i, text, "en" if i % 3 else None, source, None if i % 4 == 0 else i, "clash", i)
        for i, (text, source) in enumerate(
            [(None, None), ("", ""), ("-", "a"), ("Aé", "Ä"), ("X" * 300_000, None), ("same", "a"), ("Z", "a b"), ("ÄB", "ä")]
        )
    ]
    rows += [rows[5]] * 3 + [(None, "No Id", "en", "a", 1, "", 0), (None, None, None, None, None, None, None)]
    rows += [(100 + i, "Text", "en", "seventeen", 4, "", 0) for i in range(17)] + [(5, "Other", "en", "a", 1, "", 0)]
    assert rows_of(spark, tmp_path, rows) == direct(rows)


@pytest.mark.parametrize("n", [16, 4097])
def test_hot_source_over_several_stages(spark, tmp_path, n):
    rows = [(7 * i, f"Text {i}", "en", "hot", i, "", 0) for i in range(n)] + [(3 + 7 * i, "B", "de", f"s{i % 20}", 1, "", 0) for i in range(40)]
    assert rows_of(spark, tmp_path, rows) == direct(rows)


def test_more_than_one_stage_of_sources(spark, tmp_path):
    rows = [(i, "T", None, f"source {i}", 1, "", 0) for i in range(4100)]
    assert rows_of(spark, tmp_path, rows) == direct(rows)


def test_empty_table(spark, tmp_path):
    assert rows_of(spark, tmp_path, []) == []


def test_folding_resumes_the_state_of_the_slot():
    digests = [digest(str(i)) for i in range(300)]
    runs = merkle.Runs(digests, merkle.height(300))
    assert runs.top.decode() == levels(digests)[-1][0]
    for i in (0, 15, 16, 255, 256, 299):
        changed = digests[:i] + [digest("new")] + digests[i + 1 :]
        assert runs.fold(i, digest("new").encode()).decode() == levels(changed)[-1][0]
    assert merkle.height(1) == 0 and merkle.height(16) == 1 and merkle.height(17) == 2


def test_any_columns_may_change(spark):
    docs = spark.createDataFrame([(i, "t", "en", "s", i) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = merkle.manifest(docs, F.col("doc_id") == 3, {"lang": F.lit("de"), "n_chars": F.lit(None)}).collect()
    assert [r["doc_id"] for r in rows if not r["verified"]] == [3]
