"""Operators of the training-data pipeline against brute force, on small and awkward inputs."""

import binascii
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from orderpath.llm import attention_lm, bpe_tree, byte_cnn, feistel, heavy_dedup, id_files, lexicon, setsketch, token_spans, winnowing
from orderpath.llm.common import BATCH_ROWS, TEXT_ROWS, small_batches
from orderpath.llm.vocab import END_ID, END_TOKEN, JSON_FILE, Vocabulary, load

LIBRARY = Tokenizer.from_file(JSON_FILE)
rng = random.Random(11)
WORDS = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(300)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


AWKWARD = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "A b\u00a0c \u2003 d\U0001f600é\r\n\n  x" + END_TOKEN + "y ",
    "x" * 20000,
    " " * 9000 + "!" * 9001 + "é" * 8200,
    prose(6000, 1),
    prose(60, 2),
    prose(60, 2),
    prose(60, 2) + " tail",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text, "s", i) for i, text in enumerate(AWKWARD)] + [(None, "no id", None, 1), (8, AWKWARD[8], "s", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, row int")


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encode_equals_the_library():
    vocabulary = load()
    texts = [t or "" for t in AWKWARD] + ["".join(chr(rng.choice((32, 39, 97, 233, 0x3B1, 0x4E2D, 0x1F600, 10, 0xA0, 49))) for _ in range(60)) for _ in range(300)]
    for text in texts:
        ids = vocabulary.encode(text)
        assert ids.tolist() == ids_of(text)
        assert vocabulary.decode(ids) == text


def test_every_code_point_encodes_as_in_the_library():
    """Each code point stands alone, between letters and behind a space."""
    vocabulary = load()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20_000):
        texts = [f"{c} a{c}b {c}" for c in points[i : i + 20_000]]
        for text, encoding in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False)):
            assert vocabulary.encode(text).tolist() == encoding.ids, text


@pytest.mark.parametrize("leaf", [1, 3, 7, 40])
def test_tree_concatenation(leaf):
    vocabulary = Vocabulary(leaf_chars=leaf)
    for seed in range(150):
        r = random.Random(seed)
        piece = "".join(r.choices(r.choice(["ab", "thonre", "éèa", "the", "!?-.", "0123456789", "中文字a"]), k=r.randint(1, 300)))
        assert vocabulary.encode_long(piece) == ids_of(piece), piece
        assert vocabulary.encode(" " + piece + "  " + piece).tolist() == ids_of(" " + piece + "  " + piece)


def test_texts_reach_python_in_small_batches(spark):
    before = spark.conf.get(BATCH_ROWS)
    try:
        for given, used in (("10000", str(TEXT_ROWS)), ("0", str(TEXT_ROWS)), ("100", "100")):
            spark.conf.set(BATCH_ROWS, given)
            small_batches(spark.range(1))
            assert spark.conf.get(BATCH_ROWS) == used
    finally:
        spark.conf.set(BATCH_ROWS, before)


def test_op2_digests(docs, empty):
    rows = bpe_tree.digests(bpe_tree.encode_documents(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = "no id" if r.doc_id is None else AWKWARD[r.doc_id] or ""
        ids = ids_of(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_tree.encode_documents(empty).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 2, 900], sorted(random.Random(3).choices(range(10**6), k=1000)), list(range(500))])
def test_elias_fano(values):
    sequence = id_files.EliasFano.encode(np.array(values, dtype=np.int64))
    assert sequence.values().tolist() == values
    assert [sequence.select(i) for i in range(len(values))] == values
    again = id_files.EliasFano(len(values), *sequence.parts())
    assert again.values().tolist() == values
    if len(values) == 1000:
        assert len(sequence.high) + len(sequence.low) < 1000 * (2 + math.log2(1000)) / 8 + 16


@pytest.mark.parametrize("block_ids", [1, 50, 1 << 18])
def test_id_files(spark, docs, tmp_path, block_ids):
    path = str(tmp_path / "ids")
    id_files.write_ids(docs, path, block_ids=block_ids)
    rows = sorted(id_files.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] + sorted([*range(len(AWKWARD)), 8])
    at = 0
    for r in rows:
        ids = ids_of("no id" if r.doc_id is None else AWKWARD[r.doc_id]) + [0]
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)


@pytest.mark.parametrize("block_ids", [1, 50, 1 << 18])
def test_id_files_of_some_documents(spark, docs, tmp_path, block_ids):
    path = str(tmp_path / "ids")
    id_files.write_ids(docs, path, block_ids=block_ids)
    wanted = spark.createDataFrame([(0,), (8,), (8,), (3,), (10**9,), (None,)], "doc_id long")
    every = sorted(tuple(r) for r in id_files.read_ids(spark, path).where("doc_id IN (0, 3, 8)").collect())
    assert sorted(tuple(r) for r in id_files.read_some(spark, path, wanted).collect()) == every and len(every) == 4
    assert id_files.read_some(spark, path, wanted.limit(0)).count() == 0


def test_id_files_refuse_ids_that_do_not_fit(spark, docs, tmp_path):
    with pytest.raises(ValueError):
        id_files.write_ids(docs, str(tmp_path / "end"), end_id=300, width=1)
    with pytest.raises(Exception, match="does not fit 1 bytes"):
        id_files.write_ids(docs, str(tmp_path / "ids"), width=1)


def test_id_files_of_nothing(spark, empty, tmp_path):
    id_files.write_ids(empty, str(tmp_path / "ids"))
    assert id_files.read_ids(spark, str(tmp_path / "ids")).count() == 0


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_token_spans(docs, empty, rule):
    rows = token_spans.count_tokens(docs, ("source", "text"), rule=rule).collect()
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.field), []).append(r)
    vocabulary = load()
    for i, text in enumerate(AWKWARD):
        whole = "s" + (text or "")
        ids = vocabulary.encode(whole)
        mine = sorted(got[i, "source"][:1] + got[i, "text"][: len(got[i, "text"]) // (2 if i == 8 else 1)], key=lambda r: (r.section, r.field))
        parts = sorted({(r.section, r.start, r.stop) for k in ("source", "text") for r in got[i, k]})
        assert parts[0][1] == 0 and parts[-1][2] == len(whole.encode()) and all(a[2] == b[1] for a, b in zip(parts, parts[1:]))
        expected, at = Counter(), 0
        for token in ids:
            size = vocabulary.byte_lengths[token]
            held = {s: min(stop, at + size) - max(start, at) for s, start, stop in parts if min(stop, at + size) > max(start, at)}
            first, last = min(held), max(held)
            expected[{"first": first, "last": last, "most": max(held, key=lambda s: (held[s], -s))}[rule]] += 1
            at += size
        assert {r.section: r.n_tokens for k in ("source", "text") for r in got[i, k] if r.n_tokens} == dict(expected), mine
    assert token_spans.count_tokens(empty).count() == 0


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("share", [1 / 2000, 0.1])
def test_exact_dedup(docs, empty, share):
    rows = heavy_dedup.group_copies(docs, share).collect()
    assert len(rows) == docs.count()
    texts = {i: t for i, t in enumerate(AWKWARD)} | {None: "no id"}
    groups = {}
    for r in rows:
        groups.setdefault(normal(texts[r.doc_id]), []).append(r)
    for text, group in groups.items():
        best = min((r.doc_id for r in group), key=lambda i: (-len(texts[i] or ""), -1 if i is None else i))
        assert {r.keep_id for r in group} == {best} and {r.group_size for r in group} == {len(group)}
        assert sum(r.kept for r in group) == 1 and all(r.doc_id == best for r in group if r.kept)
        assert bytes(group[0].digest).hex() == hashlib.sha256(text.encode()).hexdigest()
    left = heavy_dedup.drop_copies(docs, share)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert heavy_dedup.group_copies(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 23, 24, 25, 1000])
def test_feistel(spark, n):
    docs = spark.range(n).select((F.col("id") * 7 % 1009).alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    rows = feistel.shard_documents(docs).collect()
    assert sorted(r.row_number for r in rows) == list(range(n))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.row_number)] == sorted(r.doc_id for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(24))) <= 1
    for shard, size in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(size))
    again = {r.doc_id: (r.shard, r.slot) for r in feistel.shard_documents(docs.repartition(5)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_feistel_crc_and_nulls(docs):
    for r in feistel.shard_documents(docs).collect():
        text = ("no id" if r.doc_id is None else AWKWARD[r.doc_id] or "").encode()
        assert r.size == len(text) + 8 and r.text_crc32 == binascii.crc32(text)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


@pytest.mark.parametrize(("direct", "edits"), [(20_000, 9), (0, 9), (0, 24)])
def test_near_dedup(spark, empty, monkeypatch, direct, edits):
    """By pairs, and by differences to a centre, with and without sets at its rim."""
    monkeypatch.setattr(setsketch, "DIRECT_PAIRS", direct)
    r = random.Random(5)
    base = [r.choice(WORDS) for _ in range(120)]
    texts = []
    for k in range(160):
        words = list(base) if k < 110 else [r.choice(WORDS) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, edits)):
            if words:
                words[r.randrange(len(words))] = r.choice(WORDS)
        texts.append(" ".join(words))
    texts += [None, "", "one", "One", "a b", "a  b", "b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("comp", F.lit(1)).repartition(5)
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    rows = setsketch.group_near_duplicates(docs).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in rows} == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}
    left = setsketch.drop_near_duplicates(docs)
    assert sorted(x.doc_id for x in left.collect()) == sorted({find(i) for i in range(len(texts))}) and left.columns == docs.columns
    assert setsketch.group_near_duplicates(empty).count() == 0


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    left, right = pool[:2000], pool[400:2300]
    a, b = setsketch.registers(left), setsketch.registers(right)
    assert (np.maximum(a, b) == setsketch.registers(pool[:2300])).all()
    true = 1600 / 2300
    assert abs(setsketch.likely_similarity(a[None], b[None], np.array([2000.0]), np.array([1900.0]))[0] - true) < 0.1


def words_of(text):
    lower = (text or "").translate(str.maketrans(winnowing.UPPER, winnowing.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_winnowing(spark, empty):
    r = random.Random(9)
    items = [prose(n, n) for n in (5, 12, 13, 14, 40, 25)] + [None, "...", "the the " * 10]
    docs = []
    for k in range(80):
        words = [r.choice(WORDS) for _ in range(r.randint(0, 150))]
        item = items[r.randrange(6)].split()
        start = r.randint(0, max(0, len(item) - 13))
        words[len(words) // 2 : len(words) // 2] = item[start : start + r.choice((11, 12, 13, 14, 40))] if r.random() < 0.8 else []
        docs.append(" ".join(words).upper() if k % 7 == 0 else ", ".join(words))
    docs += [None, "", "the " * 400, items[0], items[4] + " " + items[4]]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("item", F.lit(1))
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, words string")
    got = {x.doc_id: (x.n_words, x.n_hit, list(x["items"])) for x in winnowing.find_contamination(frame, bench).collect()}
    for i, text in enumerate(docs):
        words, hit, found = words_of(text), set(), set()
        for j, item in enumerate(items):
            own = words_of(item)
            size = min(13, len(own))
            windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
            for at in range(len(words) - size + 1):
                if size and tuple(words[at : at + size]) in windows:
                    hit.update(range(at, at + size))
                    found.add(str(j))
        assert got[i] == (len(words), len(hit), sorted(found)), i
    left = winnowing.drop_contaminated(frame, bench)
    assert sorted(x.doc_id for x in left.collect()) == [i for i, (n, h, _) in sorted(got.items()) if not (h and 20 * h >= n)]
    assert winnowing.find_contamination(empty, bench).count() == 0
    assert {x.n_hit for x in winnowing.find_contamination(frame, bench.limit(0)).collect()} == {0}


def test_levenshtein_trie():
    words = {w: 5.0 for w in ("idiot", "worthless", "moron")}
    lex = lexicon.Lexicon(words, {"lowei": 3.0}, np.zeros(lexicon.FEATURES), frozenset(["maron"]))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(2)
    for _ in range(3000):
        word = list(r.choice(list(words)))
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(word) + 1)
            word[at : at + r.randint(0, 1)] = r.choices("idotmrn1", k=r.randint(0, 1))
        word = "".join(word)
        near = min((distance(word, w), w) for w in words)
        assert lex.near(word) == (near if near[0] <= 1 else None)
        assert near[0] > 1 or lex.may_be_near(word)
    assert lex.weigh("idi0t") and not lex.weigh("maron") and lex.weigh("loweixyz") == 3.0 and not lex.weigh("table")


def test_quotation_weighs_less():
    lex = lexicon.Lexicon({"idiot": 5.0}, {}, np.ones(lexicon.FEATURES))
    assert lex.score('you idiot') > lex.score('the word idiot is rude') > lex.score('it reads "you idiot" there') > lex.score("nothing here")


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(WORDS) for _ in range(r.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(("vilename", "dirtword")))
        junk = i % 4 == 0
        rows.append((i, " ".join(f"{w}%%%" if junk else w for w in words), "x"))
        labels.append((i, int(not junk), int(bad)))
    rows += [(600, None, "x"), (601, "", "x"), (None, "a vilename", "x")]
    labels += [(600, None, None), (None, 1, 1), (601, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(labelled, empty):
    docs, labels = labelled
    lex = lexicon.learn_lexicon(docs, labels)
    scored = {r.doc_id: r.score for r in lexicon.score_documents(docs, lex).collect()}
    assert len(scored) == docs.count() and all(0 <= s <= 1 for s in scored.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((scored[i] >= 0.7) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    left = lexicon.drop_toxic(docs, lex)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, s in scored.items() if s < 0.7}
    none = lexicon.learn_lexicon(docs, labels.limit(0))
    assert {r.score < 0.7 for r in lexicon.score_documents(docs, none).collect()} == {True}
    assert lexicon.score_documents(empty, lex).count() == 0


def test_only_true_copies_leave_the_sample(spark):
    """Texts that share frequent words and nothing else all train."""
    common = " ".join(f"w{i}" for i in range(40))
    texts = [f"{common} topic{i} other{i}" for i in range(50)]
    rows = [(i, text, i % 2) for i, text in enumerate(texts)]
    rows += [(100, texts[0].upper().replace(" ", " \n") + " ", 0), (101, texts[0], 1)]
    left = lexicon.without_copies(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert {r.doc_id for r in left.collect()} == {*range(50), 101}


def test_byte_network(labelled, empty):
    docs, labels = labelled
    keep = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    network = byte_cnn.fit_quality(docs, labels, keep)
    scored = {r.doc_id: r.score for r in byte_cnn.score_documents(docs, network).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scored[i] >= 0.3) == (i % 4 != 0) for i in held) >= 0.95 * len(held)
    assert len(scored) == docs.count() and all(0 <= s <= 1 for s in scored.values())
    assert byte_cnn.score_documents(empty, network).count() == 0
    flat = byte_cnn.fit_quality(docs, labels.limit(0), keep)
    assert len({round(r.score, 6) for r in byte_cnn.score_documents(docs, flat).collect()}) == 1


def test_chunks_cover_every_byte():
    for n in (0, 1, 31, 32, 33, 255, 256, 257, 480, 481, 5000):
        data = bytes(random.Random(n).randbytes(n))
        chunks = byte_cnn.chunks_of(data)
        step = byte_cnn.CHUNK - byte_cnn.OVERLAP
        covered = {i * step + k for i, c in enumerate(chunks) for k in range(len(c)) if c[k] != byte_cnn.PAD}
        assert covered == set(range(n))


def test_attention_scores(labelled, empty):
    docs, _ = labelled
    rows = attention_lm.train_and_score(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    counts = Counter()
    for i, text in texts.items():
        if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2:
            counts.update([*attention_lm.words_of(text), None])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        words = [*attention_lm.words_of(texts[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r.score < 0 and math.isfinite(r.score)
    assert attention_lm.train_and_score(empty).count() == 0


def test_attention_probabilities_sum_to_one_and_do_not_depend_on_the_batch():
    counts = np.zeros(50257, dtype=np.int64)
    counts[: 3000] = np.arange(3000)[::-1]
    input_of, class_of, log_share, class_share = attention_lm.place_ids(counts, load().token_bytes)
    direct = np.tile(class_share.astype(np.float32), (attention_lm.INPUTS, 1))
    begins = attention_lm.beginnings(log_share, class_of, load().token_bytes)
    model = attention_lm.AttentionModel(attention_lm.start_weights(direct), input_of, class_of, log_share, begins)
    prefix = np.arange(5, 50)
    logs, begun = (x.reshape(50257, -1)[:, -1] for x in model.score([np.append(prefix, k) for k in range(50257)]))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)
    # What begins a word or ends the text: given that, words and end are a distribution.
    first = np.array([token[:1] == b" " for token in load().token_bytes])
    first[END_ID] = True
    assert np.exp(logs[first]).sum() == pytest.approx(np.exp(begun[0]), rel=1e-4)
    texts = [np.arange(k) % 999 for k in (1, 4, 16, 17, 200)]
    for which in (0, 1):
        together = model.score(texts)[which]
        assert np.allclose(together, np.concatenate([model.score([t])[which] for t in texts]))
        changed = [t.copy() for t in texts]
        changed[4][150] = 2000
        assert np.allclose(model.score(changed)[which][: -50], together[: -50])


def test_word_probability_of_ids_and_beginnings():
    by_id, begun = np.log([0.5, 0.25, 0.125, 0.9]), np.log([0.8, 0.1, 0.4, 0.95])
    firsts, last = np.array([0, 2, 3]), np.array([False, False, True])
    assert np.exp(attention_lm.word_logs(by_id, begun, firsts, last)) == pytest.approx([0.5 * 0.25 / 0.8 * 0.4, 0.125 / 0.4 * 0.95, 0.9 / 0.95])


@pytest.mark.parametrize("rate", [0.01, 5.0])
def test_training_stays_in_range_over_many_steps(rate):
    """No rate and no number of steps lets weights leave the range of floats."""
    r = np.random.default_rng(1)
    w = attention_lm.start_weights(np.zeros((attention_lm.INPUTS, attention_lm.CLASSES), np.float32))
    rows = r.integers(0, 40, (32 * 120, attention_lm.WINDOW)).astype(np.int32)
    goals = (rows * 7 + 3) % attention_lm.CLASSES
    real = np.ones(rows.shape, np.float32)
    for turn in range(4):
        w = attention_lm.train_worker(w, rows, goals, real, rate, 120 * turn)
    assert all(np.isfinite(x).all() for x in w.values())
    t = attention_lm.tables(w)
    logits = (t["direct"][rows[:64]] + attention_lm.attend(t, rows[:64], 0)[0] @ w["mixed"]).reshape(-1, attention_lm.CLASSES)
    logs = attention_lm.picked(logits.copy(), goals[:64].ravel(), np.ones(attention_lm.CLASSES))[0]
    assert np.isfinite(logs).all() and (rate > 1 or logs.mean() > -0.5)


def test_training_windows_cover_the_text(docs, empty):
    """Every id of every row, and its end, is a goal once; long documents are not sampled."""
    assert attention_lm.WINDOW >= 24 and attention_lm.CONTEXT >= 8 and attention_lm.CLASSES >= 128
    rows = attention_lm.document_columns(docs)
    parts = [attention_lm.of_round(rows, i) for i in range(attention_lm.ROUNDS)]
    assert sum(part.count() for part in parts) == rows.count()
    seen, starts = Counter(), 0
    for part in parts:
        for r in attention_lm.draw_windows(part, attention_lm.JSON_FILE, attention_lm.RANK_FILE).collect():
            ids = np.frombuffer(bytes(r.ids), "<u2")
            assert len(ids) == attention_lm.WINDOW + 1
            goals = ids[1:][ids[1:] != attention_lm.START_ID]
            seen.update(goals.tolist())
            starts += ids[0] == attention_lm.START_ID and (ids[1 : attention_lm.CONTEXT + 1] == attention_lm.START_ID).all()
    expected = Counter()
    for r in rows.collect():
        words = attention_lm.words_of(r.text)
        expected.update(attention_lm.encode_words(load(), words)[0].tolist() if words else [])
        expected[attention_lm.END_ID] += 1
    assert seen == expected and starts == rows.count()
    assert attention_lm.draw_windows(attention_lm.document_columns(empty), attention_lm.JSON_FILE, attention_lm.RANK_FILE).count() == 0


def plain_training(w, rows, goals, real, rate, before):
    """Adam written out over all weights, with gradients in the shapes of the weights."""
    w = {k: x.copy() for k, x in w.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    size = attention_lm.BATCH
    for t, i in enumerate(range(0, len(rows), size), 1):
        now = np.float32(rate / np.sqrt(1 + (before + t) / attention_lm.SLOW_STEPS))
        grads = attention_lm.gradients(w, rows[i : i + size], goals[i : i + size], real[i : i + size])
        length = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        for k, g in grads.items():
            g = g * np.float32(min(1.0, attention_lm.CLIP / max(length, 1e-12)))
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            w[k] -= now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        attention_lm.bounded(w)
    return w


def test_training_is_adam_over_the_rows_that_occur():
    """More steps than lie between two scalings; ids as frequent as in text, a short last batch, places that are not real."""
    r = np.random.default_rng(2)
    w = attention_lm.start_weights(0.5 * r.standard_normal((attention_lm.INPUTS, attention_lm.CLASSES)).astype(np.float32))
    n = 32 * 300 + 7
    rows = np.minimum(r.zipf(1.3, (n, attention_lm.WINDOW)), attention_lm.INPUTS).astype(np.int32) - 1
    goals = (rows * 7 + 3) % attention_lm.CLASSES
    real = (r.random(rows.shape) > 0.1).astype(np.float32)
    ours = attention_lm.train_worker(w, rows, goals, real, 0.01, 50)
    plain = plain_training(w, rows, goals, real, 0.01, 50)
    assert list(ours) and set(ours) == set(plain)
    for k in plain:
        assert np.abs(ours[k] - plain[k]).max() < 0.005 and np.abs(plain[k] - w[k]).max() > 0.05, k
    # A step handles the gradients of the input rows that occur in its batch and of no others.
    grads, occurring = attention_lm.row_gradients(w, rows[:32], goals[:32], real[:32], attention_lm.Space(rows[:32].size))
    assert occurring.tolist() == sorted(set(rows[:32].ravel().tolist()))
    assert len(occurring) < attention_lm.INPUTS // 2
    assert grads["direct"].shape == (len(occurring), attention_lm.CLASSES) and grads["embed"].shape == (len(occurring), attention_lm.SIZE)


def test_sums_by_row_of_groups_of_all_sizes():
    r = np.random.default_rng(3)
    values = r.standard_normal((500, attention_lm.CLASSES)).astype(np.float32)
    for at in (np.zeros(500, np.int64), np.arange(500), np.minimum(r.zipf(1.5, 500), 99)):
        order = np.argsort(at, kind="stable")
        names, firsts = np.unique(at[order], return_index=True)
        sums = attention_lm.sums_by_row(values, order, firsts, np.empty_like(values))
        assert np.allclose(sums, [values[at == k].sum(axis=0) for k in names], atol=1e-4)


@pytest.mark.parametrize("shift", [0, 70, -70, 300])
def test_sums_of_exponents_of_any_size(shift):
    r = np.random.default_rng(4)
    logits, goals = (10 * r.standard_normal((50, 128)) + shift).astype(np.float32), r.integers(0, 128, 50)
    exact = logits.astype(np.float64)
    exact -= exact.max(axis=1, keepdims=True)
    total = np.exp(exact).sum(axis=1)
    share = r.random(128)
    chosen, begun = attention_lm.picked(logits.copy(), goals, share)
    assert np.allclose(chosen, exact[np.arange(50), goals] - np.log(total), atol=1e-3)
    assert np.allclose(begun, np.log(np.exp(exact) @ share / total), atol=1e-3)


def test_attention_gradients():
    r = np.random.default_rng(0)
    w = attention_lm.start_weights(0.1 * r.standard_normal((attention_lm.INPUTS, attention_lm.CLASSES)).astype(np.float32))
    rows = r.integers(0, attention_lm.INPUTS, (3, attention_lm.WINDOW)).astype(np.int32)
    goals = r.integers(0, attention_lm.CLASSES, rows.shape)
    real = np.ones(rows.shape, np.float32)

    def loss(weights):
        t = attention_lm.tables(weights)
        logits = (t["direct"][rows] + attention_lm.attend(t, rows, 0)[0] @ weights["mixed"]).astype(np.float64)
        return -attention_lm.picked(logits.reshape(-1, attention_lm.CLASSES), goals.ravel(), np.ones(attention_lm.CLASSES))[0].mean()

    grads = attention_lm.gradients(w, rows, goals, real)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        up, down = ({k: x.copy() for k, x in w.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(float(g[at]), rel=0.05), name


def test_pipeline_equals_its_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    lex = lexicon.learn_lexicon(docs, labels)
    left = [r for r in docs.collect() if lex.score(r.text or "") < 0.7]
    groups = {}
    for r in left:
        groups.setdefault(normal(r.text), []).append(r)
    left = [min(g, key=lambda r: (-len(r.text), r.doc_id)) for g in groups.values()]
    sets = {r.doc_id: shingles(r.text) for r in left}
    comp = {i: i for i in sets}
    for _ in range(6):
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    left = [r for r in left if comp[r.doc_id] == r.doc_id]
    windows = set()
    for item in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        own = words_of(item.text)
        windows |= {tuple(own[k : k + 13]) for k in range(len(own) - 12)}
    expected = {}
    for r in left:
        words = words_of(r.text)
        hit = {k + d for k in range(len(words) - 12) if tuple(words[k : k + 13]) in windows for d in range(13)}
        if not (hit and 20 * len(hit) >= len(words)):
            expected[r.doc_id] = hashlib.sha256(np.array(ids_of(r.text), "<u4").tobytes()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()} == expected
