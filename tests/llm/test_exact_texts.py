"""Token ids and n-grams of whole texts, whatever they hold and however they are cut."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import ngram_join, language, queries, token_files

# combining marks, letters that change or grow in lower case, white space of all kinds, special tokens
ODD = [
    *"İıJKAaBzZstéÉÅßẞΣς가각1٣²ªµ中日ﬁǄǅÿŸ×÷þÞð", "J̌", "́", "̌", "̇", "ͅ", *".,!?;:'’_-\"()%#&<|>", " ", " ", "  ", "\t", "\n",
    " ", "​", " ", "\x85", "\x1c", "\x00", "😀", "👨‍👩‍👧", "<|endoftext|>", "<|startoftext|>", "re", "Σας",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    fixed = ["TEKELİ!", "KREDİSİ.", "İSTANBUL VALİLİĞİ, 1999", "J̌. x", "don't. I'll, we've! it's?", "a.\nB#\n\nc", "", "x" * 300_000 + "."]
    return fixed + ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(20_000)]


def test_ids_of_odd_texts_are_the_tokenizers(texts):
    path = queries.tokenizer_path()
    model, known = token_files._tokenizer(path)
    assert known is not None
    ids, sizes = token_files.encode(pa.array(texts), path)
    want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want))
    assert ids.tolist() == [x for w in want for x in w]


def test_other_tokenizers_encode_whole_texts(texts):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    model, known = token_files._tokenizer(path)
    assert known is None
    some = texts[:500]
    ids, sizes = token_files.encode(pa.array(some), path)
    want = [model.encode(t, add_special_tokens=False).ids for t in some]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_words_kept_by_a_worker_are_bounded(texts, monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_PIECES", 100)
    path = queries.tokenizer_path()
    model, known = token_files._tokenizer(path)
    known.clear()
    for start in (0, 300, 0):
        ids, _ = token_files.encode(pa.array(texts[start : start + 300]), path)
        assert ids.tolist() == [x for e in model.encode_batch(texts[start : start + 300], add_special_tokens=False) for x in e.ids]
        assert len(known) <= 100


def test_rows_that_repeat_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(token_files, "DOCS_PER_SHARD", 10)
    docs = spark.range(200).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same words").alias("text"), F.lit(1).alias("_tie"))
    shards = token_files.write_sequences(docs, queries.tokenizer_path(), length=8)
    assert shards.count() >= 10
    got = sorted(token_files.read_documents(shards).collect())
    size = got[0].n_tokens
    assert [r.start for r in got] == list(range(0, 200 * size, size)) and len({r.ids_crc32 for r in got}) == 1


def test_ngrams_over_long_runs_of_separators(monkeypatch):
    rng = random.Random(3)
    seps = [" ", "\n\n", " " * 25, ". ", "1234567890" * 3, ""]
    pieces = ["x", "abc", "Σας", "İz", "d", "日本", "Éé"]
    for _ in range(150):
        text = "".join(rng.choice(seps) + rng.choice(pieces) for _ in range(rng.randint(0, 12))) + rng.choice(seps)
        monkeypatch.setattr(language, "PIECE", 1 << 20)
        whole = language.ngrams(text).tolist()
        for piece in (1, 2, 7, 50):
            monkeypatch.setattr(language, "PIECE", piece)
            assert language.ngrams(text).tolist() == whole


def presence_kernel(a, b):
    return len(a & b) / (max(1, len(a)) * max(1, len(b))) ** 0.5


def test_language_outputs_are_those_of_a_dense_kernel_solved_directly(spark):
    rng = random.Random(5)
    parts = {"xx": "ba de fi go", "yy": "lu mo ne pi", "zz": "ra so tu va"}
    rows = [(i, " ".join(rng.choices(parts[k].split(), k=rng.randint(3, 30))), k) for i in range(150) for k in [sorted(parts)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, landmarks=10)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    sample = sorted((r[2], r[0], set(language.ngrams(r[1]).tolist())) for r in learned)
    marks = [s for k in sorted(parts) for s in [s for lang, _, s in sample if lang == k][:10]]
    k_mm = np.array([[presence_kernel(a, b) for b in marks] for a in marks])
    k_nm = np.array([[presence_kernel(a, b) for b in marks] for _, _, a in sample])
    weight = np.array([1 / sum(lang == x for x, _, _ in sample) for lang, _, _ in sample])[:, None]
    y = np.array([[1.0 if lang == k else -1.0 for k in sorted(parts)] for lang, _, _ in sample])
    solved = np.linalg.solve(k_nm.T @ (weight * k_nm) + language.RIDGE * k_mm / len(marks) + 1e-9 * np.eye(len(marks)), k_nm.T @ (weight * y))
    tests = [language.ngrams(r[1]) for r in rows]
    want = np.array([[presence_kernel(set(t.tolist()), m) for m in marks] for t in tests]) @ solved
    assert model.outputs(tests) == pytest.approx(want, abs=1e-3)


def test_sample_has_the_smallest_hashes_of_every_group(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 10 == 1, "b").otherwise("a").alias("lang"))
    got = sorted(tuple(r) for r in language.sample_ids(rows, "lang", 50).collect())
    want = []
    for lang in "ab":
        ids = rows.where(F.col("lang") == lang).select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(50).collect()
        want += [(lang, r.doc_id) for r in ids]
    assert got == sorted(want)


def test_spread_copies_keep_their_component(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    near = [*words[:-1], "other"]
    rows = [(i, " ".join(words)) for i in range(5, 25)] + [(3, " ".join(near)), (2, "alone in this table"), (1, None), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "HOT_COPIES", 3)
    got = [(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()]
    assert sorted(got) == sorted([(i, 3) for i in range(5, 25)] + [(3, 3), (2, 2), (1, 1), (1, 1)])
