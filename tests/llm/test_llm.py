"""Operators for training data, against brute force, round trips and defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from ledgerspark.llm import (
    hilbert_search, language, mixing, ngram_join, phrase_index, pii, queries, suffix_dedup, token_files, toxicity, warc,
)
from ledgerspark.llm.common import staged
from ledgerspark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns with names that operators use for themselves
CLASHES = ["score", "size", "tag", "n", "unit", "h", "label", "prefix", "pos", "term", "taken", "lang_pred"]


def words(rng, n, vocabulary="ba de fi go lu mo ne pi ra so tu va xe zo".split()):
    return " ".join("".join(rng.choices(vocabulary, k=rng.randint(1, 3))) for _ in range(n))


def odd_rows():
    rng = random.Random(4)
    base = words(rng, 120)
    rows = [
        (1, base, "aa", "s1"), (2, base, "aa", "s1"), (2, base, "aa", "s1"), (3, base + " " + words(rng, 4), "aa", "s2"),
        (4, None, "bb", "s2"), (5, "", "bb", None), (6, " \t\n .,; ", None, "s3"), (7, "Ünï ÀB mañana 日本語 x", "bb", "s3"),
        (None, words(rng, 30), "bb", "s1"), (8, "a" * 5000, "aa", None), (9, "one two", None, None),
        (10, words(rng, 9000), "bb", "s4"), (11, "call +1 (555) 555-0100 or a.b@c.example.org, 10.0.0.1", "aa", "s4"),
        (12, "one two", "aa", "s1"), (12, words(rng, 40), "aa", "s1"),
    ]
    rows += [(100 + i, words(rng, rng.randint(5, 80)), "aa" if i % 2 else "bb", f"s{i % 5}") for i in range(40)]
    return [(*r, len(r[1]) if r[1] else None) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    for i, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.lit(i))
    return staged(docs)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# mixing

def test_sainte_lague_takes_the_highest_quotients(spark):
    rng = random.Random(1)
    parts = [(g, i, rng.randint(0, 900), 57 + g) for g in range(4) for i in range(6)]
    df = spark.createDataFrame(parts, "g long, i long, w long, seats long")
    got = {(r.g, r.i): r.quota for r in mixing.sainte_lague(df, "g", "w", "seats", "i").collect()}
    for g in range(4):
        w = {i: x for k, i, x, _ in parts if k == g}
        best = sorted(((-x / (2 * k + 1), i, k) for i, x in w.items() if x for k in range(200)))[: 57 + g]
        assert {i: sum(j == i for _, j, _ in best) for i in w} == {i: got[g, i] for i in w}


def test_mix_stays_near_targets_and_below_the_cap(odd):
    sizes = staged(mixing.word_sizes(odd))
    rows = mixing.mix(sizes, block=4).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(rows_of(mixing.mix(sizes, block=4)), key=repr)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert None in by
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= 4 * (1 + len(group) ** 0.5)
    assert sum(g[0].target for g in by.values()) == pytest.approx(sum(r.size for r in rows))
    mixed = mixing.mixed_documents(odd, block=4)
    assert mixed.columns == odd.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in rows)


def test_mix_of_nothing(none):
    assert mixing.mix(staged(mixing.word_sizes(none))).count() == 0
    assert mixing.mixed_documents(none).count() == 0


# repeated passages

def brute_repeats(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1]))):
        cover = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if text[i : i + length] in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(text[i : i + length])
        kept = bytes(c for c, x in zip(text, cover) if not x)
        spans = len(re.findall(b"\1+", bytes(cover)))
        out[doc, text] = (doc, len(text), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[r] for r in rows), key=repr)


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
def test_repeats_against_brute_force(spark, odd, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # 2: most anchors take the way of very frequent ones
    rng = random.Random(2)
    shared = [words(rng, 25) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([words(rng, 8), rng.choice(shared)]) for _ in range(9))) for i in range(80)]
    rows += [(200, "ab" * 300), (201, "x" + "ab" * 200)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept")
    assert sorted(rows_of(got), key=repr) == brute_repeats([(d, t.encode()) for d, t in rows], 100)
    got = suffix_dedup.remove_repeats(odd).drop("kept")
    assert sorted(rows_of(got), key=repr) == brute_repeats([(r[0], (r[1] or "").encode()) for r in odd_rows()], 100)


def test_only_parts_with_a_common_core_are_cut_into_suffixes(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 4)
    rng = random.Random(11)

    def letters(n):
        return "".join(rng.choices("abcdefghij ", k=n))

    phrase, passage = letters(60), (letters(25), letters(25))
    rows = [(i, letters(150) + phrase + letters(150)) for i in range(40)]
    rows += [(100 + i, letters(150) + passage[0] + phrase + passage[1] + letters(150)) for i in range(3)]
    cut = []
    real = suffix_dedup.suffixes

    def seen(found, length):
        cut.extend(r.doc_id for r in found.select("doc_id").collect())
        return real(found, length)

    monkeypatch.setattr(suffix_dedup, "suffixes", seen)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept")
    assert sorted(rows_of(got), key=repr) == brute_repeats([(d, t.encode()) for d, t in rows], 100)
    assert cut and set(cut) <= {100, 101, 102}, "the phrase alone makes no windows equal"


@pytest.mark.parametrize("copies, most", [(2, 0), (30, 400)])
def test_few_windows_of_frequent_anchors_are_cut_into_suffixes(spark, monkeypatch, copies, most):
    monkeypatch.setattr(suffix_dedup, "GROUP", 8)
    rng = random.Random(13)

    def letters(n):
        return "".join(rng.choices("abcdefghij ", k=n))

    # all anchors lie in the phrase, which makes no windows equal; each passage around it does
    phrase = letters(60)
    passages = [letters(25) + phrase + letters(25) for _ in range(60 // copies)]
    rows = [(i, letters(150) + passages[i % len(passages)] + letters(150)) for i in range(60)]
    cut = []
    real = suffix_dedup.suffixes

    def seen(found, length):
        made = real(found, length)
        cut.append(made.count())
        return made

    monkeypatch.setattr(suffix_dedup, "suffixes", seen)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept")
    assert sorted(rows_of(got), key=repr) == brute_repeats([(d, t.encode()) for d, t in rows], 100)
    assert sum(cut) <= most, "windows of passages that few share, or that agree anyway"


def test_repeats_across_pieces_of_a_long_text(spark, none):
    rng = np.random.default_rng(3)
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, suffix_dedup.PIECE + 400_000))
    edge = suffix_dedup.PIECE - 150
    text = text[:edge] + text[1000:1300] + text[edge + 300 :]
    row = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert (row.n_removed, row.n_spans) == (300, 1)
    assert bytes(row.kept).decode() == text[:edge] + text[edge + 300 :]
    assert suffix_dedup.remove_repeats(none).count() == 0


# archives

def test_archives_round_trip(spark):
    body = "<p>" + "same page " * 20
    pages = [
        (5, "http://a/\r\nX: 1", body), (3, None, body), (9, "http://b/", body), (3, None, body), (None, "http://c/", body),
        (1, "http://d/", None), (2, "http://e/", ""), (4, "http://f/", "short"), (6, "http://g/", "short"),
        (7, "http://h/", "Ünï\r\n\r\n" * 100), (8, "http://i/", "z" * 3_000_000),
    ]
    archives = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)))
    got = warc.read_archives(archives).collect()
    want = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        later = html == body and page_id in (5, 9)
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", 3 if later else None))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    assert {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}[7] == pages[9][2].encode()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(empty)).count() == 0


def test_broken_archives_are_refused():
    import io
    import struct

    import zstandard

    record = warc.record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse_record(record)["payload"] == b"payload"
    for bad in (record[:-1], record.replace(b"payload\r", b"pAyload\r"), record.replace(b"WARC/1.1", b"WARC/0.9"), b"", record.replace(b"WARC-Type", b"X-Type")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    frame = zstandard.ZstdCompressor().compress(record)
    good = struct.pack("<II", warc.DICTIONARY_MAGIC, 0) + frame * 3
    assert list(warc.read_frames(io.BytesIO(good))) == [record] * 3
    for bad in (frame, good[:-3], good + b"xxxx"):
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(io.BytesIO(bad)))


# nearest neighbours

def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * n)).reshape(n, -1).T
        keys = hilbert_search.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(1 << n * bits))
        assert set(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)) == {1}


def test_search_finds_neighbours_and_ties(spark):
    rng = np.random.default_rng(1)
    points = {i: v.astype(np.float32) for i, v in enumerate(rng.normal(size=(900, 8)))}
    for i in range(300, 340):  # more equal vectors than a result holds
        points[i] = points[200]
    rows = [(i, [float(x) for x in v]) for i, v in points.items()]
    rows += [(1000, None), (1100, [0.0] * 8), (1200, [1.0] * 7 + [None]), (1300, [1.0] * 7 + [float("nan")]), (1400, [1.0] * 3), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in hilbert_search.search(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.array(list(points.values()), float)
    hit = 0
    assert sorted(got) == list(range(0, 900, 100))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        assert all(s == pytest.approx(d[i], abs=1e-12) for i, s in found) and len(found) == 10
        hit += len(set(best) & {i for i, _ in found})
    assert hit >= 0.9 * 90
    assert [i for i, _ in got[200]] == list(range(300, 310))
    few = hilbert_search.search(table.where("vec_id in (0, 1, 2)")).orderBy("rank").collect()
    assert len(few) == 2
    assert hilbert_search.search(table.where("vec_id < 0")).count() == 0


# phrases

def test_phrases_in_odd_rows(spark, odd, none):
    items = [(1, "one two"), (2, "two one"), (3, None), (4, " ,. "), (None, "mañana"), (5, odd_rows()[0][1][:200]), (5, "ONE two"), (6, "日本語 x")]
    table = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    want = []
    for doc, text, *_ in odd_rows():
        have, hit, found = split(text), set(), set()
        for item, phrase in items:
            w = split(phrase)
            n = min(10, len(w))
            for s in range(len(w) - n + 1 if n else 0):
                for a in range(len(have) - n + 1):
                    if have[a : a + n] == w[s : s + n]:
                        hit.update(range(a, a + n))
                        found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        want.append((doc, len(have), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    got = rows_of(phrase_index.contamination(odd, table).drop("tag"))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert phrase_index.contamination(none, table).count() == 0
    assert not phrase_index.contamination(odd, table.where("false")).where("contaminated").count()


def test_proximity(spark):
    docs = phrase_index.keyed(spark.createDataFrame([(1, "red x fox"), (2, "fox red"), (3, "red a b c d fox"), (4, "red")], "doc_id long, text string"))
    terms = staged(phrase_index.body_terms(phrase_index.item_texts(spark.createDataFrame([(1, "red fox")], "item_id long, text string"))))
    found = lambda slop: sorted(r.doc_id for r in phrase_index.proximity_matches(docs, terms, slop).collect())
    assert (found(0), found(1), found(4)) == ([2], [1, 2], [1, 2, 3])


# token files

def test_token_files_hold_the_ids_of_whole_texts(odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    model = Tokenizer.from_file(path)
    odd = odd.union(odd.limit(1).withColumn("doc_id", F.lit(500).cast("long")).withColumn("text", F.lit("It's (a).  <|ENDOFTEXT|> <|endoftext|> İI don't! é, 12.5")))
    shards = token_files.write_sequences(odd, path, length=64)
    got = sorted(map(tuple, token_files.read_documents(shards).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, want = 0, []
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    for doc, text in rows:
        ids = [*model.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    shard = shards.orderBy(F.desc("n_ids")).head()
    file = token_files.SequenceFile(shard.path)
    ids, mask = file[3]
    assert (len(ids), len(mask), str(ids.type)) == (64, 64, "uint16")
    assert sum(len(run) for run, _ in file.runs()) == shard.n_ids
    assert file[0][0].equals(file.batch(0).column("ids").values[:64])
    assert token_files.read_documents(token_files.write_sequences(none, path)).count() == 0


# language

def test_language_is_learned(spark, odd, none):
    rng = random.Random(5)
    parts = {"xx": "ba de fi go".split(), "yy": "lu mo ne pi".split(), "zz": "ra so tu va".split()}
    rows = [(i, words(rng, rng.randint(3, 60), parts[k]), k) for i in range(400) for k in [sorted(parts)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.languages_of(docs).collect()}
    held = [(i, k) for i, _, k in rows if found[i].held_out]
    assert {i for i, _ in held} == {i for i in found if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([found[i].lang_pred == k for i, k in held]) > 0.95
    got = language.languages_of(odd).collect()
    texts = {r[0]: r[1] for r in odd_rows()}
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (4, 5, 6)) and texts[4] is None
    assert language.languages_of(none).count() == 0
    assert {r.lang_pred for r in language.languages_of(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_ngrams_do_not_depend_on_pieces(monkeypatch):
    text = words(random.Random(6), 300) + " É日本 " + words(random.Random(7), 100)
    whole = language.ngrams(text)
    for piece in (7, 50):
        monkeypatch.setattr(language, "PIECE", piece)
        assert set(whole) - set(language.ngrams(text)) == set()


def test_rows_that_repeat_an_id_keep_first_occurrences(spark):
    rng = random.Random(12)
    shared = words(rng, 60)
    a, b = (f"{words(rng, 30)} {shared} {words(rng, 30)}" for _ in range(2))
    rows = [(1, a), (1, a), (2, b)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept")
    assert sorted(rows_of(got), key=repr) == brute_repeats([(d, t.encode()) for d, t in rows], 100)
    assert {r.n_removed for r in got.where("doc_id = 1").collect()} == {0}


# toxicity

def test_toxic_words_are_learned(spark, odd, none):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        w = words(rng, rng.randint(40, 120)).split()
        if toxic:
            for _ in range(6):
                w.insert(rng.randint(0, len(w)), rng.choice(["grumblord", "snotface", "vilewretch"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxic_scores(docs, toxicity.train(docs, table)).where("held_out").collect()
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(900))
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in got]) > 0.95
    model = toxicity.train(odd, table)
    scored = toxicity.toxic_scores(odd, model).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.toxic_scores(none, toxicity.train(none, table)).count() == 0


def test_toxic_stems_with_rare_endings_are_learned():
    rng = random.Random(9)
    texts = {0: [], 1: []}
    for i in range(400):
        w = words(rng, rng.randint(40, 80)).split()
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randint(0, len(w)), "grumbl" + words(rng, 1) + words(rng, 1))
        texts[int(i % 4 == 0)].append(toxicity.windows(" ".join(w)))
    parts = toxicity.distinctive(texts[1], texts[0])
    assert len(parts) >= 400 and all(p.startswith(b" g") for p in parts)
    # hundreds of whole words set texts apart, and each of them is used
    many = [[b" " + b"v%03dxq" % i + b" " for i in range(200)]] * 50
    assert len(set(toxicity.distinctive(many, texts[0]))) == 200


# personal data

def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    pieces = ["a", "1", "23", ".", "@", "+", "-", " ", "(", ")", "b.c", "4111", "%", "é", "255", "256"]

    def brute(text):
        found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
        for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 14, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m.group())
                if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                    found.append((kind, m.start(), m.end()))
        return sorted(found)

    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        assert sorted(pii.base_spans(text)) == brute(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_boosted_candidates_add_spans(spark, odd, none):
    rng = random.Random(9)

    def card(valid):
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        last = next(d for d in "0123456789" if pii.luhn(body + d) == valid)
        return body + last

    rows = [(i, f"{words(rng, 9)} card: {card(i % 40 != 0)} {words(rng, 5)} no {rng.randint(10**12, 10**13)}x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(docs)
    got = pii.find_personal_data(docs, model).collect()
    mistyped = [r for r in got if r.doc_id % 40 == 0]
    assert all(r.n_card == 0 and r.spans.count("card:") == 1 for r in mistyped)
    assert all(r.n_card == 1 and r.spans.count("card:") == 1 for r in got if r.doc_id % 40)
    found = {r.doc_id: r for r in pii.find_personal_data(odd, pii.train(odd)).collect()}
    assert (found[11].n_email, found[11].n_ip, found[11].n_phone) == (1, 1, 1)
    assert found[4].spans == "" and found[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(none, pii.train(none)).count() == 0
    assert pii.redact("x a@b.c y", [("email", 2, 7)]) == "x [email] y"


# near duplicates

def brute_groups(rows):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets[len(sets)] = (doc, s)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i in sets:
        groups[root(i)].append(sets[i][0])
    name = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, len(s), name[root(i)]) for i, (d, s) in sets.items()), key=repr)


def test_near_duplicates_against_brute_force(spark, odd, none):
    rng = random.Random(10)
    boilerplate = words(rng, 60)
    rows = []
    for f in range(12):
        base = words(rng, rng.randint(6, 90)).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append(" ".join(w))
    rows += [boilerplate + " " + words(rng, rng.randint(1, 25)) for _ in range(60)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    groups = lambda df: ngram_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id")
    got = groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(rows_of(got), key=repr) == brute_groups(rows)
    got = groups(odd)
    assert sorted(rows_of(got), key=repr) == brute_groups([r[:2] for r in odd_rows()])
    assert ngram_join.near_duplicates(none).count() == 0


def test_t_occurrence_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(60):
        query = np.unique(rng.integers(0, 60, 40))
        candidates = [np.unique(np.append(query[rng.random(len(query)) < 0.93], rng.integers(0, 80, rng.integers(0, 9)))) for _ in range(20)]
        want = [i for i, c in enumerate(candidates) if 100 * len(np.intersect1d(query, c)) >= 80 * len(np.union1d(query, c))]
        assert sorted(ngram_join.t_occurrence(query, candidates)) == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 130)] + [(60, 61), (61, 60), (70, 70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 130)}, 60: 60, 61: 60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# pipeline

def test_pipeline_stages_keep_clean_documents(spark, odd, tmp_path):
    items = spark.createDataFrame([(1, " ".join(odd_rows()[20][1].split()[:12])), (2, None)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = odd, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = staged(stage(spark, docs, str(tmp_path)))
        assert docs.columns == odd.columns
        kept[name] = [r.doc_id for r in docs.collect()]
    language_kept, unique, clean, mixed = kept.values()
    assert not {4, 5, 6} & set(language_kept) and {1, 2, 3, 10, 11} <= set(language_kept)
    assert 1 in unique and not {2, 3} & set(unique) and len(unique) == len(language_kept) - 4
    assert set(unique) - set(clean) == {odd_rows()[20][0]}
    assert set(mixed) <= set(clean)
    tokens = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    assert sorted(map(repr, (r.doc_id for r in tokens.collect()))) == sorted(map(repr, mixed))
    assert tokens.agg(F.sum("n_tokens") - F.max(F.col("start") + F.col("n_tokens"))).head()[0] == 0


def test_pipeline_of_nothing(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.llm_oracles()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    got = queries.llm_queries()[name](spark, sf_dir)
    want = con.sql(queries.llm_oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, rows_of(got))) == sorted(map(repr, want.select(*got.columns).fetchall()))
    assert isinstance(got.schema, T.StructType)
