"""Operators 11 to 13 against brute force, round trips and the public library."""

import json
import os
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from brute_tokens import alignment as brute_alignment
from brute_tokens import collocations as brute_collocations
from vocaframe.llm import alignment, cached_words, collocations, id_files
from vocaframe.llm.queries import op11_alignment, op12_id_files

SF = os.environ.get("VOCAFRAME_TEST_SF", "/root/testdata/sf0.001")
given = pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")

ODD = [
    None, "", " ", "   ", "a", "hello world", "Hello,  world!\n\nIt's   5,000 o'clock ", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ marks ▁",
    "中文没有空格，句子连在一起。日本語も。", "emoji 😀😀 👩‍👩‍👧 flags 🇩🇪", "tab\tand\r\nlines\x0b\x0c end", "nul \x00 in it", "é è ü ́  nbsp 　wide  line",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, " " * 500 + "x", "don't can't 'tis rock'n'roll ''s 's", "x" * 3000 + " y", "﻿bom �", "ﬁ ﬂ ½ Ⅳ İstanbul ǅ ẞ",
    "word " * 5000, "repeated row", "repeated row", "1234567890 12 3.14e-10", "\x1c\x1d\x1e\x1f\x7f", "a\u0085b c",
]


def paths(*names):
    return [P.path(n) for n in names]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "kept", i) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a string, row long").repartition(3)


def aligned(df):
    found = alignment.align(df, *paths("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return found.documents, found.pairs


def test_alignment_of_odd_texts(spark, odd):
    from hashlib import sha256

    expected = dict(enumerate(brute_alignment(ODD)))
    for limit in (1 << 22, 0):  # pairs broadcast, and sent back by slice
        docs = alignment.align(odd, *paths("byte_bpe_50k.json", "piece_bpe_32k.model"), pair_limit=limit).documents
        assert docs.columns == ["doc_id", "row", *alignment.RESULTS]  # a column called like a result is replaced
        for r in docs.collect():
            digest = sha256(r.groups.encode()).hexdigest() if r.n_a else ""
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, digest) == expected[r.doc_id], ODD[r.doc_id]
    assert sum(v[0] > 0 for v in expected.values()) > 15 and sum(v[0] == 0 for v in expected.values()) >= 3


@given
def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = dict(zip([r.doc_id for r in docs], brute_alignment([r.text for r in docs])))
    assert {r[0]: tuple(r)[1:] for r in op11_alignment(spark, SF).collect()} == expected


def test_identity_pairs_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "the house"), (2, "the house"), (3, "the")], "doc_id long, text string")
    docs, pairs = aligned(df)
    both = alignment.Both(*[open(p, "rb").read() for p in paths("byte_bpe_50k.json", "piece_bpe_32k.model")])
    got = {(r.a, r.b): r.n for r in pairs.collect()}
    assert sorted(got.values()) == [2, 3] and all(both.same[a] == b for a, b in got)
    assert [r.count_sum for r in docs.orderBy("doc_id").collect()] == [5, 5, 3]


def test_ranks_only_where_the_file_says_no_more():
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        raw = f.read()
    assert alignment.ByteLevel(raw).ranked is not None
    changed = json.loads(raw)
    changed["normalizer"] = {"type": "Lowercase"}
    side = alignment.ByteLevel(json.dumps(changed).encode())
    assert side.ranked is None and side.cached is not None
    texts = [t for t in ODD if t]
    plain = alignment.ByteLevel(raw)
    loose = alignment.Side.__new__(alignment.ByteLevel)
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_buffer(raw)
    tokenizer.encode_special_tokens = True
    loose.cached = cached_words.Cached(tokenizer, cached_words.LEADING)
    raws = [b" " + t.encode() for t in texts]
    data, edges = np.frombuffer(b"".join(raws), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raws])))
    for x, y in zip(plain.encode(texts, data, edges), loose.encode(texts, data, edges)):
        assert np.array_equal(x, y)


def test_alignment_of_nothing(spark, odd):
    docs, pairs = aligned(odd.where("false"))
    assert docs.collect() == [] and pairs.collect() == []


def test_a_group_without_common_ends_is_expanded_in_blocks(monkeypatch):
    both = alignment.Both(*[open(p, "rb").read() for p in paths("byte_bpe_50k.json", "piece_bpe_32k.model")])
    s = alignment.Slice.__new__(alignment.Slice)
    rng = np.random.default_rng(3)
    s.both, s.a, s.b = both, rng.integers(0, 50, 400), rng.integers(0, 40, 300)
    s.upto_a, s.upto_b = np.array([1, 390, 400]), np.array([2, 295, 300])
    s.size_a, s.size_b, s.doc = np.diff(s.upto_a, prepend=0), np.diff(s.upto_b, prepend=0), np.array([0, 1, 1])
    whole = [x.tolist() for x in s.links()]
    monkeypatch.setattr(alignment, "EXPAND", 500)
    assert [x.tolist() for x in s.links()] == whole
    assert sum(whole[3]) == 2 + 389 * 293 + 10 * 5


# --- op12 --------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 4096, 300_000])
@pytest.mark.parametrize("top", [1, 2, 50_000, 1 << 31, (1 << 63) - 1])
def test_simple8b_round_trip(n, top):
    rng = np.random.default_rng(n + top % 97)
    ids = rng.integers(0, top, n, endpoint=True)
    ids[rng.random(n) < 0.4] = 0
    words, escapes, word_offsets, escape_offsets = coded = id_files.pack(ids)
    assert np.array_equal(id_files.unpack(*coded, n), ids.astype(np.uint64))
    assert len(escapes) == int((ids >> 60 > 0).sum())
    for block in range(0, len(word_offsets), 7):  # any block alone
        part = id_files.unpack(*coded, n, block, block + 1)
        assert np.array_equal(part, ids[block * 1024:(block + 1) * 1024].astype(np.uint64))
    content = id_files.file_bytes(np.array([5]), np.array([n]), ids)
    assert np.array_equal(id_files.parse_file(content)[2], ids.astype(np.uint64))
    if n:
        with pytest.raises(ValueError):
            id_files.parse_file(content[:-1])


def test_selectors_pack_what_fits():
    assert len(id_files.pack(np.ones(60, np.int64))[0]) == 1
    assert len(id_files.pack(np.full(60, 3))[0]) == 2
    assert len(id_files.pack(np.full(60, (1 << 15) - 1))[0]) == 15
    assert len(id_files.pack(np.full(60, 49407))[0]) == 20


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_words_equal_the_library(spark, odd):
    expected = library_ids(ODD)
    got = {r.doc_id: list(r.ids) for r in id_files.encode_words(odd, P.path("word_bpe_49k.json")).collect()}
    for i, ids in enumerate(expected):
        assert got[i] == ids, ODD[i]


def test_more_new_runs_than_are_remembered(monkeypatch):
    monkeypatch.setattr(cached_words, "KEPT", 20)
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        words = cached_words.Cached.dropping_space(f.read())
    assert words.cut == cached_words.SIGNS
    rng = random.Random(1)
    for _ in range(5):
        texts = [" ".join(rng.choice(["one", "two,", "Three", "naïve", "it's", "x9", "z" * 99, f"w{rng.randrange(99)}"]) for _ in range(60)) for _ in range(9)]
        raw = [t.encode() for t in texts]
        ids, counts = words.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library_ids(texts)
    assert len(words.known) <= 20


def test_id_files_of_odd_texts(spark, odd, tmpdir_path):
    folder = os.path.join(tmpdir_path, "ids")
    id_files.save_texts(odd, P.path("word_bpe_49k.json"), folder, end_id=2)
    rows = id_files.little_endian(id_files.read_ids(spark, folder)).orderBy("doc_id").collect()
    start = 0
    for r, ids in zip(rows, library_ids(ODD), strict=True):
        assert (r.start, list(r.ids)) == (start, [*ids, 2])
        assert bytes(r.bytes) == np.array([*ids, 2], "<u4").tobytes()
        start += len(ids) + 1
    assert not [f for f in os.listdir(folder) if f.startswith("_staging")]


def test_many_files_keep_order_and_starts(spark, tmpdir_path):
    df = spark.range(0, 3000, 1, 7).select((2999 - F.col("id")).alias("doc_id"), F.expr("transform(sequence(0, CAST(id % 9 AS INT)), x -> id * 1000 + x)").alias("ids"))
    df = df.unionByName(spark.createDataFrame([(5000, None), (5001, []), (5002, [1 << 62, 7]), (5002, [3])], "doc_id long, ids array<long>"))
    folder = os.path.join(tmpdir_path, "ids")
    id_files.write_ids(df, folder, file_ids=2000)
    got = id_files.read_ids(spark, folder).orderBy("doc_id", "start").collect()
    flat = sorted(((r.doc_id, list(r.ids or [])) for r in df.collect()))
    start = 0
    for r, (doc, ids) in zip(got, flat, strict=True):
        assert (r.doc_id, r.start, list(r.ids)) == (doc, start, ids)
        start += len(ids)
    with open(os.path.join(folder, "index.json")) as f:
        index = json.load(f)
    assert index["ids"] == start and len(index["files"]) >= 8 and all(f["ids"] <= 2000 for f in index["files"])


def test_bad_ids_leave_no_files(spark, tmpdir_path):
    for rows in ([(1, [-1])], [(None, [1])], [(1, [None])]):
        folder = os.path.join(tmpdir_path, str(len(rows[0][1])) + str(rows[0][0]) + str(rows[0][1][0]))
        with pytest.raises(Exception):
            id_files.write_ids(spark.createDataFrame(rows, "doc_id long, ids array<long>"), folder)
        assert not os.path.exists(folder) or os.listdir(folder) == []


def test_no_documents_no_files(spark, odd, tmpdir_path):
    folder = os.path.join(tmpdir_path, "ids")
    id_files.save_texts(odd.where("false"), P.path("word_bpe_49k.json"), folder)
    assert id_files.read_ids(spark, folder).collect() == []


@given
def test_id_file_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, expected = 0, []
    for r, ids in zip(docs, library_ids([r.text for r in docs])):
        ids = [*ids, 2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op12_id_files(spark, SF).collect()) == expected


# --- op13 --------------------------------------------------------------------------

def phrase_rows():
    rng = random.Random(11)
    words = ["Alpha", "beta", "Ünder", "x", "中文", "o'neil", "a-b", "z" * 300] + [f"w{i}" for i in range(40)]
    rows = [(None, None), ("en", ""), ("en", None), ("", "lone word"), ("de", " \t \t"), ("en", "...,,;;!!??\n\r\x0b\x0c")]
    for i in range(120):
        picked = [rng.choice(words[:8] if rng.random() < 0.7 else words) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randrange(1, 60))]
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice([" ", "  "]).join(picked)))
    return rows + rows[20:40] + [("en", "new york city hall " * 700)]


@pytest.mark.parametrize("head, limit", [(1024, 1 << 21), (4, 1 << 21), (8, 0), (16, 12)])
def test_collocations_against_brute_force(spark, head, limit):
    rows = phrase_rows()
    df = spark.createDataFrame([(lang, text, 1) for lang, text in rows], "lang string, text string, n int").repartition(4)
    got = collocations.top_phrases(df, limit=200, min_count=6, head=head, id_limit=limit)
    got = got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 6, 200)
    assert len(got) > 100


def test_collocation_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(4 * 10**15, 10**16, 4 * 10**15, 4 * 10**15 + 1)], "a long, n long, l long, r long")
    got = df.select(collocations._score("a", "n", F.col("l"), F.col("r")).alias("s")).first().s
    assert got == 1000 * 4 * 10**15 * 10**16 // (4 * 10**15 * (4 * 10**15 + 1))


def test_collocations_of_nothing(spark):
    assert collocations.top_phrases(spark.createDataFrame([], "lang string, text string")).collect() == []
    with pytest.raises(ValueError):
        collocations.count_phrases(spark.createDataFrame([], "lang string, text string"), head=6)


def test_slices_are_small_beside_an_executor(monkeypatch):
    """A slice is expanded to all its links: two megabytes of text took 131 MB
    to count and 165 MB to score."""
    sent = SimpleNamespace(value=tuple(open(p, "rb").read() for p in paths("byte_bpe_50k.json", "piece_bpe_32k.model")))
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    texts = ["some words of a text " * 500] * 200
    row = pa.StructArray.from_arrays([pa.array(range(200), pa.int64())], names=["doc_id"])
    made = list(alignment._encode(sent)(iter([pa.RecordBatch.from_arrays([row, pa.array(texts)], names=["row", "text"])])))
    assert [r["doc_id"] for b in made for r in b["rows"][0].as_py()] == list(range(200))
    assert max(len(b["rows"][0]) for b in made) * len(texts[0]) <= 1 << 19


def test_texts_are_encoded_a_large_slice_at_a_time():
    """Each distinct run of a slice is looked up once."""
    sizes = []

    def encode(data, offsets):
        sizes.append(len(data))
        return np.zeros(len(offsets) - 1, np.int64), np.ones(len(offsets) - 1, np.int64)

    got = list(id_files._encoded(SimpleNamespace(encode=encode), pa.array(["x" * 10_000] * 180), 2))
    assert sizes == [1_800_000]
    assert [len(counts) for _, _, counts in got] == [180]


@pytest.mark.parametrize("n", [1, 59, 1024, 1025, 5000])
def test_selectors_are_the_greedy_choice(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 1 << rng.integers(0, 63, n), dtype=np.int64).astype(np.uint64)
    ids[rng.random(n) < 0.5] = 0
    expected, at = [], 0
    while at < n:
        end = min((at // id_files.BLOCK + 1) * id_files.BLOCK, n)
        best = next((s for s in range(id_files.ESCAPE) if all(int(i) >> int(id_files.WIDTHS[s]) == 0 for i in ids[at:min(at + id_files.COUNTS[s], end)])), id_files.ESCAPE)
        expected.append((at, best))
        at = min(at + int(id_files.COUNTS[best]), end)
    assert list(zip(*(x.tolist() for x in id_files._selectors(ids)))) == expected
