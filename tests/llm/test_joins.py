"""Joins and dedup operators against brute force."""

import hashlib
import os
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from vocaframe.llm import line_dedup, ngram_join, signature_tree, suffix_dedup  # noqa: E402

SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    """With clashing extra columns, over several partitions."""
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("r")).withColumn("n", F.lit(7)).withColumn("vid", F.lit("v"))
    return df.repartition(5, "doc_id")


@pytest.mark.parametrize("seed", [1, 2])
def test_link_classes(spark, seed):
    rows = brute.corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_classes(frame(spark, rows)).collect()}
    assert got == brute.classes(rows)


def test_link_classes_in_small_and_salted_blocks(spark, monkeypatch):
    rows = brute.corpus(3, 40)
    base = "w%d " * 40 % tuple(range(40))
    rows += [(1000 + i, base + f"e{i} " * (i % 9)) for i in range(30)]
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_classes(frame(spark, rows)).collect()}
    assert got == brute.classes(rows)


def test_unique_documents_keeps_the_smallest_id_and_all_columns(spark):
    rows = [(5, "a b c d e f g h i j"), (3, "a b c d e f g h i j"), (9, "other words here are these six"), (None, "a b c d e f g h i j")]
    out = ngram_join.unique_documents(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "row", "n", "vid"]
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 3, 9]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = brute.corpus(seed)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == brute.kept_lines(rows)


def test_line_dedup_of_repeated_rows_and_missing_ids(spark):
    line = "one two three four five six"
    rows = [(1, line), (1, line), (2, line + "\nnew words come after this line"), (None, line)]
    got = sorted((r.doc_id or 0, r.n_removed, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == [(0, 0, line), (1, 0, line), (1, 0, line), (2, 1, "new words come after this line")]


def test_line_dedup_of_lines_with_few_words(spark):
    rows = [(1, "Click here now\n\nShare\nunique words"), (2, "click  HERE now\n\nClick here"), (3, "Share\nClick here now please\n一二三四五六七八九十"), (4, "一二三四五六七八九十\n \nhere Click now\nShare\nShare")]
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (1, "\nClick here"), 3: (1, "Click here now please\n一二三四五六七八九十"), 4: (3, " \nhere Click now")}
    assert got == {i: x[1:] for i, x in brute.kept_lines(rows).items()}


def test_line_dedup_forgets_lines_beyond_its_table(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SEEN_SLOTS", 2)
    rows = brute.corpus(5, 30)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == brute.kept_lines(rows)


def test_line_dedup_salted(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SALT_ROWS", 4)
    rows = brute.corpus(4, 40)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == brute.kept_lines(rows)


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_remove_repeats(spark, seed):
    rows = brute.corpus(seed)
    out = suffix_dedup.remove_repeats(frame(spark, rows))
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()}
    want = {i: (n, gone, runs, hashlib.sha256(kept).hexdigest()) for i, (n, gone, runs, kept) in brute.without_repeats(rows).items()}
    assert got == want


def test_remove_repeats_without_ids(spark):
    rows = [(None, "z" * 200), (4, "z" * 200), (2, "z" * 60), (2, "z" * 60)]
    got = sorted(((r.doc_id or 0), len(r.kept)) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == [(0, 200), (2, 60), (2, 60), (4, 0)]


@pytest.mark.parametrize("operator", [ngram_join.link_classes, line_dedup.dedup_lines, suffix_dedup.remove_repeats])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def test_remove_repeats_of_samples_in_very_many_zones(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_ZONES", 2)
    rows = brute.corpus(6, 40)
    got = {r.doc_id: (r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {i: (n, runs, kept) for i, (n, _, runs, kept) in brute.without_repeats(rows).items()}


def _sent(rows, parts=4):
    """Rows of ``_send`` for each small batch of ``rows``."""
    return [b for i, t in rows for b in suffix_dedup._send(parts)(iter([pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t, pa.string())], names=["doc_id", "text"])]))]


def test_a_zone_of_many_documents_is_sent_once_a_task():
    passage = "a passage that all of these documents share, and that is longer than one window of fifty bytes by far"
    ids = list(range(40, 0, -1))
    sent = pa.Table.from_batches(_sent([(ids, [f"{i * 7919} {passage} {i * 104729}" for i in ids])]))
    seen, settled = [], 0
    for part, own, zones in zip(sent["part"].to_pylist(), sent["ids"].to_pylist(), sent["zones"].to_pylist()):
        if zones:
            key, rank, *_ = suffix_dedup._unpack(np.frombuffer(zones, np.uint8))
            seen += [(part, k, r) for k, r in zip(key.tolist(), rank.tolist())]
        else:
            held = np.frombuffer(own, np.int64)
            settled += len(held) // 2
            assert 1 not in held[:len(held) // 2]
    assert len(seen) == len(set(seen)) and settled >= 39


def test_a_bucket_reads_all_chunks_of_its_partition(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "whole", lambda batches: pa.Table.from_batches(list(batches)))
    text = "this string of more than fifty bytes is in each one of four documents of different tasks"
    sent = _sent([([i], [text]) for i in range(4)], parts=1)
    found = pa.Table.from_batches(list(suffix_dedup._sort_bucket(iter(sent))))
    assert set(found["doc_id"].to_pylist()) == {1, 2, 3}


def _zones_of_one_sample(n):
    """Rows for ``_sort_windows``: zones of 80 bytes around one sample, each with its neighbour's left half."""
    rng = np.random.default_rng(11)
    halves = rng.integers(97, 123, (n + 1, 30), dtype=np.uint8)
    halves[:, 0] = 97 + np.arange(n + 1) % 2  # no longer matches
    sample = b"a sample of 20 bytes"
    raw = [halves[i].tobytes() + sample + halves[i + 1].tobytes() for i in range(n)]
    raw = [r if i % 2 else raw[(i + 1) % n][:50] + r[50:] for i, r in enumerate(raw)]
    return suffix_dedup.batch(suffix_dedup._BYTES, [5] * n, list(range(n)), list(range(n)), [30] * n, raw)


def test_windows_are_hashed_in_slices_and_sorted_in_ranges(monkeypatch):
    rows = _zones_of_one_sample(12_000)
    monkeypatch.setattr(suffix_dedup.K._Powers, "up", np.ones(1, np.uint64))
    monkeypatch.setattr(suffix_dedup.K._Powers, "down", np.ones(1, np.uint64))
    got = pa.Table.from_batches(list(suffix_dedup._sort_windows(iter([rows.slice(0, 5000), rows.slice(5000)]))))
    # an even row has the left half of the next one, which loses window 0
    assert dict(zip(got["doc_id"].to_pylist(), got["mask"].to_pylist())) == {i: 1 for i in range(1, 12_000, 2)}
    # the powers of the hash stay in a worker for good
    assert len(suffix_dedup.K._Powers.up) <= 2 * suffix_dedup.TEXT_BYTES


def test_sums_of_a_slice_are_made_once(monkeypatch):
    made, sums = [], suffix_dedup.K.prefix_sums

    def counted(data, *fold):
        made.append(len(data))
        return sums(data, *fold)

    monkeypatch.setattr(suffix_dedup.K, "prefix_sums", counted)
    data = np.random.default_rng(13).integers(97, 100, 5000, dtype=np.uint8)
    zones = suffix_dedup.Zones(data, np.array([0, 2000, 5000]), 4)
    zones.sides(np.arange(len(zones.row)))
    assert made == [5000]
    # the sample is the first of the least of each window
    hashes = suffix_dedup.K.range_hash(data, np.arange(4981), np.arange(20, 5001), suffix_dedup._PLAIN).tolist()
    for start, count, at in zip(zones.start.tolist(), zones.count.tolist(), zones.at.tolist()):
        for s in range(start, start + count):
            window = hashes[s:s + 31]
            assert at == s + window.index(min(window))


def test_zones_that_share_no_side_are_not_counted_as_compared(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_ZONES", 2)
    key, left = np.zeros(5, np.uint64), np.array([1, 1, 2, 3, 4], np.uint16)
    right = np.arange(5, dtype=np.uint16)
    found = pa.Table.from_batches(list(suffix_dedup._sort_samples(key, np.arange(5, dtype=np.uint64), np.arange(5), left, right)))
    assert sorted(zip(found["doc_id"].to_pylist(), found["kind"].to_pylist())) == [(0, suffix_dedup.ENDS), (1, suffix_dedup.ENDS)]


def test_a_task_that_sends_zones_holds_little_beside_them(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(12)
    texts = [rng.integers(97, 123, 40_000, dtype=np.uint8).tobytes().decode() for _ in range(200)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    try:
        sent = sum(b.num_rows > 0 for b in suffix_dedup._send(8)(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent > 1 and peak < 60 << 20, peak


def test_pairs_that_share_a_shingle_only_are_not_compared_whole(spark, monkeypatch):
    words = [[f"w{i}_{j}" for j in range(60)] for i in range(8)]
    rows = [(i, " ".join(["one", "common", "opening", "of", "texts", *w])) for i, w in enumerate(words)]
    rows += [(100, rows[0][1] + " end"), (101, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compared = {}
    check = ngram_join.matching_pairs

    def counted(pairs, docs, places, sets_of, percent, name):
        compared[name] = pairs.count()
        return check(pairs, docs, places, sets_of, percent, name)

    monkeypatch.setattr(ngram_join, "matching_pairs", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.link_classes(docs).collect()}
    assert got == {i: i for i in range(8)} | {100: 0, 101: 1}
    assert compared["stars"] <= 1


def test_bitmaps_never_exclude_a_link():
    rng = np.random.default_rng(7)
    for size in (1, 2, 5, 30, 200, 1000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            y = np.unique(np.concatenate((x[rng.random(len(x)) > 0.15], rng.integers(0, 1 << 63, size // 8, dtype=np.uint64))))
            shared = len(np.intersect1d(x, y))
            if len(y) and 100 * shared >= 75 * (len(x) + len(y) - shared):
                a, b = (signature_tree.narrow(signature_tree.bitmap(s)) for s in (x, y))
                assert signature_tree.may_match(a, len(x), b, len(y), 75)


def test_zones_are_found_in_slices_that_fit_a_cache(monkeypatch):
    sizes, zones = [], suffix_dedup.Zones

    def counted(data, offsets, parts):
        sizes.append((len(data), len(offsets) - 1))
        return zones(data, offsets, parts)

    monkeypatch.setattr(suffix_dedup, "Zones", counted)
    texts = [f"{i} " + "some text that repeats itself " * 300 for i in range(100)] + ["a long text of its own " * 20_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(101), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    assert list(suffix_dedup._send(8)(iter([batch])))
    assert sum(n for _, n in sizes) == 101
    assert all(size <= 1 << 18 or n == 1 for size, n in sizes)
