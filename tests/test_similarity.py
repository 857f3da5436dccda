import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocaframe.functions import cosine_similarity
from vocaframe.operators.similarity import by_base_name, csv_lines, ranked, score_references, top_k, write_csv


def np_cos(a, b, eps=1e-8):
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    return float(a @ b / (max(np.linalg.norm(a), eps) * max(np.linalg.norm(b), eps)))


def test_cosine_cases(spark):
    t = [1.0, 2.0, 3.0]
    cases = [t, [-1.0, -2.0, -3.0], [3.0, 0.0, -1.0], [0.0, 0.0, 0.0], [0.5, 1.0, 1.5]]
    df = spark.createDataFrame([(i, c, t) for i, c in enumerate(cases)], "i int, a array<float>, b array<float>")
    got = [r.s for r in df.select("i", cosine_similarity("a", "b").alias("s")).orderBy("i").collect()]
    assert got == pytest.approx([1.0, -1.0, 0.0, 0.0, 1.0], abs=1e-9)
    assert got[2] == pytest.approx(np_cos(cases[2], t), abs=1e-12)


def test_score_topk_and_names(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, f"/d{i % 3}/f{i // 2}.wav", vecs[i].tolist()) for i in range(40)]
    refs = spark.createDataFrame(rows, "vec_id long, path string, embedding array<float>")
    target = refs.where("vec_id = 0")
    scored = score_references(refs.where("vec_id <> 0"), target)
    exp = {i: np_cos(vecs[i], vecs[0]) for i in range(1, 40)}
    got = {r.vec_id: r.similarity for r in scored.collect()}
    assert got == pytest.approx(exp, abs=1e-9)
    top = [r.vec_id for r in ranked(scored, 10).orderBy("rank").collect()]
    assert top == sorted(exp, key=lambda i: (-exp[i], i))[:10]
    # last score wins per base name, at the first position
    named = {r.name: (r.similarity, r.first_pos) for r in by_base_name(scored).collect()}
    d = {}
    for i in range(1, 40):
        d[f"f{i // 2}.wav"] = exp[i]
    assert {k: v[0] for k, v in named.items()} == pytest.approx(d, abs=1e-9)
    assert list(sorted(named, key=lambda k: named[k][1])) == list(d)


def test_target_must_be_one_row(spark):
    refs = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception):
        score_references(refs, refs).collect()


def test_csv_sink(spark, tmpdir_path):
    named = spark.createDataFrame([("b.wav", 0.5, 2), ("a.wav", 0.123456, 1)],
                                  "name string, similarity double, first_pos long")
    out = os.path.join(tmpdir_path, "sim")
    write_csv(named, out)
    lines = []
    for f in sorted(os.listdir(out)):
        if f.startswith("part-"):
            lines += open(os.path.join(out, f)).read().splitlines()
    assert lines == ["a.wav,0.1235", "b.wav,0.5000"]


def brute_top_k(refs, targets, k):
    import numpy as np

    out = []
    for t, tv in targets:
        near = []
        for i, v in refs:
            if i is None or i == t or v is None or None in v or len(v) != len(tv):
                continue
            a, b = np.array(v, float), np.array(tv, float)
            size = max(np.sqrt(a @ a), 1e-8) * max(np.sqrt(b @ b), 1e-8)
            near.append((-round(float(a @ b / size), 9), i))
        out += [(t, n + 1, i, s) for n, (s, i) in enumerate(sorted(near)[:k])]
    return sorted((t, n, i) for t, n, i, _ in out)


def test_top_k_of_many_targets(spark):
    import random

    from conftest import plan_text
    from vocaframe.operators.similarity import top_k_per_target

    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    refs = [(i, rng.choice(vectors)) for i in range(300)]  # many equal vectors: ties by id
    refs += [(400, None), (401, [1.0, None] + [0.0] * 4), (402, [0.0] * 6), (403, [1.0] * 3), (None, vectors[0]), (7, vectors[3])]
    targets = refs[:300:11] + [(403, [1.0] * 3), (404, [2.0] * 3), (405, [1.0] * 9), (406, None), (402, [0.0] * 6)]
    r = spark.createDataFrame(refs, "vec_id long, embedding array<double>").repartition(5)
    t = spark.createDataFrame(targets, "vec_id long, embedding array<double>")
    expected = brute_top_k(refs, [x for x in targets if x[1] is not None], 10)
    for target_bytes in (64 << 20, 6 * 8 * 4):  # one slice, and four targets a slice
        top = top_k_per_target(r, t, 10, target_bytes=target_bytes)
        assert sorted((x.target, x.rank, x.vec_id) for x in top.collect()) == expected
    assert "CartesianProduct" not in plan_text(top) and "NestedLoop" not in plan_text(top)
    assert top_k_per_target(r, t.where("false")).collect() == [] and top_k_per_target(r.where("false"), t).collect() == []
