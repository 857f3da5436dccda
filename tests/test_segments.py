import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from vocaframe import constants as K
from vocaframe.operators.segments import chain_context, split_script, stitch_offsets, stitched_stream
from test_text import ref_norm


def py_prompt(text, codes):
    p = K.BOS_TOKEN + K.PROMPT_HEAD + ref_norm(text) + K.PROMPT_TAIL
    if codes:
        p += "".join(f"<|s_{c}|>" for c in codes)
    return p


def py_chain(texts, codes, ref_text, ref_codes):
    """The multi-sentence loop with known per-sentence codes."""
    prompts, stitched = [], []
    rt, rc = ref_text, ref_codes
    for i, (t, c) in enumerate(zip(texts, codes)):
        full = rt + t if rt else t
        prompts.append(py_prompt(full, rc))
        ids = c
        if i < len(texts) - 1:
            ids = ids[:-16]
        stitched.extend(ids)
        rt, rc = t, ids
    return prompts, stitched


def make_scripts(n_scripts=6, seed=0):
    rng = random.Random(seed)
    rows, refs = [], []
    for s in range(n_scripts):
        n = rng.choice([1, 2, 3, 5, 8])
        for p in range(n):
            k = rng.choice([0, 1, 15, 16, 17, 30])
            rows.append((s, p, f"文{s}の{p}。", [rng.randint(0, 65535) for _ in range(k)]))
        refs.append((s, "参照" if s % 2 else None, [1, 2, 3] if s % 3 else None))
    return rows, refs


@pytest.mark.parametrize("block", [1, 2, 3, 1024])
def test_chain_context_matches_loop(spark, block):
    rows, refs = make_scripts()
    df = spark.createDataFrame(rows, "script_id long, pos long, text string, codes array<int>")
    rdf = spark.createDataFrame(refs, "script_id long, ref_text string, ref_codes array<int>")
    got = {(r.script_id, r.pos): r.prompt for r in chain_context(df, rdf, block=block).collect()}
    for s, ref_text, ref_codes in refs:
        mine = sorted([r for r in rows if r[0] == s], key=lambda r: r[1])
        exp, _ = py_chain([r[2] for r in mine], [r[3] for r in mine], ref_text or "", ref_codes or [])
        assert [got[(s, r[1])] for r in mine] == exp


@pytest.mark.parametrize("block", [1, 2, 4, 1024])
def test_stitch_matches_loop(spark, block):
    rows, refs = make_scripts(seed=block)
    df = spark.createDataFrame(rows, "script_id long, pos long, text string, codes array<int>")
    off = stitch_offsets(df, block=block, materialize=(block == 2))
    stream = stitched_stream(off).collect()
    got = {}
    for r in stream:
        got.setdefault(r.script_id, {})[r.seq] = r.code
    totals = {r.script_id: r.total for r in off.where("is_last").collect()}
    for s, _, _ in refs:
        mine = sorted([r for r in rows if r[0] == s], key=lambda r: r[1])
        _, exp = py_chain([r[2] for r in mine], [r[3] for r in mine], "", [])
        seq = got.get(s, {})
        assert [seq[i] for i in range(len(seq))] == exp
        assert totals[s] == len(exp)
        # property: total = sum(max(n - 16, 0)) over non-last + n of last
        ns = [len(r[3]) for r in mine]
        assert totals[s] == sum(max(n - 16, 0) for n in ns[:-1]) + ns[-1]


def test_split_script(spark):
    docs = spark.createDataFrame([(1, " a \n\n b\r\nc  　 \nd"), (2, ""), (3, "\n\n")],
                                 "doc_id long, text string")
    got = split_script(docs, "doc_id", "text").orderBy("script_id", "pos").collect()
    assert [(r.script_id, r.pos, r.text) for r in got] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d")]


def test_blocked_plan_has_no_script_only_exchange(spark):
    rows, _ = make_scripts()
    df = spark.createDataFrame(rows, "script_id long, pos long, text string, codes array<int>")
    plan = plan_text(stitch_offsets(df, block=2))
    keyed = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    keys = [[k.strip().split("#")[0] for k in x.split(",") if not k.strip().isdigit()] for x in keyed]
    # rows and blocks by (script_id, block); blocks by superblock; one row per
    # superblock by script
    assert sorted(keys).count(["script_id"]) == 1
    assert all(k[:2] in (["script_id", "_blk"], ["script_id", "_sblk"], ["script_id"]) for k in keys)
    assert plan.count("Scan ExistingRDD") == 1  # the block table is read from its files


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1024])
def test_gaps_do_not_depend_on_the_block(spark, block):
    positions = [0, 2, 3, 4, 9, 10, 31, 32]
    rows = [(s, p, f"t{s}.{p}", [p] * 20) for s in (1, 2) for p in positions[s - 1:]]
    df = spark.createDataFrame(rows, "script_id long, pos long, text string, codes array<int>")
    got = {(r.script_id, r.pos): (r.context_text, r.context_codes) for r in chain_context(df, block=block).collect()}
    for s in (1, 2):
        own = positions[s - 1:]
        assert got[s, own[0]] == (None, None)
        for before, p in zip(own, own[1:]):
            assert got[s, p] == (f"t{s}.{before}", [before] * 4)
    starts = {(r.script_id, r.pos): r.start_seq for r in stitch_offsets(df, block=block).collect()}
    assert starts == {(s, p): 4 * i for s in (1, 2) for i, p in enumerate(positions[s - 1:])}


@pytest.mark.parametrize("block", [8, 64])
def test_hot_script_over_many_blocks(spark, block):
    """One script holds most rows; blocks (and superblocks) spread it."""
    rng = random.Random(11)
    rows = [(0, p, f"s{p}", [rng.randint(0, 9) for _ in range(rng.choice([0, 10, 17, 20]))]) for p in range(3000)]
    rows += [(s, p, f"t{s}{p}", [1] * 18) for s in range(1, 40) for p in range(3)]
    df = spark.createDataFrame(rows, "script_id long, pos long, text string, codes array<int>")
    off = stitch_offsets(df, block=block)
    got = {(r.script_id, r.pos): (r.start_seq, r.n_kept) for r in off.collect()}
    hot = [r for r in rows if r[0] == 0]
    start = 0
    for i, r in enumerate(hot):
        n = len(r[3]) if i == len(hot) - 1 else max(len(r[3]) - 16, 0)
        assert got[(0, r[1])] == (start, n)
        start += n
    ctx = {r.pos: r.context_codes for r in chain_context(df, block=block).where("script_id = 0").collect()}
    for i in range(1, len(hot)):
        assert ctx[i] == hot[i - 1][3][:-16] if len(hot[i - 1][3]) > 16 else ctx[i] == []


def test_attach_per_script_salted(spark):
    from vocaframe.operators.segments import attach_per_script

    rows = spark.createDataFrame([(0, p) for p in range(50)] + [(1, 0), (2, 3)], "script_id long, pos long")
    refs = spark.createDataFrame([(0, "r0"), (1, "r1")], "script_id long, ref string")
    got = sorted((r.script_id, r.pos, r.ref) for r in attach_per_script(rows, refs, block=4).collect())
    assert got == sorted([(0, p, "r0") for p in range(50)] + [(1, 0, "r1")])
    left = attach_per_script(rows, refs, block=4, how="left")
    assert left.count() == 52 and left.where("ref IS NULL").count() == 1
