"""Command line: ``python -m vocaframe corpus ...`` / ``python -m vocaframe prompts ...``.

Option names and defaults are a public interface kept on purpose, so that
existing calls go on working."""

from __future__ import annotations

import argparse
import json

from .jobs import build_corpus_job, training_table_job
from .session import get_spark


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vocaframe")
    sub = p.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("corpus", help="manifest + audio folder + codes table -> JSONL corpus")
    c.add_argument("audio_dir")
    c.add_argument("text_file")
    c.add_argument("--codes", required=True, help="table of file_id, code (Parquet, or .json/.jsonl)")
    c.add_argument("-o", "--output", default="dataset/data.jsonl")
    c.add_argument("--split_word", default=":")
    c.add_argument("--file_index", type=int, default=0)
    c.add_argument("--text_index", type=int, default=1)
    c.add_argument("--ext", default=".wav")
    t = sub.add_parser("prompts", help="JSONL corpus -> shuffled training table (Parquet)")
    t.add_argument("corpus")
    t.add_argument("-o", "--output", required=True)
    t.add_argument("--seed", type=int, default=0)
    t.add_argument("--shards", type=int, default=None)
    a = p.parse_args(argv)
    spark = get_spark()
    if a.cmd == "corpus":
        out = build_corpus_job(spark, a.audio_dir, a.text_file, a.output, a.codes, a.split_word,
                               a.file_index, a.text_index, a.ext)
    else:
        out = {"rows": training_table_job(spark, a.corpus, a.output, a.seed, a.shards)}
    print(json.dumps(out))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
