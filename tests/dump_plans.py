"""Write PLANS.md: physical plans of the queries with joins, aggregations
and windows (sf0.01, AQE off so the static shape is visible).

    python tests/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

NAMES = ["manifest_last_wins", "corpus_build", "corpus_report", "reference_prompt", "segment_context", "segment_stitch",
         "similarity_top10", "similarity_csv", "token_metrics", "training_shuffle", "audio_preprocess"]


def main() -> None:
    import __spark_entry__ as E
    from vocaframe.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    out = ["# Physical plans", "",
           f"Generated by `tests/dump_plans.py` on {sf}, AQE off (static shape; at run time AQE may "
           "switch joins to broadcast and coalesce partitions). `Exchange` lines are the shuffles.", ""]
    for name in NAMES:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            E.queries()[name](spark, sf).explain()
        text = buf.getvalue().strip()
        lines = [line for line in text.splitlines() if "Exchange " in line and "Broadcast" not in line]
        rr = sum(1 for line in lines if "RoundRobinPartitioning" in line)
        out += [f"## {name}", "",
                f"Keyed shuffles: {len(lines) - rr}; small-input spreads (round robin, absent on large inputs): {rr}",
                "", "```", text, "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
