"""Write the physical operator trees of the headline queries to PLANS.md (formatted explain, tree part)."""

import io
import os
import sys
from contextlib import redirect_stdout

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from quarry import catalog, catalog_retrieval  # noqa: E402, F401 (registers its queries)
from quarry.session import get_session  # noqa: E402

SHOW = ["r2_top_k", "v1_ap_labels", "v4_article_stats", "v7_worst_by_fp", "a2_gt_length_stats", "h14_clean_html", "r4_bm25", "r4_expanded"]


def tree(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    return text.split("\n\n\n")[0].strip()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", shuffle_partitions=8)
    out = ["# Physical plans of headline queries", "",
           f"`python tools/explain_plans.py {sf}` (operator trees of `explain('formatted')`, before adaptive re-planning).", ""]
    for name in SHOW:
        out += [f"## {name}", "", "```", tree(catalog.QUERIES[name](spark, sf)), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
