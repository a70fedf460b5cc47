"""Column expressions (JVM-side, whole-stage-codegen friendly where Spark allows)."""

from quarry.functions.text import (char_length, parse_gt, parse_gt_lenient, py_strip, text_head,
                                   with_prefix)
from quarry.functions.terms import bucket_counts, sparse_weights, term_counts
from quarry.functions.vectors import dot, l2_normalize

__all__ = ["with_prefix", "text_head", "parse_gt", "parse_gt_lenient", "char_length", "py_strip",
           "dot", "l2_normalize", "bucket_counts", "sparse_weights", "term_counts"]
