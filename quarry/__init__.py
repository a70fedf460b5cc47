"""quarry: retrieval and ranking evaluation as Spark DataFrame jobs.

Subpackages
-----------
sources    readers, writers and test fixtures (DataFrame in, DataFrame out)
functions  Column expressions: text, ids, vectors, prompts
operators  DataFrame -> DataFrame operators: HTML cleanup, ranking, evaluation, analysis, inference
plans      end-to-end jobs composed from operators (answer, evaluation run, suite, article preparation)
streaming  Structured Streaming variant of the answer job
"""

from quarry.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
