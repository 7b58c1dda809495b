"""sextant: intent discovery operators on Spark DataFrames.

Subpackages:
  functions  column expressions (text cleaning, vector math)
  sources    table, CSV and artifact-store access
  operators  DataFrame operators (range joins, density clustering, quality
             scores, candidate extraction, labelling, evaluation, prompts)
  plans      configuration sweeps and the end-to-end pipelines
  streaming  incremental runs of the batch stages over arriving files
"""

from sextant.session import get_spark  # noqa: F401
