"""tallyspark — label, prediction and evaluation analytics as Spark DataFrame plans.

Sub-packages:
  functions/  column expressions (label codecs, response parsing, text n-grams, prompts)
  operators/  DataFrame -> DataFrame operators (metrics, ensembles, splits, run logs, ...)
  sources/    readers and writers (posts, predictions, run logs, metric reports)
  streaming/  Structured Streaming jobs (incremental scoring, request-rate audit)
  plans/      the registered query plans and their DuckDB oracle SQL
"""

from tallyspark.functions.labels import DEFAULT_CLASSES

__all__ = ["DEFAULT_CLASSES"]
