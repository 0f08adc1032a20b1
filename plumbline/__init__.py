"""plumbline: reference-calibrated scoring, control tests, ranking and evaluation on Spark.

Layout
------
functions   Column expressions (no Python UDFs)
sources     readers and writers that return DataFrames
operators   one relational operator per function, DataFrame in, DataFrame out
plans       jobs composed from operators (ingest, rank, control test, annotate, ...)
streaming   the progress-log stream and its batch twins
showcase    every operator wired to the sample tables, with its SQL statement
"""

__version__ = "0.1.0"
