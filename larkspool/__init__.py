"""Larkspool: instruction-data curation and answer evaluation as Spark jobs.

Every operator takes and returns DataFrames (or Columns) and identifies rows by
an explicit, unique ``row_id`` column, so no result depends on how the data is
partitioned or on the order in which files are read.
"""
