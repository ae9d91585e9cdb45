"""logloom: a Spark-native engine for analysing execution logs.

Every public operator takes and returns DataFrames (or Columns) and stays lazy;
see README.md for the map of modules.
"""
