"""Valora: traceable price evidence on Spark.

Every operator takes DataFrames and returns DataFrames. Text, price and question rules are
``Column -> Column`` builders, so they stay inside whole-stage code generation.
"""
