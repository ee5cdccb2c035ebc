"""Training-data operators: ten stages of a corpus pipeline on Spark DataFrames.

Nothing outside this subpackage imports it. Each module is one operator; `queries` holds the
registered queries and the SQL that checks them.
"""
