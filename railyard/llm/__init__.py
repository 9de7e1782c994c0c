"""Training-data operators: thirteen corpus jobs built on Spark DataFrames.

Nothing else in the library imports this subpackage.  One module per operator;
``registry`` holds the registered queries and their SQL.
"""
