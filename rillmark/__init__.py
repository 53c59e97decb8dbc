"""Event-stream analytics on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame.  ``operators`` holds
the batch forms, ``streaming`` the Structured Streaming forms, ``sources`` and
``sinks`` the edges, ``functions`` the column expressions they share, and
``plans`` the registered queries.
"""
