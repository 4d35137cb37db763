"""Code-corpus analytics on Spark DataFrames.

Every operator takes and returns DataFrames; a corpus is a table ``files(path, content)``.
"""
