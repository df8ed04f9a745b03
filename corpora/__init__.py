"""Source-code corpora derived from the test tables.

``spark`` renders the files with Spark expressions; ``sql`` states, for the
same rows, what was planted in them. The SQL never parses source text.
"""
