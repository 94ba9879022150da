"""Training-data operators: search, language, extraction, joins, quality, tokens, mixing.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only where it is installed.
"""
