"""postloom: Spark operators and plans for corpora of short posts."""

__version__ = "0.1.0"
