"""The report's activity counts on a growing corpus."""
