"""Whole runs, from raw export to report, composed of the operators."""
