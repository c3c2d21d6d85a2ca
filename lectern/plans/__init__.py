"""Whole runs: preprocessing, collecting, analysis."""
