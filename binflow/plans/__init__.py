"""Compositions of operators into whole runs."""
