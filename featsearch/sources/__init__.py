"""Scans: input tables, labelled-dataset preparation (ABT), the run store."""
