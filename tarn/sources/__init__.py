"""Delimited files in, reports and tables out, synthetic tables for tests."""
