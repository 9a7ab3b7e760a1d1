"""Limits of documents, paths and patterns."""

INPUT_BYTES = 5 * 1024 * 1024
STRING_BYTES = 8192
DEPTH = 128
INT_MAX = 2**53 - 1
QUANTIFIER = 100
REGEX_NODES = 10_000
