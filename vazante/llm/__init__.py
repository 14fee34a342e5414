"""Operators that prepare training corpora: counting, labelling, deduplicating, sampling, encoding."""
