"""Multi-row operators: trailing context, examples, dedup, sampling, split, requests."""
