"""Writers: JSONL splits and the build report."""
