"""Readers: tables, CSV pairs, custom folders of CSV/JSONL, JSONL splits."""
