"""Readers and writers."""

from .readers import (melt_lang, pages_text, paragraphs, read_at_labels, read_conll, read_delimited, read_jsonl,
                      read_sets, read_table, read_until_full, tag_source, with_ids, zip_lines)
from .sinks import append_missing, build_report, write_jsonl, write_splits

__all__ = ["read_table", "read_jsonl", "read_delimited", "read_conll", "read_at_labels", "read_sets", "read_until_full", "zip_lines",
           "paragraphs", "melt_lang", "pages_text", "with_ids", "tag_source", "write_splits", "write_jsonl",
           "build_report", "append_missing"]
