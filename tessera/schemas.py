"""Schemas of the index tables."""

from __future__ import annotations

LINES = "doc_id long, line_no int, start_pos int, end_pos int, line string"
POSITIONS = "doc_id long, term string, pos int, line_no int, is_stop boolean, bucket string"
POSTINGS = "term string, doc_id long, tf long, is_stop boolean, bucket string"
VOCABULARY = "term string, cf long, df long, is_stop boolean, bucket string"
FULL_POSTINGS = POSTINGS
STATS = "sumf long"

