"""Schemas of the tables that the operators exchange.

Missing text is the empty string, never NULL, so that every step can test
``text != ''`` without a second case.
"""

FILES = (
    "path string, filename string, parent string, length long, mtime timestamp, scan_seq long"
)
TEXTS = "path string, preview string"
EXTRACTED = "path string, text string, error string"
LEXICON = "token string, lemma string, tag string, is_stop boolean"
TARGETS = "idx bigint, label string"
TERM_VECTORS = "term string, vec array<float>"
COPY_LOG = "path string, dest_path string, status string, error string"
