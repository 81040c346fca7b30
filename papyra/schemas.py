"""Schemas of the engine's tables."""

from __future__ import annotations

BOOKS = (
    "id int, source string, book_id string, url string, title string, author string, illustrator string, release_date string, language string, "
    "category string, original_publication string, credits string, copyright_status string, downloads string, cover_url string, "
    "files array<struct<format string, url string>>, ratings_average double, ratings_count bigint, want_to_read_count bigint, edition_count int, "
    "created_at timestamp, updated_at timestamp"
)
WORKS = "key string, title string, authors array<string>, ratings_average double, ratings_count int, want_to_read_count int, edition_count int, subjects array<string>, last_updated timestamp"
CHUNKS = "doc_id bigint, book_id string, ordinal bigint, seq int, text string, dl int, segment_id bigint"
POSTINGS = "term string, doc_id bigint, tf int, dl int"
FORWARD = "doc_id bigint, dl int, tokens array<string>"
VOCAB = "term string, df bigint"
STATS = "n bigint, total_len bigint, avgdl double"
WAL = "id bigint, content string, metadata string, length int"
SEED_OFFSETS = "source string, position bigint, last_book_id string"
