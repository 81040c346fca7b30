"""Training-data operators: scans, deduplication, scoring, search and tokenisation of documents."""
