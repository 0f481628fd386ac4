"""Training-data operators: the ten jobs that clean, select and encode a text corpus."""
