"""The three end-to-end jobs: capture, cleaning with counts, text statistics."""
