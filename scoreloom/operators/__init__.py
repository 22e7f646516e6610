"""Work on rows: scoring, ordinals, artifacts, comparisons."""
