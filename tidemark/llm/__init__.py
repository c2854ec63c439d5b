"""Operators for training-data pipelines: scans, packing, tokens, language, quality, shards, repeats, models, media."""
