"""Operators of a training-data pipeline: sharding, secret scan, benchmark
decontamination, top-k search, token rollups, quality classifier, near-duplicate
removal, packing, WARC archives, line dedup, filter audit, source mixing and
embedding whitening. Nothing else in the library imports this subpackage."""
