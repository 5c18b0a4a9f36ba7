"""Operations of a training-data pipeline: fingerprints, extraction, scans, search, dedup, mixing."""
