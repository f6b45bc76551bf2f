"""Operations of a training-data pipeline: scoring, filtering, deduplication, packing, tokenising."""
