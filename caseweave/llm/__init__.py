"""Operations of a training-data pipeline: extraction, filtering, deduplication, tokens, packing, media."""
