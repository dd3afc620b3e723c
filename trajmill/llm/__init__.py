"""Operations of a training-data pipeline: deduplication, filters, scores, packing and sharding."""
