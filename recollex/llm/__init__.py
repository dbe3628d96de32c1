"""Operations of a training-data pipeline: tokenising, mixing, filtering, searching and deduplicating text."""
