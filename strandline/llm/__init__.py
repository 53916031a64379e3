"""Operations for large-scale training-data pipelines."""
