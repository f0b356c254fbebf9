"""Operations of a training-data pipeline: filtering, matching, mixing and encoding of documents."""
