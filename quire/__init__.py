"""Page-oriented document conversion as Spark tables."""
