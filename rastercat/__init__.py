"""Image-catalogue jobs on Spark: change detection, perceptual hashing, similarity joins, replacement plans."""
