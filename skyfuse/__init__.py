"""Spark-native engine for gridded space-time fields: gridding, gap filling,
motion, diffusivity, spectral transition operators and state-space fusion."""
