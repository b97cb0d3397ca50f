"""Part of the kinspark engine."""
