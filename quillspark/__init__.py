"""Prose analytics on Spark: detectors, facts, readability, stylometry, harvest, statistics."""
