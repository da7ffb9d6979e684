"""Capture analytics on Spark: scoring, timelines, roll-ups, gates and folds over scanner fleets."""
