"""Spark-first analytics for multichannel physiological and optical recordings."""
