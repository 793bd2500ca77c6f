"""Morphological segmentation analytics on Spark."""
