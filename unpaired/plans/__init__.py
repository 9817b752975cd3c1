"""Whole analyses: the pipeline, experiments, panels and the graphs of the driver tables."""
