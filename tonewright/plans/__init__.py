"""Flows built from the operators: corpus preparation, model fitting, scoring, query catalogue."""
