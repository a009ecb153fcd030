"""Experiment analytics on Spark: sampling, exact retrieval, prompts, metrics, ranking and contrasts."""
