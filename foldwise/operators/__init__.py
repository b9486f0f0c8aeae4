"""Relational operators: ranking, folds, fold-sealed fitting, joins, metrics, resampling."""
