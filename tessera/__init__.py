"""Panel analytics on Spark: observations to panels, features, folds, baselines, models and their comparison."""
