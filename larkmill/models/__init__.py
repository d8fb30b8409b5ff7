"""The model layer: training, tuning and prediction on Spark ML."""
