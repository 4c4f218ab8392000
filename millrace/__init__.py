"""Millrace: preparing and evaluating instruction-tuning data and market series on Spark."""
