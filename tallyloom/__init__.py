"""Batch and streaming jobs on periodic statistics, written as Spark DataFrame plans."""
