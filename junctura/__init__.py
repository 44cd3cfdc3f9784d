"""Junctura: splice-junction analytics and training-data operators on Spark."""
