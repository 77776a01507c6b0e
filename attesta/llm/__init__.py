"""Operators for preparing training text on Spark. Nothing outside this folder imports it."""
