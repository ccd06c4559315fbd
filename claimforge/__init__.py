"""Claimforge: evidence analytics as Spark DataFrame plans."""
