"""Lodestack: program and corpus analysis as relations on Spark."""
