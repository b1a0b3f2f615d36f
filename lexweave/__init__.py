"""Lexweave: document translation, quality and analytics dataflows as Spark DataFrames."""
