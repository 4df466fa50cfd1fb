"""Tessera: media curation and ranking as Spark DataFrame programs."""
