"""Quern: curation of text and chat data as Spark DataFrame jobs."""
