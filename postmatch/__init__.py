"""Posting-to-profile matching and product metrics as Spark DataFrame jobs."""
