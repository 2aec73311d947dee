"""Spark jobs for analysing captured network traffic and other evidence corpora."""
