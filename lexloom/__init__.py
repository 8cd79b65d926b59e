"""Corpus analytics on PySpark: lazy DataFrame-to-DataFrame operators for labelled text corpora."""
