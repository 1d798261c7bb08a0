"""Spark jobs for loan-level credit-risk data, DataFrame in and DataFrame out."""
