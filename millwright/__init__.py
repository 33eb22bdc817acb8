"""Batch jobs for shop-floor and text data, written as Spark DataFrame functions."""
