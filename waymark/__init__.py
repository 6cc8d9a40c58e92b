"""Waymark: batch analytics over labelled, step-structured records on Spark."""
