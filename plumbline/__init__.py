"""Plumbline: analytics for static dataflow findings, written for Spark DataFrames."""
