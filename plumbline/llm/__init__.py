"""Operators for preparing training data from findings, source files and documents."""
