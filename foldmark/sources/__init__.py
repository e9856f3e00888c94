"""Readers and writers of cohort data."""
