"""Readers and writers of studysets, and the binding to the test tables."""
