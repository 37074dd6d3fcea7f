"""Readers and writers: landed records, stored tables, indicator files."""
