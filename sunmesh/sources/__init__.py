"""Readers and writers: raw station files, tables, fitted parameters."""
