"""Readers and writers: files, sidecars, review sweeps, books, snapshots, reports."""
