"""Readers and writers: cubes, snapshots, wide files and data products."""
