"""Readers and writers: images, containers, sidecars, key logs and the findings store."""
