"""Named queries of the core library with their comparison SQL."""
