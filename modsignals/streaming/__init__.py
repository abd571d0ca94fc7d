"""The first pass as a stream over a drop folder."""
