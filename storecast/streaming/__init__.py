"""The weekly evaluation as a stream."""
