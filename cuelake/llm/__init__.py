"""Training-data operators: packing, de-duplication, scoring, extraction, formatting."""
