"""Training-data operators: identification, de-duplication, filtering, mixing and packing of text."""
