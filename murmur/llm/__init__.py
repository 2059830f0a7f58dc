"""Training-data operators: language id, dedup, packing, tokenising, toxicity,
vector search.  Nothing else in the library imports this subpackage."""
