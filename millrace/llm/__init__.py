"""Training-data operators: packing, near duplicates, sharding, fixity, extraction, scoring, cleaning."""
