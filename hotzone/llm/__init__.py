"""Training-data operators: decontamination, packing, chat formatting,
near-duplicate and substring dedup, line dedup, page extraction, licence and
toxicity scans. Nothing outside this package imports it."""
