"""Training-data operators: packing, near-duplicate search, top-k search, classifiers, formats, tokenisation."""
