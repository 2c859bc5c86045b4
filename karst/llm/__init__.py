"""Training-data operators: near-duplicates, decontamination, classifiers, language models, archives, search and packing."""
