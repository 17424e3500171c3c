"""Training-data operators: packing, decontamination, language, licences, toxicity, pages, neighbours, dedup, quality, ranked search, conversations."""
