"""Training-data operators: toxicity, language-model scores, secret scans, mixing, exact and near
de-duplication, quality rules, web archives, packing and repeated-passage removal."""
