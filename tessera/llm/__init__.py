"""Training-data operators: mixing, HTML extraction, secret scans, quality rules,
SimHash near-dedup, quality and toxicity classifiers, SentencePiece, exact top-k
and WARC. Nothing outside this subpackage imports it."""
