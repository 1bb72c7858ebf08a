"""Column functions over texts: normalisers, the comment and string mask, metrics, pattern scanners, scores."""
