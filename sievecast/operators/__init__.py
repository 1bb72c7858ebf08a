"""DataFrame operators: rules, diffs, suppressions, tool output, scores, life cycle, reports, syntax rules."""
