"""Table operators: windows, alignment, intervals, corpus checks, spans, scores."""
