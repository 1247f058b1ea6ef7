"""Dataflow operators: sub-word models, vocabulary lookup, sequence preparation, decoding, generation."""
