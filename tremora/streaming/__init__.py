"""Structured Streaming: sources, windowed features, keyed state, sinks."""
