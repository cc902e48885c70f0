"""Readers and writers of telemetry, waveforms and payloads."""
