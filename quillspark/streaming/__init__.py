"""The stateless detectors and the latest-choice step under Structured Streaming."""
