"""Post triage as DataFrame and Structured Streaming operators."""
