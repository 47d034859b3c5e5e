"""User-level jobs: sources, operators and sinks put together."""
