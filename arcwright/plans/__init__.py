"""Shared plan helpers: checkpointing and loops."""
