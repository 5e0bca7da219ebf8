"""Incremental forms: late versions, idempotent replay, event-time windows, a latest-per-key table that outlives its stream."""
