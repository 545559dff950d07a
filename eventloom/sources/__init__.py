"""Readers and writers for bundles, framed segments, rosters, profiles and artifacts."""
