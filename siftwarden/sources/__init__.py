"""Readers: source trees, rule packs, advisories, baselines, policies."""
