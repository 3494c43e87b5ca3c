"""Readers, selectors, replay rules and watch positions."""
