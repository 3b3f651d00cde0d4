"""Whole jobs and the views they run on."""
