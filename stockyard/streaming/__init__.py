"""Imports that start when files arrive."""
