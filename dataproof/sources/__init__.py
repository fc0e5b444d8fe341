"""Readers, payload checks, manifests, URL screening and the artifact table."""
