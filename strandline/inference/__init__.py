"""Bayesian inference of clustered dynamics: one task per chain, traces as tables."""
