"""Registered queries: importing the package registers those of all its modules."""

from pointweave.plans import audits, charting, experiments, profiles, registry, sources, studies  # noqa: F401
